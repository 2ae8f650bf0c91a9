"""Catalog operators: search, filter, sort, summaries, first-wins dedupe and
keyed merge (C3-C6, C8, C17, E1, E2, E6, E10, G1, B4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sanitize import clean_catalog, sanitize_text

NUMERIC_COLS = ("cp", "energy", "fiber", "cost")
SORTABLE = {"Ingredient": "ingredient", "CP": "cp", "Energy": "energy", "Cost": "cost"}


def ensure_columns(df: DataFrame, cols=("species", "pos", "ingredient") + NUMERIC_COLS) -> DataFrame:
    """Column-presence guard at plan-build time; absent columns become
    typed NULLs so downstream operators see one schema."""
    for c in cols:
        if c not in df.columns:
            typ = T.StringType() if c in ("species", "ingredient") else (
                T.LongType() if c == "pos" else T.DoubleType())
            df = df.withColumn(c, F.lit(None).cast(typ))
    return df


def search_literal(df: DataFrame, column: str, term: str | Column) -> DataFrame:
    """Case-insensitive literal substring of the *sanitised* term; an
    empty term keeps every row."""
    t = sanitize_text(term if isinstance(term, Column) else F.lit(term))
    return df.where((t == "") | F.lower(F.col(column)).contains(F.lower(t)))


def search_regex(df: DataFrame, column: str, term: str, literal: bool = False) -> DataFrame:
    """Case-insensitive *regular expression* of the sanitised term,
    nulls never match; empty term keeps every row.  The term is sanitised on
    the driver (it is one scalar) so the pattern is a literal for codegen.
    An invalid pattern fails the job (as the reference's search does);
    ``literal=True`` matches the sanitised text as a plain substring."""
    clean = sanitize_scalar(term)
    if clean == "":
        return df
    if literal:
        return df.where(F.coalesce(F.lower(F.col(column)).contains(clean.lower()), F.lit(False)))
    return df.where(F.coalesce(F.col(column).rlike("(?i)" + clean), F.lit(False)))


def sanitize_scalar(value, max_len: int = 200) -> str:
    """Driver-side twin of :func:`sanitize_text` for one parameter value:
    the same steps as the column expression (strip, entity table, delete
    metacharacters, truncate) applied to a Python string."""
    from ..functions.sanitize import DELETED_CHARS, HTML_ESCAPES
    if not isinstance(value, str):
        return ""
    text = value.strip()
    for ch, ent in HTML_ESCAPES:
        text = text.replace(ch, ent)
    text = text.translate({ord(c): None for c in DELETED_CHARS})
    return text[:max_len]


def type_filter(df: DataFrame, term: str | Column, column: str = "type") -> DataFrame:
    """C4: equality filter with the "All" wildcard."""
    t = term if isinstance(term, Column) else F.lit(term)
    return df.where((t == "All") | (F.col(column) == t))


def sort_catalog(df: DataFrame, by: str) -> DataFrame:
    """G1: ascending only for the name column, descending for numbers;
    ``pos`` breaks ties.  A distributed range sort (no single-task sort)."""
    col = SORTABLE.get(by, by)
    order = F.asc(col) if col == "ingredient" else F.desc(col)
    return df.orderBy(order, F.asc("pos"))


def summary(df: DataFrame, keys=("species",)) -> DataFrame:
    """Row count and null-skipping means per group (partial
    aggregation, so hot groups pre-aggregate before the shuffle)."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_ingredients"),
        F.avg("cost").alias("avg_cost"),
        F.avg("cp").alias("avg_cp"),
        F.avg("energy").alias("avg_energy"),
    )


def first_per_key(df: DataFrame, keys=("species", "ingredient"), order_col: str = "pos") -> DataFrame:
    """First row per key by ``order_col`` (``.values[0]`` semantics).

    The least position of each key is a hash aggregate with a map-side part,
    so a key holding a third of the rows meets as one number a task; the rows
    come back by a semi join on (key, position), which spreads a hot key over
    the tasks.  Only those rows, one a key but for equal positions, are then
    made unique."""
    on = [*keys, order_col]
    first = df.groupBy(*keys).agg(F.min(order_col).alias(order_col)).select(*[F.col(c).alias(f"_f_{c}") for c in on])
    same = None
    for c in on:
        e = F.col(c).eqNullSafe(F.col(f"_f_{c}"))
        same = e if same is None else same & e
    return df.join(first, same, "left_semi").dropDuplicates(list(keys))


def sorted_distinct(df: DataFrame, value: str, keys=("species",), sentinel: str | None = "All",
                    sep: str = "|") -> DataFrame:
    """E6 + H2: sorted distinct values per group, optionally with a leading
    sentinel option, rendered as one delimited string."""
    arr = F.array_sort(F.collect_set(value))
    if sentinel is not None:
        arr = F.concat(F.array(F.lit(sentinel)), arr)
    return df.groupBy(*keys).agg(F.array_join(arr, sep).alias(f"{value}_options"))


def merge_catalog(base: DataFrame, edits: DataFrame, keys=("species", "ingredient"),
                  mode: str = "merge") -> DataFrame:
    """Sanitise the edits (I4), then either replace the catalog
    (``mode='replace'``, the reference's behaviour when a search filter is
    active) or upsert by key with one full outer join: edit values win,
    base-only rows stay, edit-only rows are added.  Duplicate edit keys
    resolve first-wins by ``pos``.  The empty-result gate (C17) is applied
    where the result is saved (``sinks.writers.save_catalog``)."""
    clean = first_per_key(clean_catalog(edits), keys)
    if mode == "replace":
        return clean.withColumn("source", F.lit("edit"))
    vals = [c for c in clean.columns if c not in keys]
    b = base.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in vals], F.lit(True).alias("_b"))
    e = clean.select(*keys, *[F.col(c).alias(f"_e_{c}") for c in vals], F.lit(True).alias("_e"))
    m = b.join(e, list(keys), "full_outer")
    src = F.when(F.col("_e").isNull(), "base").when(F.col("_b").isNotNull(), "edit").otherwise("new")
    return m.select(*keys, *[F.when(F.col("_e"), F.col(f"_e_{c}")).otherwise(F.col(f"_b_{c}")).alias(c)
                             for c in vals], src.alias("source"))
