"""Operator 2: secret scan over a ledger of blobs (DataFrame functions only).

Every version of every path is content-addressed (SHA-256 of its text).  The
ledger holds the (blob, rule) pairs that were scanned before, a rule being
named with its version; only pairs that are not in it are scanned, each blob
once however many paths hold it, and the findings are joined back to all
paths.  With ``ledger`` None everything is unseen.  ``scan_blobs`` returns
spans for the unseen pairs, ``append_ledger`` adds them to the ledger's table,
``scan_paths`` joins the spans of all blobs to the paths.

Span positions come without Python: cutting a text at the matches of a pattern
gives the pieces between them, and the running lengths of pieces and matches
are the positions (code points, end exclusive).  Where a pattern's minimum can
be written as a repeat count without changing which matches there are, it is;
``assign`` is matched as it stands and short values are dropped afterwards.

Defined cases: null text is the empty blob; an empty table gives no rows;
repeated rows are returned as often as they occur; null ``doc_id`` is kept;
further columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import path_exists


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str          # Java regular expression
    group: int = 0        # the group whose length counts
    least: int = 1        # code points that group has at least
    base: bool = True     # one of the three base kinds

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
    # added by the method: tokens of code hosts and headers of private keys
    Rule("host", 1, r"gh[opsur]_[A-Za-z0-9]{36,}", base=False),
    Rule("key", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", base=False),
)


def _spans(rule: Rule, text: str = "text"):
    """array<struct<start,end>> of one rule's matches in a text column."""
    c, pat = F.col(text), F.lit(rule.pattern)
    found = F.regexp_extract_all(c, pat, F.lit(0))
    pieces = F.split(c, rule.pattern, -1)
    sizes = F.regexp_extract_all(c, pat, F.lit(rule.group)) if rule.group else found
    rows = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("p"), found.alias("m"), sizes.alias("g"))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    walk = F.aggregate(
        rows, F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, r: F.struct(
            (acc["at"] + F.length(r["p"]) + F.length(r["m"])).alias("at"),
            F.when(F.length(r["g"]) >= rule.least, F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + F.length(r["p"])).alias("start"),
                (acc["at"] + F.length(r["p"]) + F.length(r["m"])).alias("end")))))
            .otherwise(acc["out"]).alias("out")),
        lambda acc: acc["out"])
    return F.when(F.rlike(c, pat), walk).otherwise(empty)


def address(versions: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``blob``, the address of the version's content."""
    return versions.withColumn("blob", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def scan_blobs(versions: DataFrame, rules=RULES, ledger: DataFrame | None = None, text: str = "text") -> DataFrame:
    """(blob, rule, kind_no, base, spans) of every pair of a blob in ``versions`` and
    a rule that ``ledger`` (blob, rule) lacks.  Equal texts meet before they
    are scanned, and copies fold inside each task before the shuffle."""
    rules = tuple(rules)
    unseen = address(versions, text).select("blob", F.coalesce(F.col(text), F.lit("")).alias("text"))
    if ledger is not None:
        done = (ledger.where(F.col("rule").isin([r.name for r in rules])).groupBy("blob")
                .agg(F.collect_set("rule").alias("_done")))  # at most one name a rule
        unseen = (unseen.join(done, "blob", "left")
                  .where(F.size(F.coalesce("_done", F.array().cast("array<string>"))) < len(rules)))
    else:
        unseen = unseen.withColumn("_done", F.array().cast("array<string>"))
    once = unseen.dropDuplicates(["blob"])
    done = F.coalesce(F.col("_done"), F.array().cast("array<string>"))
    each = F.array(*[F.when(~F.array_contains(done, r.name), F.struct(
        F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(i).alias("kind_no"),
        F.lit(r.base).alias("base"), _spans(r).alias("spans"))) for i, r in enumerate(rules)])
    return (once.select("blob", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("f"))
            .select("blob", "f.rule", "f.kind", "f.kind_no", "f.base", "f.spans"))


def append_ledger(found: DataFrame, path: str) -> None:
    """Adds the scanned pairs with their spans to the ledger's table."""
    found.write.mode("append").parquet(path)


def scan_paths(versions: DataFrame, found: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a path (version) with all spans of its blob."""
    order = lambda f: F.transform(F.array_sort(f), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    flat = lambda f: F.flatten(F.transform(f, lambda r: F.transform(r["spans"], lambda s: F.struct(
        s["start"].alias("start"), r["kind_no"].alias("kind_no"), s["end"].alias("end"), r["kind"].alias("kind")))))
    kinds = F.collect_list(F.struct("kind", "kind_no", "base", "spans"))  # one element a rule
    per = found.groupBy("blob").agg(kinds.alias("f"))
    n = lambda kind: F.aggregate(F.col("f"), F.lit(0), lambda a, r: a + F.when(
        r["kind"] == kind, F.size(r["spans"])).otherwise(0)).cast("bigint")
    per = per.select("blob", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
                     F.sha2(F.concat_ws(",", order(flat(F.filter("f", lambda r: r["base"])))).cast("binary"), 256)
                     .alias("base_sha256"), F.concat_ws(",", order(flat(F.col("f")))).alias("spans"))
    return (address(versions, text).select(F.col(key).alias("doc_id"), "blob").join(per, "blob")
            .select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "blob"))


def secret_scan(versions: DataFrame, rules=RULES, ledger: DataFrame | None = None, text: str = "text",
                key: str = "doc_id") -> DataFrame:
    """All spans of all paths; pairs in ``ledger`` (columns of ``scan_blobs``)
    are taken from it instead of being scanned."""
    found = scan_blobs(versions, rules, ledger, text)
    if ledger is not None:
        found = found.unionByName(ledger.where(F.col("rule").isin([r.name for r in rules])).select(*found.columns))
    return scan_paths(versions, found, text, key)


def scan_loads(loads: list[DataFrame], path: str, rules=RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All spans of all paths of several loads, one after the other: each adds
    to the ledger at ``path`` what no load before it (nor an earlier run) has
    scanned, and the findings of all come from the ledger."""
    spark = loads[0].sparkSession
    ledger = lambda: spark.read.parquet(path).dropDuplicates(["blob", "rule"])  # noqa: E731  as a load may run twice
    for load in loads:
        known = ledger().select("blob", "rule") if path_exists(spark, f"{path}/_SUCCESS") else None
        append_ledger(scan_blobs(load, rules, known, text), path)
    found = ledger().where(F.col("rule").isin([r.name for r in rules]))
    return reduce(DataFrame.unionByName, [scan_paths(load, found, text, key) for load in loads])
