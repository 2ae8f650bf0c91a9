"""Input sanitisers as built-in column expressions.

All of them stay inside whole-stage codegen: no Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters Python's str.strip() treats as whitespace, the
# HTML-escape table (quote=True) and the metacharacters deleted afterwards.
PY_WHITESPACE = (r"\t\n\x{0B}\x{0C}\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                 r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
HTML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]
DELETED_CHARS = "<>\"'%;()&+"

STRIP_PATTERN = f"^[{PY_WHITESPACE}]+|[{PY_WHITESPACE}]+\\z"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()`` (Spark's ``trim`` only strips spaces)."""
    return F.regexp_replace(_col(c), STRIP_PATTERN, "")


def sanitize_text(c, max_len: int = 200) -> Column:
    """Null -> ''; strip; HTML-escape; delete metacharacters; truncate.

    Escaping then deleting ``& ;`` etc. leaves the entity *names*: ``&`` ->
    ``amp``, ``<`` -> ``lt``, ``>`` -> ``gt``, ``"`` -> ``quot``, ``'`` -> ``#x27``.
    """
    v = py_strip(F.coalesce(_col(c).cast("string"), F.lit("")))
    for ch, ent in HTML_ESCAPES:  # '&' first, as html.escape does
        v = F.replace(v, F.lit(ch), F.lit(ent))
    v = F.translate(v, DELETED_CHARS, "")
    return v if max_len is None else F.substring(v, 1, max_len)


def sanitize_key(c, max_len: int = 100) -> Column:
    """Non-string key -> text (null -> 'nan', as pandas ``astype(str)``),
    then :func:`sanitize_text`."""
    return sanitize_text(F.coalesce(_col(c).cast("string"), F.lit("nan")), max_len)


def to_double(c) -> Column:
    """``float(v)``-like parse: strings via ``try_cast`` (ANSI-safe), numbers
    as is.  Returns null on failure; NaN/inf survive."""
    return _col(c).try_cast("double")


def sanitize_numeric(c, lo: float, hi: float, default: float) -> Column:
    """Non-numeric, null, NaN, +-inf -> default; else clamp to [lo, hi]."""
    v = to_double(c)
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad, F.lit(float(default))).otherwise(F.least(F.greatest(v, F.lit(float(lo))), F.lit(float(hi))))


_INT_TEXT = r"^[\t\n\x{0B}\x{0C}\r ]*[+-]?[0-9]+[\t\n\x{0B}\x{0C}\r ]*$"


def sanitize_int(c, lo: int, hi: int, default: int, source_type: str | None = None) -> Column:
    """``int(v)`` semantics -- numbers truncate toward zero, integer text
    parses, other text (e.g. "3.7"), null, NaN and inf -> default; clamp."""
    col = _col(c)
    if source_type == "string":
        txt = py_strip(col)
        v = F.when(col.rlike(_INT_TEXT), txt.try_cast("bigint"))
    else:
        d = col.cast("double")
        v = F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")) | (F.abs(d) >= 9.2e18), F.lit(None)) \
            .otherwise(d.cast("bigint"))
    return F.when(v.isNull(), F.lit(int(default))).otherwise(
        F.least(F.greatest(v, F.lit(int(lo))), F.lit(int(hi)))).cast("bigint")


def _clip_or_zero(c, hi: float) -> Column:
    """Coerce, NaN -> null *before* clipping (NaN sorts greatest in
    Spark), clip to [0, hi], null -> 0."""
    v = to_double(c)
    v = F.when(F.isnan(v), F.lit(None)).otherwise(v)
    return F.coalesce(F.least(F.greatest(v, F.lit(0.0)), F.lit(float(hi))), F.lit(0.0))


CLEAN_LIMITS = {"cp": 100.0, "fiber": 100.0, "energy": 10000.0, "cost": 100000.0}


def clean_catalog(df: DataFrame, cp_max: float = 100.0) -> DataFrame:
    """I4 ``sanitize_df_edit`` + C6 + C8: sanitise name (100 chars), coerce
    and clip numerics, drop rows whose sanitised name is blank.  Missing
    numeric columns stay missing (presence is checked at plan time)."""
    limits = dict(CLEAN_LIMITS, cp=cp_max)
    cols = []
    for c in df.columns:
        if c == "ingredient":
            cols.append(sanitize_key(c, 100).alias(c))
        elif c in limits:
            cols.append(_clip_or_zero(c, limits[c]).alias(c))
        else:
            cols.append(F.col(c))
    out = df.select(*cols)
    if "ingredient" in df.columns:
        out = out.where(py_strip("ingredient") != "")
    return out
