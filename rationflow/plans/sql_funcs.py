"""DuckDB SQL text for the scalar functions (oracle side)."""

from __future__ import annotations

import re

from ..sources import reference_tables as R


# Fixed values, stated here apart from the engine's: the white space a strip
# removes, the HTML entities, the characters deleted after escaping.
STRIP = (r"[\t\n\x{0B}\x{0C}\r\x{1C}\x{1D}\x{1E}\x{1F}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
         r"\x{202F}\x{205F}\x{3000}]")
ENTITIES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]
DELETED = "<>\"'%;()&+"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def py_strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, {lit('^' + STRIP + '+')}, ''), {lit(STRIP + '+$')}, '')"


def sanitize_text(x: str, max_len: int | None = 200) -> str:
    v = py_strip(f"coalesce(CAST({x} AS VARCHAR), '')")
    for ch, ent in ENTITIES:
        v = f"replace({v}, {lit(ch)}, {lit(ent)})"
    v = f"translate({v}, {lit(DELETED)}, '')"
    return v if max_len is None else f"substring({v}, 1, {max_len})"


def sanitize_key(x: str, max_len: int = 100) -> str:
    return sanitize_text(f"coalesce(CAST({x} AS VARCHAR), 'nan')", max_len)


def sanitize_numeric(x: str, lo, hi, default) -> str:
    v = f"TRY_CAST({x} AS DOUBLE)"
    return (f"CASE WHEN {v} IS NULL OR isnan({v}) OR isinf({v}) THEN CAST({float(default)} AS DOUBLE) "
            f"ELSE least(greatest({v}, CAST({float(lo)} AS DOUBLE)), CAST({float(hi)} AS DOUBLE)) END")


def sanitize_int_num(x: str, lo, hi, default) -> str:
    v = f"CAST({x} AS DOUBLE)"
    return (f"CAST(CASE WHEN {v} IS NULL OR isnan({v}) OR isinf({v}) OR abs({v}) >= 9.2e18 THEN {int(default)} "
            f"ELSE least(greatest(CAST(trunc({v}) AS BIGINT), {int(lo)}), {int(hi)}) END AS BIGINT)")


_INT_TEXT = r"^[\t\n\x{0B}\x{0C}\r ]*[+-]?[0-9]+[\t\n\x{0B}\x{0C}\r ]*$"


def sanitize_int_text(x: str, lo, hi, default) -> str:
    v = f"CASE WHEN regexp_matches({x}, {lit(_INT_TEXT)}) THEN TRY_CAST({py_strip(x)} AS BIGINT) END"
    return (f"CAST(CASE WHEN ({v}) IS NULL THEN {int(default)} "
            f"ELSE least(greatest({v}, {int(lo)}), {int(hi)}) END AS BIGINT)")


def clip_or_zero(x: str, hi: float) -> str:
    v = f"TRY_CAST({x} AS DOUBLE)"
    v = f"CASE WHEN isnan({v}) THEN NULL ELSE {v} END"
    return f"coalesce(least(greatest({v}, 0.0::DOUBLE), {float(hi)}::DOUBLE), 0.0::DOUBLE)"


def parse_mid(x: str) -> str:
    parts = f"string_split(CAST({x} AS VARCHAR), '-')"
    m = f"((TRY_CAST(({parts})[1] AS DOUBLE) + TRY_CAST(({parts})[-1] AS DOUBLE)) / 2)"
    return (f"CASE WHEN {m} IS NULL OR isnan({m}) OR isinf({m}) THEN 0.0::DOUBLE "
            f"ELSE CAST(printf('%.1f', {m}) AS DOUBLE) END")


def short_label(x: str) -> str:
    return f"regexp_replace({x}, ' \\((%|kcal/kg|g/day|kg/day)\\)', '', 'g')"


def values(rows, cols) -> str:
    def v(x):
        if x is None:
            return "NULL"
        if isinstance(x, str):
            return lit(x)
        if isinstance(x, float):
            return f"CAST({x!r} AS DOUBLE)"
        return repr(x)
    body = ",\n    ".join("(" + ", ".join(v(x) for x in r) + ")" for r in rows)
    return f"(VALUES\n    {body}) AS _v({', '.join(cols)})"


STANDARDS_LONG = ("standards_long AS (SELECT * FROM "
                  + values(R.standard_long_rows(), ["species", "stage_no", "stage", "nutrient_no", "nutrient",
                                                    "requirement"]) + ")")
BREEDS = ("breeds AS (SELECT * FROM "
          + values(R.breed_rows(), ["species", "pos", "breed", "type", "mature_weight_kg", "growth_rate",
                                    "feed_efficiency", "best_for", "recommended_cp", "market_age"]) + ")")
SPECIES_PARAMS = ("species_params AS (SELECT * FROM "
                  + values(R.SPECIES_PARAMS, ["animal", "excellent_above", "good_above", "target_weight_kg",
                                              "default_price", "market_age_unit"]) + ")")

GUIDELINES = ("guidelines AS (SELECT * FROM " + values(R.GUIDELINES, ["animal", "guideline"]) + ")")


def _rewrite_round(sql: str) -> str:
    """Rewrite every ``round(expr, n)`` into the engine-neutral half-up form
    ``(floor((expr) * 1en + 0.5) / 1en)`` (``round_even`` is left alone)."""
    out, i = [], 0
    pat = re.compile(r"(?<![A-Za-z_])round\(")
    while True:
        m = pat.search(sql, i)
        if not m:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:m.start()])
        j, depth, last_comma = m.end(), 1, None
        while depth:
            ch = sql[j]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                last_comma = j
            elif ch == "'":
                j = sql.index("'", j + 1)
            j += 1
        inner = _rewrite_round(sql[m.end():last_comma])
        nd = int(sql[last_comma + 1:j - 1].strip())
        out.append(f"(floor(({inner}) * 1e{nd} + 0.5) / 1e{nd})")
        i = j


def rnd(x: str, nd: int) -> str:
    return f"(floor(({x}) * 1e{nd} + 0.5) / 1e{nd})"
