"""Nutrient standards and breed profiles as joinable dimensions
(A4, A5, C12-C16, C18, D2-D4, E5, H1, H3, H4, I7, I10, I11)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import parse_mid
from ..sources import reference_tables as R

# wide column name for every nutrient key (fixed values)
WIDE_NAMES = {
    R.CP: "crude_protein", R.EN: "energy", R.FI: "crude_fiber", R.CA: "calcium", R.PH: "phosphorus",
    R.LY: "lysine", R.ME: "methionine", R.TDN: "tdn", R.FIG: "feed_intake_g_day", R.FIK: "feed_intake_kg_day",
}


def short_label(c) -> F.Column:
    """Strip the unit suffix from a nutrient name."""
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(col, r" \((%|kcal/kg|g/day|kg/day)\)", "")


def standards_long(spark: SparkSession) -> DataFrame:
    """A5 + C14: one row per (species, stage, nutrient) via ``explode`` of
    the map column, keeping the natural nutrient order."""
    s = R.standards(spark)
    return s.select(
        "species", "stage_no", "stage",
        F.posexplode("nutrient_order").alias("nutrient_no", "nutrient"),
        "nutrients",
    ).select("species", "stage_no", "stage", F.col("nutrient_no").cast("int").alias("nutrient_no"),
             "nutrient", F.element_at("nutrients", F.col("nutrient")).alias("requirement"))


def standards_wide(spark: SparkSession) -> DataFrame:
    """H1/H4: per species, stage rows with one column per nutrient; species
    with different key sets are stacked by name (missing -> null)."""
    s = R.standards(spark)
    frames = []
    for sp in R.ANIMALS:
        keys = [n for sp2, _, ns in R.STANDARDS if sp2 == sp for n, _ in ns]
        keys = list(dict.fromkeys(keys))
        frames.append(s.where(F.col("species") == sp).select(
            "species", "stage_no", "stage",
            *[F.element_at("nutrients", F.lit(k)).alias(WIDE_NAMES[k]) for k in keys]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def stage_targets(spark: SparkSession) -> DataFrame:
    """D3 + C13 + I7 + I10 + I11: default optimiser targets per stage --
    midpoints of CP / energy / fibre (reference fallbacks when a key is
    absent), energy capped at 4500, fibre band max(0, mid-2) .. mid+4."""
    s = R.standards(spark)

    def get(key, default):
        return F.coalesce(F.element_at("nutrients", F.lit(key)), F.lit(default))

    cp = parse_mid(get(R.CP, R.DEFAULT_CP_RANGE))
    en = parse_mid(get(R.EN, R.DEFAULT_ENERGY_RANGE))
    fi = parse_mid(get(R.FI, R.DEFAULT_FIBER_RANGE))
    return s.select(
        "species", "stage_no", "stage",
        cp.alias("cp_target"),
        en.alias("energy_mid"),
        F.least(en, F.lit(4500.0)).alias("energy_target"),
        fi.alias("fiber_mid"),
        F.greatest(F.lit(0.0), fi - 2).alias("fiber_min_default"),
        (fi + 4).alias("fiber_max_default"),
    )


def breeds_with_ranges(spark: SparkSession) -> DataFrame:
    """A4 + C12: breed profiles with the market-age unit by species and a
    parsed recommended-CP midpoint."""
    b = R.breeds(spark)
    unit = F.when(F.col("species") == "Cattle", F.lit("months")).otherwise(F.lit("weeks"))
    return b.withColumns({
        "market_age_unit": unit,
        "recommended_cp_mid": parse_mid("recommended_cp"),
        "mature_weight_mid": parse_mid("mature_weight_kg"),
    })


def value_counts(df: DataFrame, keys, column: str) -> DataFrame:
    """E5: counts per value, descending (order applied by the caller)."""
    return df.groupBy(*keys, column).agg(F.count("*").alias("n"))


def clamp_requests(scenarios: DataFrame, targets: DataFrame) -> DataFrame:
    """Request intake -- every widget value clamped to its range with the
    reference defaults; optimiser targets default to the stage midpoints
    (``targets`` from :func:`stage_targets`, keyed by animal/stage_no)."""
    from ..functions.sanitize import sanitize_int, sanitize_numeric
    t = targets.select(F.col("species").alias("_t_animal"), F.col("stage_no").alias("_t_stage"),
                       "cp_target", "energy_mid", "fiber_min_default", "fiber_max_default")
    price = F.create_map(*[F.lit(v) for r in R.SPECIES_PARAMS for v in (r[0], float(r[4]))])
    scenarios = scenarios.withColumn("_price_default", F.element_at(price, F.col("animal")))
    j = scenarios.join(t, (F.col("animal") == F.col("_t_animal")) &
                       (F.col("stage_no") == F.col("_t_stage")), "left")
    stage_default = {"cp_req": "cp_target", "energy_req": "energy_mid",
                     "fiber_min": "fiber_min_default", "fiber_max": "fiber_max_default", "price": "_price_default"}
    out = {}
    for c, (lo, hi, d) in R.INTAKE_RANGES.items():
        if c in R.INT_INTAKE:
            out[c] = sanitize_int(c, lo, hi, d).cast("int")
        elif d is None:
            v = F.col(c).try_cast("double")
            bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
            out[c] = F.when(bad, F.col(stage_default[c])).otherwise(
                F.least(F.greatest(v, F.lit(float(lo))), F.lit(float(hi))))
        else:
            out[c] = sanitize_numeric(c, lo, hi, d)
    # fibre bounds stay null when the fibre constraint is off
    for c in ("fiber_min", "fiber_max"):
        out[c] = F.when(F.col(c).isNotNull(), out[c])
    out["price"] = out["price"].cast("int")
    return j.withColumns(out).drop("_price_default", "_t_animal", "_t_stage", "cp_target", "energy_mid",
                                   "fiber_min_default", "fiber_max_default")
