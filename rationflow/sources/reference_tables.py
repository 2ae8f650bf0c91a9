"""Dimension tables the domain needs: breed profiles, nutrient standards,
species parameters and admission limits (A4, A5, A9, C10-C12, C18, K3, K4).

In production these are files/tables; here they ship as literal rows and are
turned into small DataFrames.  They are joined to the big scenario/event
tables (always as the small side).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the domain reference for identical results).
# ---------------------------------------------------------------------------

ANIMALS = ("Rabbit", "Poultry", "Cattle")

# Breed profiles, natural order per species:
# (species, breed, type, mature weight kg, growth rate, feed efficiency,
#  best for, recommended CP %, market age)
BREEDS = [
    ("Rabbit", "New Zealand White", "Meat", "4.5-5.5", "Fast", "Excellent", "Commercial meat production", "16-18", "10-12"),
    ("Rabbit", "Californian", "Meat", "4.0-5.0", "Fast", "Excellent", "Meat and show", "16-18", "10-12"),
    ("Rabbit", "Flemish Giant", "Meat", "6.0-10.0", "Moderate", "Good", "Large-scale meat production", "17-19", "14-16"),
    ("Rabbit", "Dutch", "Pet/Show", "2.0-2.5", "Moderate", "Good", "Pets and breeding", "15-17", "8-10"),
    ("Rabbit", "Rex", "Meat/Fur", "3.5-4.5", "Moderate", "Good", "Fur and meat", "16-18", "10-12"),
    ("Poultry", "Broiler (Cobb 500)", "Meat", "2.5-3.0", "Very Fast", "Excellent (FCR 1.6-1.8)", "Commercial meat production", "20-22", "5-6"),
    ("Poultry", "Broiler (Ross 308)", "Meat", "2.3-2.8", "Very Fast", "Excellent (FCR 1.65-1.85)", "Commercial meat production", "20-22", "5-6"),
    ("Poultry", "Layer (Isa Brown)", "Eggs", "1.8-2.0", "Moderate", "Good", "High egg production (300+ eggs/year)", "16-18", "18-20 (point of lay)"),
    ("Poultry", "Layer (Lohmann Brown)", "Eggs", "1.9-2.1", "Moderate", "Excellent", "Egg production (320+ eggs/year)", "16-18", "18-20 (point of lay)"),
    ("Poultry", "Noiler", "Dual Purpose", "2.0-2.5", "Fast", "Good", "Meat and eggs (Nigerian adapted)", "18-20", "12-16"),
    ("Poultry", "Kuroiler", "Dual Purpose", "2.5-3.5", "Moderate", "Good", "Free-range, dual purpose", "16-18", "14-18"),
    ("Poultry", "Local Nigerian", "Dual Purpose", "1.2-1.8", "Slow", "Moderate", "Free-range, disease resistant", "14-16", "20-24"),
    ("Cattle", "White Fulani", "Beef/Dairy", "300-450", "Moderate", "Good", "Milk and beef (Nigerian indigenous)", "14-16", "24-30"),
    ("Cattle", "Red Bororo", "Beef", "250-350", "Moderate", "Good", "Beef production (heat tolerant)", "13-15", "24-28"),
    ("Cattle", "Sokoto Gudali", "Beef", "350-500", "Moderate-Fast", "Good", "Beef (large frame)", "14-16", "24-30"),
    ("Cattle", "N'Dama", "Beef/Draft", "300-400", "Moderate", "Good", "Trypanosomiasis resistant", "12-14", "30-36"),
    ("Cattle", "Muturu", "Beef/Draft", "200-300", "Slow", "Moderate", "Small-holder, disease resistant", "12-14", "30-36"),
    ("Cattle", "Holstein Friesian (Cross)", "Dairy", "450-650", "Fast", "Excellent", "High milk production", "16-18", "24-28"),
    ("Cattle", "Brahman Cross", "Beef", "400-550", "Fast", "Excellent", "Beef (heat adapted)", "14-16", "20-24"),
]

# Nutrient standards, natural order: (species, stage, [(nutrient, range), ...])
_R, _P, _C = "Rabbit", "Poultry", "Cattle"
CP, EN, FI, CA, PH, LY, ME, TDN = ("Crude Protein (%)", "Energy (kcal/kg)", "Crude Fiber (%)", "Calcium (%)",
                                   "Phosphorus (%)", "Lysine (%)", "Methionine (%)", "TDN (%)")
FIG, FIK = "Feed Intake (g/day)", "Feed Intake (kg/day)"
STANDARDS = [
    (_R, "Grower (4-12 weeks)", [(CP, "16-18"), (EN, "2500-2700"), (FI, "12-16"), (CA, "0.4-0.8"), (PH, "0.3-0.5"), (LY, "0.65-0.75"), (FIG, "80-120")]),
    (_R, "Finisher (12-16 weeks)", [(CP, "14-16"), (EN, "2400-2600"), (FI, "14-18"), (CA, "0.4-0.7"), (PH, "0.3-0.5"), (LY, "0.55-0.65"), (FIG, "120-180")]),
    (_R, "Doe (Maintenance)", [(CP, "15-16"), (EN, "2500-2600"), (FI, "14-16"), (CA, "0.5-0.8"), (PH, "0.4-0.5"), (LY, "0.60-0.70"), (FIG, "100-150")]),
    (_R, "Doe (Pregnant)", [(CP, "16-18"), (EN, "2600-2800"), (FI, "12-15"), (CA, "0.8-1.2"), (PH, "0.5-0.7"), (LY, "0.70-0.80"), (FIG, "150-200")]),
    (_R, "Doe (Lactating)", [(CP, "17-19"), (EN, "2700-3000"), (FI, "12-14"), (CA, "1.0-1.5"), (PH, "0.6-0.8"), (LY, "0.75-0.90"), (FIG, "200-400")]),
    (_R, "Buck (Breeding)", [(CP, "15-17"), (EN, "2500-2700"), (FI, "14-16"), (CA, "0.5-0.8"), (PH, "0.4-0.6"), (LY, "0.65-0.75"), (FIG, "120-170")]),
    (_P, "Broiler Starter (0-3 weeks)", [(CP, "22-24"), (EN, "3000-3200"), (FI, "3-4"), (CA, "0.9-1.0"), (PH, "0.45-0.50"), (LY, "1.20-1.35"), (ME, "0.50-0.55"), (FIG, "25-35")]),
    (_P, "Broiler Grower (3-6 weeks)", [(CP, "20-22"), (EN, "3100-3300"), (FI, "3-5"), (CA, "0.85-0.95"), (PH, "0.40-0.45"), (LY, "1.05-1.20"), (ME, "0.45-0.50"), (FIG, "80-120")]),
    (_P, "Broiler Finisher (6+ weeks)", [(CP, "18-20"), (EN, "3200-3400"), (FI, "3-5"), (CA, "0.80-0.90"), (PH, "0.35-0.40"), (LY, "0.95-1.10"), (ME, "0.40-0.45"), (FIG, "140-180")]),
    (_P, "Layer Starter (0-6 weeks)", [(CP, "18-20"), (EN, "2800-3000"), (FI, "3-5"), (CA, "0.9-1.0"), (PH, "0.45-0.50"), (LY, "0.95-1.05"), (ME, "0.40-0.45"), (FIG, "20-40")]),
    (_P, "Layer Grower (6-18 weeks)", [(CP, "16-18"), (EN, "2700-2900"), (FI, "4-6"), (CA, "0.8-0.9"), (PH, "0.40-0.45"), (LY, "0.75-0.85"), (ME, "0.35-0.40"), (FIG, "60-90")]),
    (_P, "Layer Production (18+ weeks)", [(CP, "16-18"), (EN, "2750-2900"), (FI, "4-6"), (CA, "3.5-4.0"), (PH, "0.35-0.40"), (LY, "0.75-0.85"), (ME, "0.38-0.42"), (FIG, "110-130")]),
    (_C, "Calf Starter (0-3 months)", [(CP, "18-20"), (EN, "3000-3200"), (FI, "8-12"), (CA, "0.7-1.0"), (PH, "0.4-0.6"), (TDN, "72-78"), (FIK, "0.5-1.5")]),
    (_C, "Calf Grower (3-6 months)", [(CP, "16-18"), (EN, "2800-3000"), (FI, "10-15"), (CA, "0.6-0.9"), (PH, "0.35-0.50"), (TDN, "68-74"), (FIK, "2-4")]),
    (_C, "Heifer (6-12 months)", [(CP, "14-16"), (EN, "2600-2800"), (FI, "12-18"), (CA, "0.5-0.8"), (PH, "0.30-0.45"), (TDN, "65-70"), (FIK, "4-7")]),
    (_C, "Bull (Breeding)", [(CP, "12-14"), (EN, "2500-2700"), (FI, "15-20"), (CA, "0.4-0.7"), (PH, "0.25-0.40"), (TDN, "62-68"), (FIK, "8-12")]),
    (_C, "Cow (Dry)", [(CP, "10-12"), (EN, "2400-2600"), (FI, "18-25"), (CA, "0.4-0.6"), (PH, "0.25-0.35"), (TDN, "58-65"), (FIK, "10-15")]),
    (_C, "Cow (Lactating)", [(CP, "14-18"), (EN, "2700-3000"), (FI, "15-22"), (CA, "0.6-0.9"), (PH, "0.35-0.50"), (TDN, "68-75"), (FIK, "12-20")]),
    (_C, "Beef Finisher", [(CP, "12-14"), (EN, "2800-3100"), (FI, "8-15"), (CA, "0.5-0.7"), (PH, "0.30-0.45"), (TDN, "70-78"), (FIK, "8-14")]),
]

# Species parameters: (animal, rating "Excellent" if gain >, "Good" if gain >,
# target market weight kg, default selling price per kg, market-age unit)
SPECIES_PARAMS = [
    ("Rabbit", 30.0, 20.0, 2.5, 1500, "weeks"),
    ("Poultry", 50.0, 35.0, 2.0, 1200, "weeks"),
    ("Cattle", 800.0, 500.0, 300.0, 2000, "months"),
]

# Admission limits: (action, max calls, window seconds); unknown action 30/60.
LIMITS = [
    ("optimize", 10, 60),
    ("predict", 20, 60),
    ("save_db", 5, 60),
    ("report", 15, 60),
]
DEFAULT_LIMIT = (30, 60)

# Feeding guidelines shown per species (markup removed), natural order.
GUIDELINES = [
    ("Rabbit", "Rabbit Feeding Guidelines:\n"
               "• Provide fresh water at all times (rabbits drink 2–3× their feed weight)\n"
               "• Hay should make up 70–80% of adult rabbit diet\n"
               "• Introduce new feeds gradually over 7–10 days\n"
               "• Monitor body condition score regularly\n"
               "• Higher fiber content prevents digestive issues and hairballs"),
    ("Poultry", "Poultry Feeding Guidelines:\n"
                "• Layer birds require high calcium (3.5–4%) for strong eggshells\n"
                "• Grit (insoluble granite) aids digestion, especially for whole grains\n"
                "• Feed should be stored in cool, dry, rodent-proof conditions\n"
                "• Sudden feed changes can reduce performance by 10–20%\n"
                "• Water consumption is roughly 2× feed intake"),
    ("Cattle", "Cattle Feeding Guidelines:\n"
               "• TDN = Total Digestible Nutrients (energy measure for ruminants)\n"
               "• Ruminants require 15–20% fiber for proper rumen function\n"
               "• Transition periods are critical — allow 21 days minimum\n"
               "• Fresh, clean water must always be available (50–80 L/day)\n"
               "• Monitor body condition score (BCS 1–9, target: 5–6)"),
]

# Widget ranges for request intake: column -> (min, max, default); None
# default = taken from the stage (midpoint) at intake time.
INTAKE_RANGES = {
    "age_weeks": (1, 120, 8),
    "weight_kg": (0.1, 600.0, 2.0),
    "side_cp": (10.0, 30.0, 18.0),
    "side_energy": (2000.0, 12000.0, 3000.0),
    "side_intake": (0.05, 30.0, 0.5),
    "cp_req": (8.0, 35.0, None),
    "energy_req": (1500.0, 4500.0, None),
    "intake_kg": (0.01, 30.0, 0.5),
    "fiber_min": (0.0, 30.0, None),
    "fiber_max": (0.0, 40.0, None),
    "max_ingredients": (3, 15, 8),
    "n_animals": (1, 10000, 100),
    "duration_days": (1, 365, 90),
    "cycle_days": (30, 365, 90),
    "price": (500, 5000, None),
}
INT_INTAKE = ("age_weeks", "max_ingredients", "n_animals", "duration_days", "cycle_days")

# Labels
RATING_LABELS = ("Excellent", "Good", "Below Average")
MARKET_ACHIEVED = "Achieved"
NO_BREED = "— Select a breed (optional) —"
# Reference default ranges used when a stage lacks a nutrient.
DEFAULT_CP_RANGE, DEFAULT_ENERGY_RANGE, DEFAULT_FIBER_RANGE = "16-18", "2500-2700", "12-16"

# ---------------------------------------------------------------------------

BREED_SCHEMA = T.StructType([
    T.StructField("species", T.StringType(), False),
    T.StructField("pos", T.IntegerType(), False),
    T.StructField("breed", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("mature_weight_kg", T.StringType(), False),
    T.StructField("growth_rate", T.StringType(), False),
    T.StructField("feed_efficiency", T.StringType(), False),
    T.StructField("best_for", T.StringType(), False),
    T.StructField("recommended_cp", T.StringType(), False),
    T.StructField("market_age", T.StringType(), False),
])

STANDARD_SCHEMA = T.StructType([
    T.StructField("species", T.StringType(), False),
    T.StructField("stage_no", T.IntegerType(), False),
    T.StructField("stage", T.StringType(), False),
    T.StructField("nutrients", T.MapType(T.StringType(), T.StringType()), False),
    T.StructField("nutrient_order", T.ArrayType(T.StringType()), False),
])


def breed_rows() -> list[tuple]:
    out, pos = [], {}
    for sp, name, *rest in BREEDS:
        pos[sp] = pos.get(sp, 0) + 1
        out.append((sp, pos[sp], name, *rest))
    return out


def standard_rows() -> list[tuple]:
    out, pos = [], {}
    for sp, stage, nutrients in STANDARDS:
        pos[sp] = pos.get(sp, -1) + 1
        out.append((sp, pos[sp], stage, dict(nutrients), [n for n, _ in nutrients]))
    return out


def standard_long_rows() -> list[tuple]:
    """(species, stage_no, stage, nutrient_no, nutrient, raw)."""
    return [(sp, no, st, i, n, v) for sp, no, st, m, order in standard_rows()
            for i, (n, v) in enumerate((k, m[k]) for k in order)]


def breeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(breed_rows(), BREED_SCHEMA)


def standards(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(standard_rows(), STANDARD_SCHEMA)


def species_params(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        SPECIES_PARAMS,
        "animal string, excellent_above double, good_above double, target_weight_kg double, "
        "default_price int, market_age_unit string")


def limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LIMITS, "action string, max_calls int, window_seconds int")


def guidelines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GUIDELINES, "animal string, guideline string")
