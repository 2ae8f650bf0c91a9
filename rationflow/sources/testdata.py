"""Deterministic views over the driver's star-schema tables.

The engine's inputs (ingredient catalogs, scenario requests, user actions)
are derived from the given tables with integer arithmetic so the same
definitions can be written in DuckDB SQL (``rationflow.plans.oracle``) and
give bit-identical inputs.  Work grows with the tables: the catalog is an
aggregate over every ``part`` row, scenarios are one per ``orders`` row,
attempts one per ``events`` row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .reference_tables import ANIMALS, LIMITS, STANDARDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _i2d(c, div: int):
    """Integer -> double by exact division (identical in Spark and DuckDB)."""
    return c.cast("double") / F.lit(div)


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-level ingredient offers: one per part row (names repeat, so
    first-wins dedupe and search have real work).  species = p_type."""
    p = table(spark, sf_dir, "part")
    k, s = F.col("p_partkey"), F.col("p_size").cast("bigint")
    return p.select(
        F.col("p_type").alias("species"),
        k.alias("pos"),
        F.col("p_name").alias("ingredient"),
        F.col("p_brand").alias("brand"),
        _i2d((s * 37 + k) % 450, 10).alias("cp"),
        (1500 + (k * 7 + s * 131) % 2000).cast("double").alias("energy"),
        _i2d((k * 3 + s) % 300, 10).alias("fiber"),
        (40 + (k * 13 + s) % 960).cast("double").alias("cost"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-species ingredient catalog for the ration solver: one ingredient
    per (p_type, p_brand), nutrients aggregated over all its part rows."""
    p = table(spark, sf_dir, "part")
    k, s = F.col("p_partkey"), F.col("p_size").cast("bigint")
    g = p.groupBy(F.col("p_type").alias("species"), F.col("p_brand").alias("ingredient")).agg(
        F.sum(s).alias("_s"), F.sum(k).alias("_k"), F.count("*").alias("_n"))
    # pos: rank of the brand inside its species (file order stand-in)
    from pyspark.sql import Window
    w = Window.partitionBy("species").orderBy("ingredient")
    return g.select(
        "species",
        F.row_number().over(w).cast("bigint").alias("pos"),
        "ingredient",
        _i2d((F.col("_s") * 37 + F.col("_k")) % 450, 10).alias("cp"),
        (1500 + (F.col("_k") * 7 + F.col("_s") * 131) % 2000).cast("double").alias("energy"),
        _i2d((F.col("_k") * 3 + F.col("_s")) % 300, 10).alias("fiber"),
        (40 + (F.col("_k") * 13 + F.col("_s")) % 960).cast("double").alias("cost"),
    )


def species_list(spark: SparkSession, sf_dir: str) -> list[str]:
    """Sorted catalog species.  They key the solver's facet tables, one row
    each, so the list is a dimension of the catalog, not data."""
    r = table(spark, sf_dir, "part").agg(F.array_sort(F.collect_set("p_type")).alias("s")).first()
    return list(r["s"] or [])


def animal_of(i: int) -> str:
    return ANIMALS[i % len(ANIMALS)]


def scenarios(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """One scenario (formulation request) per order (``orders`` may be a
    streaming frame)."""
    o = orders if orders is not None else table(spark, sf_dir, "orders")
    species = species_list(spark, sf_dir)
    n = max(len(species), 1)
    n_stages = {a: sum(r[0] == a for r in STANDARDS) for a in ANIMALS}
    per_species = F.array(*[F.struct(F.lit(sp).alias("species"), F.lit(animal_of(i)).alias("animal"),
                                     F.lit(n_stages[animal_of(i)]).cast("bigint").alias("n_stages"))
                            for i, sp in enumerate(species)])
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    e_idx = ok % 120
    fiber_on = (e_idx % 4) == 0
    fmin = _i2d((ck % 15) % 8, 1)
    base = o.select(
        ok.alias("scenario_id"), ck.alias("user_id"), F.col("o_orderdate").alias("ts"),
        F.element_at(per_species, (ok % n + 1).cast("int")).alias("_sp"),
        F.expr(f"o_orderkey div {n}").alias("_turn"),
        (ck % 8).alias("breed_no"),
        (1 + ck % 120).cast("int").alias("age_weeks"),
        (10 + ck % 36).cast("double").alias("cp_req"),
        (1800 + 10 * e_idx).cast("double").alias("energy_req"),
        F.when(fiber_on, fmin).alias("fiber_min"),
        F.when(fiber_on, fmin + (6 + e_idx % 5).cast("double")).alias("fiber_max"),
        _i2d(1 + ck % 40, 20).alias("intake_kg"),
        (3 + ck % 4).cast("int").alias("max_ingredients"),
        (10 + ck % 21).cast("double").alias("side_cp"),
        (2000 + 100 * (ok % 50)).cast("double").alias("side_energy"),
        _i2d(1 + ok % 30, 20).alias("side_intake"),
        (1 + ck % 500).cast("int").alias("n_animals"),
        (1 + ok % 365).cast("int").alias("duration_days"),
        (30 + ok % 336).cast("int").alias("cycle_days"),
        # the request's own selling price, absent in a quarter of them
        F.when(ck % 4 != 0, (300 + 100 * (ok % 60)).cast("double")).alias("price"),
        (ok % 97).alias("_w"),
        (ok % 60).alias("_g"),
    )
    s = base.withColumns({"species": F.col("_sp.species"), "animal": F.col("_sp.animal"),
                          "stage_no": F.col("_turn") % F.col("_sp.n_stages")})
    cattle = F.col("animal") == "Cattle"
    return s.select(
        "scenario_id", "user_id", "ts", "species", "animal", "stage_no", "breed_no", "age_weeks",
        F.when(cattle, (50 + F.col("_w") * 4).cast("double")).otherwise(_i2d(1 + F.col("_w") % 12, 4)).alias("weight_kg"),
        "cp_req", "energy_req", "fiber_min", "fiber_max", "intake_kg", "max_ingredients",
        "side_cp", "side_energy", "side_intake", "n_animals", "duration_days", "cycle_days", "price",
        # deterministic stand-in for a predicted daily gain (g), so the
        # economics arithmetic has an oracle independent of the forest
        F.when(cattle, (300 + F.col("_g") * 10).cast("double")).otherwise(F.col("_g").cast("double")).alias("gain_g"),
    )


def report_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(report_id, user_id, ts): every request asks for a report up to 1,999
    days later, when its session may have gone on."""
    s = scenarios(spark, sf_dir)
    return s.select(F.col("scenario_id").alias("report_id"), "user_id",
                    (F.col("ts") + F.make_dt_interval((F.col("scenario_id") * 7 % 2000).cast("int"))).alias("ts"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scenario_id, predicted_gain_g): the stored predictions of the requests
    that asked for one, four in five; a stand-in with a value an oracle can
    state (the forest's own are tested by their error)."""
    s = scenarios(spark, sf_dir)
    return s.where(F.col("scenario_id") % 5 != 0).select("scenario_id", F.col("gain_g").alias("predicted_gain_g"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeding trials, one per lineitem row: the animal and targets of its
    order's request, the nutrients of its part as diet, and an observed gain."""
    li = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("trial_id"),
        F.col("l_orderkey").alias("scenario_id"), F.col("l_partkey").alias("pos"), F.col("l_suppkey"))
    req = scenarios(spark, sf_dir).select(
        "scenario_id", "animal", "breed_no", F.col("age_weeks").cast("double").alias("age_weeks"), "weight_kg",
        F.col("side_cp").alias("cp_req"), F.col("side_energy").alias("energy_req"), F.col("side_intake").alias("intake_kg"))
    diet = listing(spark, sf_dir).select("pos", F.col("cp").alias("diet_cp"), F.col("energy").alias("diet_energy"))
    gain = (F.lit(10.0) + 2 * F.col("cp_req") + F.col("energy_req") / 200 + 40 * F.col("intake_kg") + F.col("diet_cp") / 2
            + (F.col("l_suppkey") % 5).cast("double"))
    return (li.join(req, "scenario_id").join(diet, "pos").withColumn("gain_g", gain)
            .drop("scenario_id", "pos", "l_suppkey"))


def admin_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the four limited actions, in bursts: each user's events of a
    day fall into the first minutes of its first hour, so windows fill up."""
    e = table(spark, sf_dir, "events")
    names = F.array(*[F.lit(a) for a, *_ in LIMITS])
    day = F.date_trunc("month", F.col("ts").cast("timestamp_ntz"))
    ts = day + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("event_id") * 7 % 300).cast("decimal(18,6)"))
    return e.select("event_id", (F.col("user_id") % 20).alias("user_id"),
                    F.get(names, (F.col("event_id") % 5).cast("int")).alias("_a"), ts.alias("ts")).select(
        "event_id", "user_id", F.coalesce("_a", F.lit("browse")).alias("action"), "ts")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User actions for admission control: events as (user_id, action, ts)."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.col("event_type").alias("action"), F.col("ts"))


def catalog_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User edits of the catalog (as an editable grid would return them):
    names with metacharacters or blanks, numbers as text with junk, NaN and
    out-of-range values -- one row per part."""
    p = table(spark, sf_dir, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    name = (F.when(k % 50 == 0, F.lit("   "))
            .when(k % 3 == 0, F.col("p_name"))
            .otherwise(F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(") & co"))))
    return p.select(
        F.col("p_type").alias("species"), k.alias("pos"), name.alias("ingredient"),
        F.when(k % 13 == 0, F.lit("n/a")).otherwise((s * 7 - 30).cast("string")).alias("cp"),
        ((k * 7) % 12000).cast("double").alias("energy"),
        F.when(k % 11 == 0, F.lit(float("nan"))).otherwise(_i2d(s * 5, 2)).alias("fiber"),
        ((k * 131) % 150000).cast("double").alias("cost"),
    )


def range_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range strings in the standards' style ("lo-hi", single values and
    suffixed text), one per part."""
    p = table(spark, sf_dir, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    rng = F.concat(s.cast("string"), F.lit("."), (k % 10).cast("string"), F.lit("-"),
                   (s + k % 7).cast("string"), F.lit("."), (k % 3).cast("string"))
    raw = (F.when(k % 5 == 0, s.cast("string"))
           .when(k % 9 == 0, F.concat(rng, F.lit(" (point of lay)")))
           .otherwise(rng))
    return p.select(k.alias("pos"), raw.alias("raw"))
