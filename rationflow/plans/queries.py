"""Registered queries: ``(spark, sf_dir) -> DataFrame``.

Each query reads the driver's tables through ``sources.testdata`` and runs
one of the engine's operators over the whole input.  Column names match the
SQL oracles in ``plans.oracle`` one for one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sanitize as S
from ..functions.numbers import fixed, parse_mid, rnd
from ..operators import catalog as C
from ..operators import economics as EC
from ..operators import guides as G
from ..operators import history as H
from ..operators import admission as A
from ..operators import facets, ration
from ..operators import search as SE
from ..session import new_table, write_table
from ..sources import reference_tables as R
from ..sources import testdata as td

# Query parameters (fixed values of the registered queries).
SEARCH_REGEX_TERM = "RED (gear|bolt)"
SUMMARY_TERM = "gear"
SORT_BY = "Cost"
TYPE_TERMS = ["All", "Meat", "Beef", "Dual Purpose", "Eggs"]
# Search requests: (mode, what surrounds a piece of a name)
SEARCH_SHAPES = [("literal", "", ""), ("regex", "^", ""), ("literal", " ", "  "), ("regex", "", "|red.*t$"),
                 ("regex", "", "[a-m].?"), ("literal", "(", ")"), ("regex", ".*", "e?r")]
BREED_TERMS = ["", "broiler", "LAYER", "cross", "N'Dama", "white", "an (x)"]
REPORT_TIME = "2026-01-01 00:00:00"
REPORT_DATE = "20260101"
# Admission limits for the driver's event types: (action, max calls, window s)
EVENT_LIMITS = [("view", 2, 7 * 86_400), ("click", 2, 7 * 86_400), ("purchase", 1, 7 * 86_400),
                ("signup", 1, 7 * 86_400)]


def facets_for(spark: SparkSession, sf_dir: str) -> facets.Facets:
    """Facets of the catalog as it is now: kept in the shared folder by the
    content of each species, worked out when that content is new."""
    from ..session import ensure_checkpoint_dir
    return facets.of_catalog(td.catalog(spark, sf_dir), f"{ensure_checkpoint_dir(spark).rstrip('/')}/facets")


def _solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    sc = td.scenarios(spark, sf_dir)
    return ration.with_totals(ration.solve(sc, facets_for(spark, sf_dir)))


def q_ration_min_cost(spark, sf_dir):
    s = _solved(spark, sf_dir)
    return s.select("scenario_id", "species", "status",
                    rnd("total_cost", 4).alias("total_cost"),
                    F.col("n_ingredients").cast("int").alias("n_ingredients"),
                    rnd("total_cp", 4).alias("total_cp"),
                    rnd("total_energy", 4).alias("total_energy"))


def q_ration_fiber_band(spark, sf_dir):
    s = _solved(spark, sf_dir)
    kept = F.filter("formula", lambda r: r["x"] > ration.KEEP_THRESHOLD)
    fib = F.aggregate(kept, F.lit(0.0), lambda acc, r: acc + r["fiber"] * r["x"])
    return s.select("scenario_id", "fiber_min", "fiber_max", "status",
                    rnd("total_cost", 4).alias("total_cost"),
                    rnd(F.when(F.col("status") == "optimal", fib), 4).alias("total_fiber"))


def q_ration_infeasible(spark, sf_dir):
    s = _solved(spark, sf_dir)
    return s.groupBy("species", "status").agg(
        F.count("*").cast("bigint").alias("n_scenarios"),
        rnd(F.min("total_cost"), 4).alias("min_cost"),
        rnd(F.max("total_cost"), 4).alias("max_cost"))


def q_formula_rows(spark, sf_dir):
    s = _solved(spark, sf_dir)
    r = ration.formula_rows(s, ["scenario_id"])
    return r.select("scenario_id", "pos", "ingredient",
                    rnd("proportion", 6).alias("proportion"), "proportion_pct", "unit_cost",
                    "cost_contribution",
                    rnd("cp_contribution", 4).alias("cp_contribution"),
                    rnd("energy_contribution", 4).alias("energy_contribution"))


def q_nutrient_achievement(spark, sf_dir):
    s = _solved(spark, sf_dir)
    return s.select("scenario_id", "status",
                    rnd("cp_pct", 4).alias("cp_pct"), rnd("energy_pct", 4).alias("energy_pct"),
                    rnd("daily_cost", 4).alias("daily_cost"),
                    rnd("monthly_cost", 4).alias("monthly_cost"))


def q_ingredient_count_flag(spark, sf_dir):
    s = _solved(spark, sf_dir)
    return s.select("scenario_id", "max_ingredients", F.col("n_ingredients").cast("int").alias("n_ingredients"),
                    "over_limit")


def q_top5_cost(spark, sf_dir):
    """Top 5 cost contributors per scenario, ranked inside the row's own
    (<= 4 element) formula array -- no window, no shuffle."""
    r = ration.ranked_formula(_solved(spark, sf_dir), ["scenario_id"])
    return r.where("rank <= 5").select("scenario_id", "rank", "ingredient", "cost_contribution")


def q_cost_share(spark, sf_dir):
    """Shares of the scenario total, totals taken over the row's own
    formula array (no window over scenario partitions)."""
    r = ration.ranked_formula(_solved(spark, sf_dir), ["scenario_id"])
    return r.select("scenario_id", "ingredient",
                    rnd(F.col("cost_contribution") / F.col("_cc_total"), 6).alias("cost_share"),
                    rnd(F.col("proportion_pct") / F.col("_pct_total"), 6).alias("mass_share"))


# --------------------------------------------------------------- scalars
def q_sanitize_text(spark, sf_dir):
    d = td.table(spark, sf_dir, "documents")
    # the whole text is sanitised once; truncation is the last step, so the
    # 200-char value is a prefix of the full result
    full = d.select("doc_id", S.sanitize_text("text", None).alias("_full"))
    return full.select("doc_id", F.substring("_full", 1, 200).alias("clean"),
                       F.length("_full").cast("bigint").alias("clean_chars"))


def q_sanitize_numeric(spark, sf_dir):
    e = td.table(spark, sf_dir, "events")
    k_txt = F.regexp_extract("props", r'"k": (-?[0-9.]+)', 1)
    return e.select("event_id",
                    S.sanitize_numeric("value", 10, 30, 18).alias("v_num"),
                    S.sanitize_int("value", 1, 100, 7).alias("v_int"),
                    S.sanitize_numeric("props", 0, 100, -1).alias("props_num"),
                    S.sanitize_int(k_txt, 1, 50, 7, "string").alias("k_int"))


def q_sanitize_catalog(spark, sf_dir):
    return S.clean_catalog(td.catalog_edits(spark, sf_dir)).select(
        "species", "pos", "ingredient", "cp", "energy", "fiber", "cost")


def q_range_midpoint(spark, sf_dir):
    return td.range_texts(spark, sf_dir).select("pos", "raw", parse_mid("raw").alias("mid"))


# ---------------------------------------------------------------- guides
def _scen_small(spark, sf_dir):
    return td.scenarios(spark, sf_dir).select("scenario_id", "user_id", "animal", "stage_no", "breed_no")


def q_standards_unpivot(spark, sf_dir):
    sc = _scen_small(spark, sf_dir)
    lg = G.standards_long(spark).withColumnRenamed("species", "animal")
    j = sc.join(F.broadcast(lg), ["animal", "stage_no"])
    return j.select("scenario_id", "nutrient_no", "nutrient", G.short_label("nutrient").alias("short_label"),
                    "requirement")


def q_standards_union(spark, sf_dir):
    sc = _scen_small(spark, sf_dir)
    wide = G.standards_wide(spark).withColumnRenamed("species", "animal")
    j = sc.join(F.broadcast(wide), ["animal", "stage_no"])
    return j.select("scenario_id", "stage", *G.WIDE_NAMES.values())


def q_stage_targets_join(spark, sf_dir):
    sc = _scen_small(spark, sf_dir)
    t = G.stage_targets(spark).withColumnRenamed("species", "animal")
    j = sc.join(F.broadcast(t), ["animal", "stage_no"])
    return j.select("scenario_id", "stage", "cp_target", "energy_target", "fiber_min_default",
                    "fiber_max_default")


def _breeds_b(spark):
    return G.breeds_with_ranges(spark).withColumnRenamed("species", "animal")


def q_breed_profile_lookup(spark, sf_dir):
    sc = _scen_small(spark, sf_dir)
    b = _breeds_b(spark).withColumnRenamed("pos", "breed_no")
    j = sc.join(F.broadcast(b), ["animal", "breed_no"], "left")
    return j.select("scenario_id", "breed", "type", "recommended_cp", "recommended_cp_mid", "market_age",
                    F.when(F.col("breed").isNotNull(), F.col("market_age_unit")).alias("market_age_unit"))


def q_breed_semi_join(spark, sf_dir):
    sc = _scen_small(spark, sf_dir)
    b = _breeds_b(spark).select("animal", F.col("pos").alias("breed_no"))
    return sc.join(F.broadcast(b), ["animal", "breed_no"], "left_semi").select("scenario_id", "animal", "breed_no")


def q_breed_anti_join(spark, sf_dir):
    sc = _scen_small(spark, sf_dir)
    b = _breeds_b(spark).select("animal", F.col("pos").alias("breed_no"))
    return sc.join(F.broadcast(b), ["animal", "breed_no"], "left_anti").select("scenario_id", "animal", "breed_no")


def _scen_breeds(spark, sf_dir):
    sc = _scen_small(spark, sf_dir)
    b = _breeds_b(spark).withColumnRenamed("pos", "breed_no")
    return sc.join(F.broadcast(b), ["animal", "breed_no"])


def q_type_counts(spark, sf_dir):
    return G.value_counts(_scen_breeds(spark, sf_dir), ["animal"], "type").select(
        "animal", "type", F.col("n").cast("bigint").alias("n"))


def q_growth_rate_counts(spark, sf_dir):
    return G.value_counts(_scen_breeds(spark, sf_dir), ["animal"], "growth_rate").select(
        "animal", "growth_rate", F.col("n").cast("bigint").alias("n"))


def q_distinct_types(spark, sf_dir):
    return C.sorted_distinct(_scen_breeds(spark, sf_dir), "type", keys=("animal",))


def _term(options, key_col):
    arr = F.array(*[F.lit(t) for t in options])
    return F.element_at(arr, (F.col(key_col) % len(options) + 1).cast("int"))


def q_type_filter_all(spark, sf_dir):
    sc = _scen_small(spark, sf_dir).withColumn("term", _term(TYPE_TERMS, "user_id"))
    b = _breeds_b(spark).select("animal", "breed", "type")
    j = sc.join(F.broadcast(b), "animal")
    return C.type_filter(j, F.col("term")).select("scenario_id", "breed")


def q_breed_search_literal(spark, sf_dir):
    sc = _scen_small(spark, sf_dir).withColumn("term", _term(BREED_TERMS, "user_id"))
    b = _breeds_b(spark).select("animal", "breed")
    j = sc.join(F.broadcast(b), "animal")
    return C.search_literal(j, "breed", F.col("term")).select("scenario_id", "breed")


# --------------------------------------------------------------- catalog
def q_catalog_search_regex(spark, sf_dir):
    return C.search_regex(td.listing(spark, sf_dir), "ingredient", SEARCH_REGEX_TERM).select(
        "species", "pos", "ingredient", "cost")


def q_catalog_sort(spark, sf_dir):
    return C.sort_catalog(td.listing(spark, sf_dir), SORT_BY).select("species", "pos", "ingredient", "cost")


def q_catalog_summary(spark, sf_dir):
    f = C.search_literal(td.listing(spark, sf_dir), "ingredient", SUMMARY_TERM)
    return C.summary(f).select("species", F.col("n_ingredients").cast("bigint").alias("n_ingredients"),
                               *[rnd(c, 6).alias(c) for c in ("avg_cost", "avg_cp", "avg_energy")])


def q_first_per_key(spark, sf_dir):
    return C.first_per_key(td.listing(spark, sf_dir)).select(
        "species", "ingredient", "pos", "brand", "cp", "energy", "fiber", "cost")


def q_catalog_merge(spark, sf_dir):
    base = C.first_per_key(td.listing(spark, sf_dir)).select(
        "species", "ingredient", "pos", "cp", "energy", "fiber", "cost")
    m = C.merge_catalog(base, td.catalog_edits(spark, sf_dir))
    return m.select("species", "ingredient", "pos", "cp", "energy", "fiber", "cost", "source")


# ------------------------------------------------------------- economics
def _econ(spark, sf_dir):
    s = _solved(spark, sf_dir).select(
        "scenario_id", "user_id", "ts", "animal", "weight_kg", "side_intake", "gain_g", "n_animals",
        "duration_days", "cycle_days", "price", "total_cost", "status")
    s = EC.with_species_params(s)
    return EC.cost_projection(s)


def _r4(*cols):
    return [rnd(c, 4).alias(c) for c in cols]


def q_cost_projection(spark, sf_dir):
    e = _econ(spark, sf_dir)
    return e.select("scenario_id", *_r4("daily_cost", "weekly_cost", "monthly_cost", "yearly_cost"))


def q_herd_cost(spark, sf_dir):
    e = EC.herd_cost(_econ(spark, sf_dir))
    return e.select("scenario_id", *_r4("herd_total_cost", "cost_per_animal", "daily_herd_cost"))


def q_roi(spark, sf_dir):
    e = EC.roi(_econ(spark, sf_dir), price="price")
    return e.select("scenario_id", "price_per_kg",
                    *_r4("feed_cost", "final_weight_kg", "revenue", "profit", "roi_pct"), "verdict")


def q_roi_shares(spark, sf_dir):
    e = EC.roi(_econ(spark, sf_dir), price="price")
    return e.select("scenario_id", rnd("feed_share", 6).alias("feed_share"),
                    rnd("profit_share", 6).alias("profit_share"))


def q_fcr_rating(spark, sf_dir):
    e = EC.growth_metrics(_econ(spark, sf_dir))
    return e.select("scenario_id", rnd("fcr", 4).alias("fcr"), "rating")


def q_days_to_market(spark, sf_dir):
    e = EC.growth_metrics(_econ(spark, sf_dir))
    return e.select("scenario_id", "days_to_market", "market_label", "unreachable")


def q_growth_metrics(spark, sf_dir):
    e = EC.cost_per_kg_gain(EC.growth_metrics(_econ(spark, sf_dir)))
    return e.select("scenario_id", *_r4("weekly_gain_g", "monthly_gain_kg", "weight_90d_kg", "cost_per_kg_gain"))


def q_growth_series(spark, sf_dir):
    sc = td.scenarios(spark, sf_dir).select("scenario_id", "gain_g", "weight_kg")
    g = EC.growth_series(sc, ["scenario_id"])
    return g.select("scenario_id", "day", rnd("projected_weight_kg", 6).alias("projected_weight_kg"))


# ---------------------------------------------------------- history/report
def q_history_last3(spark, sf_dir):
    """the entries the history list shows, with the animal's age and weight
    and the targets of the request."""
    shown = ("animal", "age_weeks", "weight_kg", "cp_req", "energy_req")
    s = _solved(spark, sf_dir).where(F.col("status") == "optimal").select("user_id", "scenario_id", "ts", "total_cost", *shown)
    r = H.last_n_per_key(s, "user_id", [F.desc("ts"), F.desc("scenario_id")], row_id="scenario_id", n=3)
    return r.select("user_id", "scenario_id", F.col("recent_rank").cast("int").alias("recent_rank"),
                    F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts_text"),
                    rnd("total_cost", 4).alias("total_cost"), *shown)


def q_report_text(spark, sf_dir):
    s = EC.with_predictions(_solved(spark, sf_dir), td.predictions(spark, sf_dir))
    return H.report_text(s, REPORT_TIME, REPORT_DATE, prediction="predicted_gain_g")


def q_prediction_economics(spark, sf_dir):
    """D5 + J9-J18: the stored prediction of each request drives its growth
    metrics, cost per kg of gain and return, with the request's own price."""
    e = _econ(spark, sf_dir).drop("gain_g")
    e = EC.with_predictions(e, td.predictions(spark, sf_dir))
    g = "predicted_gain_g"
    e = EC.roi(EC.cost_per_kg_gain(EC.growth_metrics(e, gain=g), gain=g), gain=g, price="price")
    return e.select("scenario_id", g, *_r4("fcr", "weekly_gain_g", "monthly_gain_kg", "weight_90d_kg", "cost_per_kg_gain",
                                           "revenue", "profit", "roi_pct"),
                    F.when(F.col(g).isNotNull(), F.col("rating")).alias("rating"), "days_to_market", "price_per_kg")


def q_money_text(spark, sf_dir):
    """The figures as the pages print them."""
    e = EC.with_predictions(_econ(spark, sf_dir).where("status = 'optimal'"), td.predictions(spark, sf_dir))
    e = EC.roi(EC.growth_metrics(e, gain="predicted_gain_g"), gain="predicted_gain_g", price="price")
    return e.select("scenario_id", fixed("daily_cost", 2).alias("daily"), fixed("yearly_cost", 2, True).alias("yearly"),
                    fixed("predicted_gain_g", 1).alias("gain"), fixed("weekly_gain_g", 0).alias("weekly"),
                    F.concat(fixed("fcr", 2), F.lit(":1")).alias("fcr"), fixed("revenue", 2, True).alias("revenue"),
                    F.concat(fixed("roi_pct", 1), F.lit("% ROI")).alias("roi"))


def q_scenario_intake(spark, sf_dir):
    """Every request's widget values clamped, stage defaults filled."""
    sc = td.scenarios(spark, sf_dir)
    c = G.clamp_requests(sc, G.stage_targets(spark))
    return c.select("scenario_id", *R.INTAKE_RANGES.keys())


def q_feeding_guidelines(spark, sf_dir):
    """Guideline text per request via an equi join to the 3-row table."""
    sc = _scen_small(spark, sf_dir)
    return sc.join(F.broadcast(R.guidelines(spark)), "animal").select("scenario_id", "guideline")


def q_diet_means(spark, sf_dir):
    """Catalog means per species (sanitised) attached to each request."""
    from ..operators.growth import diet_means
    sc = td.scenarios(spark, sf_dir).select("scenario_id", "species")
    dm = diet_means(td.catalog(spark, sf_dir))
    return sc.join(dm, "species").select(
        "scenario_id", rnd("diet_cp", 6).alias("diet_cp"), rnd("diet_energy", 6).alias("diet_energy"))


def q_breed_options(spark, sf_dir):
    """H2 + E6: breed picker per animal in request traffic: sentinel first,
    then breeds in natural order (one small array per animal)."""
    sc = _scen_small(spark, sf_dir).select("animal").distinct()
    b = _breeds_b(spark).select("animal", "pos", "breed")
    j = sc.join(F.broadcast(b), "animal")
    arr = F.transform(F.array_sort(F.collect_list(F.struct("pos", "breed"))), lambda x: x["breed"])
    return j.groupBy("animal").agg(
        F.array_join(F.concat(F.array(F.lit(R.NO_BREED)), arr), "|").alias("breed_options"))


# ------------------------------------------------------------- admission
def _event_limits(spark):
    return spark.createDataFrame(EVENT_LIMITS, "action string, max_calls int, window_seconds int")


def q_rate_limit_attempts(spark, sf_dir):
    a = td.attempts(spark, sf_dir)
    c = A.trailing_counts(a, {"attempts_60s": 60 * A.US, "attempts_1d": 86_400 * A.US})
    return c.select("event_id", "user_id", "action",
                    F.col("attempts_60s").cast("bigint").alias("attempts_60s"),
                    F.col("attempts_1d").cast("bigint").alias("attempts_1d"))


def q_rate_limit_exact(spark, sf_dir):
    a = td.attempts(spark, sf_dir)
    return A.admit(a, _event_limits(spark)).select("event_id", "user_id", "action", "admitted", "wait_s")


def q_rate_limit_stream(spark, sf_dir):
    from ..streaming.admission import run_available
    schema = td.table(spark, sf_dir, "events").schema
    out = run_available(spark, f"{sf_dir.rstrip('/')}/events.parquet", schema, _event_limits(spark))
    return out.select("event_id", "user_id", "action", "admitted", "wait_s", "late")


def q_rate_limit_late(spark, sf_dir):
    """The events as a stream, delivered once more when all are decided: the
    second delivery is behind the watermark and comes back as late."""
    from ..streaming.admission import run_available
    events = td.table(spark, sf_dir, "events")
    out = run_available(spark, f"{sf_dir.rstrip('/')}/events.parquet", events.schema, _event_limits(spark), later=events)
    return out.select("event_id", "user_id", "action", "admitted", "wait_s", "late")


def q_history_stream(spark, sf_dir):
    from ..streaming.admission import stream_table
    from ..streaming.history import history_stream
    schema = td.table(spark, sf_dir, "orders").schema
    orders = stream_table(spark, f"{sf_dir.rstrip('/')}/orders.parquet", schema)
    requests = td.scenarios(spark, sf_dir, orders=orders)
    hist, _ = history_stream(spark, requests, facets_for(spark, sf_dir))
    return hist.select("scenario_id", "user_id", "status", rnd("total_cost", 4).alias("total_cost"))


# ----------------------------------------------------------- growth model
def _features(spark, sf_dir):
    from ..operators.growth import diet_means
    sc = td.scenarios(spark, sf_dir)
    dm = diet_means(td.catalog(spark, sf_dir))
    # a row a species: a shuffle would deal all requests to as many tasks as there are species
    return sc.join(F.broadcast(dm), "species").select(
        "scenario_id", "user_id", "species", "stage_no", "breed_no", "gain_g", F.col("age_weeks").cast("double").alias("age_weeks"),
        "weight_kg", F.col("side_cp").alias("cp_req"), F.col("side_energy").alias("energy_req"),
        F.col("side_intake").alias("intake_kg"), "diet_cp", "diet_energy")


def q_gain_features(spark, sf_dir):
    """J7's training rows: every trial with its features and observed gain."""
    from ..operators.growth import FEATURES
    return td.trials(spark, sf_dir).select("trial_id", *[rnd(c, 4).alias(c) for c in (*FEATURES, "gain_g")])


#: The forest of the registered queries is smaller than the operator's
#: defaults (200 trees, depth 30, 128 bins); README has the times and errors.
GAIN_FOREST = {"num_trees": 40, "max_depth": 8, "max_bins": 64}


def _forest(spark, sf_dir):
    """(model fitted without the held-out fifth of the trials, that fifth)."""
    from ..operators.growth import model_of, split_trials
    from ..session import ensure_checkpoint_dir
    train, test = split_trials(write_table(td.trials(spark, sf_dir), "trials"))
    return model_of(train, f"{ensure_checkpoint_dir(spark).rstrip('/')}/models", **GAIN_FOREST), test


def q_gain_forest(spark, sf_dir):
    """J7 + J8: the predicted daily gain of every request, by the forest fitted
    on the trials and loaded from where it was saved."""
    from ..operators.growth import predict_gain
    model, _ = _forest(spark, sf_dir)
    return predict_gain(model, _features(spark, sf_dir)).select("scenario_id", "predicted_gain_g")


def _session_reports(spark, sf_dir, predictions, *columns):
    """Every request asks for a report some days later; it takes what its
    user's session holds then, of a formula the ``columns``."""
    from ..operators import asof
    formulas = _solved(spark, sf_dir).where("status = 'optimal'").select("user_id", "ts", "scenario_id", *columns)
    asked = td.report_requests(spark, sf_dir)
    return asof.latest(asked, {"formula": formulas, "prediction": predictions}, key="user_id")


def q_session_report(spark, sf_dir):
    """Which formula and which prediction a report shows."""
    pred = td.scenarios(spark, sf_dir).where("scenario_id % 5 <> 0").select("user_id", "ts", "scenario_id")
    s = _session_reports(spark, sf_dir, pred, "total_cost")
    return s.select("report_id", "user_id", F.col("formula.scenario_id").alias("formula_id"),
                    rnd("formula.total_cost", 4).alias("total_cost"), F.col("prediction.scenario_id").alias("prediction_id"))


def q_session_economics(spark, sf_dir):
    """D5 + J8-J14 + I14: the report's text and the figures of its session's
    formula under the forest's prediction of that session."""
    from ..operators.growth import predict_gain
    model, _ = _forest(spark, sf_dir)
    feats = _features(spark, sf_dir).join(td.scenarios(spark, sf_dir).select("scenario_id", "ts"), "scenario_id")
    pred = write_table(predict_gain(model, feats.where("scenario_id % 5 <> 0"))
                       .select("user_id", "ts", "scenario_id", "predicted_gain_g"), "predictions")
    shown = ("status", "animal", "age_weeks", "weight_kg", "cp_req", "energy_req", "total_cost", "intake_kg", "side_intake", "formula")
    s = _session_reports(spark, sf_dir, pred, *shown).where("formula IS NOT NULL").select(
        "report_id", "formula.*", F.col("prediction.predicted_gain_g").alias("predicted_gain_g"))
    s = write_table(s, "sessions")  # the text and the figures are of the same rows
    g = "predicted_gain_g"
    text = H.report_text(s.drop("scenario_id").withColumnRenamed("report_id", "scenario_id"), REPORT_TIME, prediction=g)
    e = EC.cost_per_kg_gain(EC.growth_metrics(EC.with_species_params(s), gain=g), gain=g)
    figures = e.select("report_id", F.col("scenario_id").alias("formula_id"), g, "weekly_gain_g", "weight_90d_kg", "fcr", "cost_per_kg_gain",
                       F.when(F.col(g).isNotNull(), F.col("rating")).alias("rating"))
    return figures.join(text.select(F.col("scenario_id").alias("report_id"), "report"), "report_id")


# ----------------------------------------------------------- files & sinks
def q_quarantine_ingest(spark, sf_dir):
    """A3: a CSV export of the listing where some energy fields are junk,
    re-ingested with PERMISSIVE parsing; junk lines are quarantined."""
    from ..sources.files import CATALOG_CSV_SCHEMA, quarantine_csv
    lst = td.listing(spark, sf_dir)
    energy_txt = F.when(F.col("pos") % 7 == 0, F.lit("n/a")).otherwise(F.col("energy").cast("string"))
    path = new_table(spark, "quarantine")
    lst.select(F.col("ingredient").alias("Ingredient"), F.col("cp").cast("string").alias("CP"),
               energy_txt.alias("Energy"), F.col("fiber").cast("string").alias("Fiber"),
               F.col("cost").cast("string").alias("Cost")) \
        .write.option("header", True).csv(path)
    good, bad = quarantine_csv(spark, path, CATALOG_CSV_SCHEMA)
    g = good.select(F.col("Ingredient").alias("ingredient"), F.col("Energy").alias("energy"),
                    F.lit(False).alias("quarantined"))
    b = bad.select(F.split("_corrupt_record", ",").getItem(0).alias("ingredient"),
                   F.lit(None).cast("double").alias("energy"), F.lit(True).alias("quarantined"))
    return g.unionByName(b)


def q_catalog_csv_roundtrip(spark, sf_dir):
    """B5 + A1: sanitised catalog exported as species-partitioned CSV and
    read back with a declared schema."""
    from ..sinks.writers import export_catalog_csv
    path = new_table(spark, "catalog_csv")
    export_catalog_csv(td.catalog_edits(spark, sf_dir), path)
    schema = "pos long, ingredient string, cp double, energy double, fiber double, cost double, species string"
    back = (spark.read.schema(schema).option("header", True).option("basePath", path).csv(path))
    return back.select("species", "pos", "ingredient", "cp", "energy", "fiber", "cost")


def q_catalog_csv_read(spark, sf_dir):
    """A1 + H4: one CSV file set per species, read back under one schema with
    the file order; a row's place is where the sorted write put it."""
    from ..sources.files import read_catalogs
    lst, path = td.listing(spark, sf_dir), new_table(spark, "catalog_files")
    (lst.select("species", F.col("ingredient").alias("Ingredient"), F.col("cp").alias("CP"), F.col("energy").alias("Energy"),
                F.col("fiber").alias("Fiber"), F.col("cost").alias("Cost"), "pos")
     .repartition("species").sortWithinPartitions("species", "pos").drop("pos")
     .write.partitionBy("species").option("header", True).csv(path))
    paths = {sp: f"{path}/species={sp}" for sp in td.species_list(spark, sf_dir)}
    return read_catalogs(spark, paths).select("species", "pos", "ingredient", "cp", "energy", "fiber", "cost")


def q_trials_csv_read(spark, sf_dir):
    """A2: the trials as the training file has them, read back with its schema."""
    from ..sources.files import TRIAL_RENAMES, read_trials_csv
    t, path = td.trials(spark, sf_dir), new_table(spark, "trials_csv")
    back = {v: k for k, v in TRIAL_RENAMES.items()}
    named = t.select(F.col("animal").alias("animal_type"), F.col("breed_no").cast("string").alias("breed"),
                     F.col("age_weeks").cast("int").alias("age_weeks"), F.col("weight_kg").alias("body_weight_kg"),
                     F.col("cp_req").alias("cp_requirement_pct"), F.col("energy_req").alias("energy_requirement_kcal"),
                     F.col("intake_kg").alias("feed_intake_kg"), F.col("diet_cp").alias("ingredient_cp_pct"),
                     F.col("diet_energy").alias("ingredient_energy"), F.col("gain_g").alias("expected_daily_gain_g"))
    named.withColumnsRenamed(back).write.option("header", True).csv(path)
    return read_trials_csv(spark, path)


def q_species_route(spark, sf_dir):
    """The catalog partitioned by species; one species' rows come from its
    own folder alone."""
    from ..sources.files import for_species
    path = new_table(spark, "by_species")
    td.listing(spark, sf_dir).write.partitionBy("species").parquet(path)
    return for_species(spark.read.parquet(path), td.species_list(spark, sf_dir)[0]).select("species", "pos", "ingredient", "cost")


def q_species_requests(spark, sf_dir):
    """A6 for all requests: offers and least cost of each request's catalog,
    read from the folders of the species that are asked for."""
    path = new_table(spark, "by_species")
    td.listing(spark, sf_dir).write.partitionBy("species").parquet(path)
    sc = td.scenarios(spark, sf_dir).select("scenario_id", "species")
    seen = SE.route(sc, spark.read.parquet(path)).groupBy("species").agg(
        F.count("*").cast("bigint").alias("n_offers"), F.min("cost").alias("least_cost"))
    return sc.join(seen, "species").select("scenario_id", "species", "n_offers", "least_cost")


def _searches(spark, sf_dir, table, key):
    """One search a row of ``table``: a piece of a name in a shape, by the key."""
    names = td.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("_k"), F.col("p_name").alias("_name"), F.col("p_type").alias("species"))
    k = F.col(key)
    r = td.table(spark, sf_dir, table).select(k.alias("search_id"), k.alias("_key"), (k * 7919 % names.count()).alias("_k")).join(names, "_k")
    piece = F.substring("_name", (F.col("_key") % 5 + 1).cast("int"), (F.col("_key") % 6).cast("int"))
    shape = (F.col("_key") % len(SEARCH_SHAPES)).cast("int") + 1
    part = lambda i: F.element_at(F.array(*[F.lit(s[i]) for s in SEARCH_SHAPES]), shape)
    return r.select("search_id", "species", F.concat(part(1), piece, part(2)).alias("term"), part(0).alias("mode"))


def q_catalog_search_hits(spark, sf_dir):
    """C3/C5 for a table of searches, one a supplier: every offer each finds."""
    listing = td.listing(spark, sf_dir)
    hits = SE.search_hits(_searches(spark, sf_dir, "supplier", "s_suppkey"), listing, SE.index_names(listing))
    return hits.select("search_id", "species", "term", "mode", "pos", "ingredient", "cost")


def q_catalog_search_figures(spark, sf_dir):
    """E1 for a table of searches, one an order: count and means of what each finds."""
    listing = td.listing(spark, sf_dir)
    f = SE.search_figures(_searches(spark, sf_dir, "orders", "o_orderkey"), listing, SE.index_names(listing))
    return f.select("search_id", "species", "term", "mode", F.col("n_ingredients").cast("bigint").alias("n_ingredients"),
                    *[rnd(c, 6).alias(c) for c in ("avg_cost", "avg_cp", "avg_energy")])


def q_guide_csv(spark, sf_dir):
    """B1: nutrient guides as CSV, one folder per species, read back and
    joined to the requests of that animal and stage."""
    from ..sinks.writers import write_nutrient_guides
    path = new_table(spark, "guides")
    write_nutrient_guides(spark, path)
    schema = "stage_no int, stage string, " + ", ".join(f"{c} string" for c in G.WIDE_NAMES.values()) + ", species string"
    back = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    sc = _scen_small(spark, sf_dir)
    return sc.join(back.withColumnRenamed("species", "animal"), ["animal", "stage_no"]).select(
        "scenario_id", "stage", "crude_protein", "energy")


def q_formula_csv(spark, sf_dir):
    """B2: formula rows as CSV by species and date, read back."""
    from ..sinks.writers import write_formulas
    path = new_table(spark, "formulas")
    rows = ration.formula_rows(_solved(spark, sf_dir), ["scenario_id", "species"])
    write_formulas(rows.select("scenario_id", "species", "ingredient", rnd("proportion", 6).alias("proportion"),
                               "cost_contribution"), path, REPORT_DATE)
    schema = "scenario_id long, ingredient string, proportion double, cost_contribution double, species string, run_date string"
    return spark.read.schema(schema).option("header", True).csv(path)


def q_report_files(spark, sf_dir):
    """Report texts as files by file name, read back one by one."""
    from ..sinks.writers import read_reports, write_reports
    path = new_table(spark, "reports")
    write_reports(q_report_text(spark, sf_dir), path)
    return read_reports(spark, path).select("file_name", "report_id", F.sha2(F.col("report").cast("binary"), 256).alias("report_sha256"))


def q_history_append(spark, sf_dir):
    """Two runs append their formulation records, one of them twice; the
    table holds the successes of both, once."""
    from ..sinks import commits
    from ..sinks.writers import append_history
    path = new_table(spark, "records")
    s = write_table(_solved(spark, sf_dir).select("scenario_id", "user_id", "status", rnd("total_cost", 4).alias("total_cost")), "solved")
    even, odd = s.where("scenario_id % 2 = 0"), s.where("scenario_id % 2 <> 0")
    for run, rows in (("even", even), ("odd", odd), ("even", even)):
        append_history(rows, path, run)
    return commits.read(spark, path, s.schema)


def q_catalog_save(spark, sf_dir):
    """B4 + C17 + A7: two saves make two versions; the last one is read."""
    from ..sinks.writers import read_catalog, save_catalog
    path, edits = new_table(spark, "saved"), td.catalog_edits(spark, sf_dir)
    save_catalog(edits.limit(1).where("trim(ingredient) != ''").unionByName(edits), path)
    save_catalog(edits, path)
    return read_catalog(spark, path).select("species", "pos", "ingredient", "cp", "energy", "fiber", "cost")


def q_catalog_sort_name(spark, sf_dir):
    return C.sort_catalog(td.listing(spark, sf_dir), "Ingredient").select("species", "pos", "ingredient", "cost")


def q_catalog_sort_cp(spark, sf_dir):
    return C.sort_catalog(td.listing(spark, sf_dir), "CP").select("species", "pos", "ingredient", "cp")


def q_catalog_sort_energy(spark, sf_dir):
    return C.sort_catalog(td.listing(spark, sf_dir), "Energy").select("species", "pos", "ingredient", "energy")


def q_catalog_summary_regex(spark, sf_dir):
    """The figures over the rows the regular-expression search shows."""
    f = C.search_regex(td.listing(spark, sf_dir), "ingredient", SEARCH_REGEX_TERM)
    return C.summary(f).select("species", F.col("n_ingredients").cast("bigint").alias("n_ingredients"),
                               *[rnd(c, 6).alias(c) for c in ("avg_cost", "avg_cp", "avg_energy")])


def q_formula_sorted(spark, sf_dir):
    """Formula rows by proportion, largest first."""
    kept = F.filter("formula", lambda s: s["x"] > ration.KEEP_THRESHOLD)
    ordered = F.array_sort(F.transform(kept, lambda s: F.struct((-s["x"]).alias("k"), s["ingredient"].alias("ingredient"))))
    s = _solved(spark, sf_dir).where("status = 'optimal'").select("scenario_id", F.posexplode(ordered).alias("at", "r"))
    return s.select("scenario_id", (F.col("at") + 1).cast("int").alias("place"), F.col("r.ingredient").alias("ingredient"),
                    rnd(-F.col("r.k"), 6).alias("proportion"))


def q_breed_stats(spark, sf_dir):
    """E5: breeds per type for the animals in request traffic, most first."""
    seen = _scen_small(spark, sf_dir).select("animal").distinct()
    j = seen.join(F.broadcast(_breeds_b(spark)), "animal")
    return G.value_counts(j, ["animal"], "type").orderBy("animal", F.desc("n"), "type").select("animal", "type", "n")


def q_rate_limit_default(spark, sf_dir):
    """K4: the four limited actions and the fallback under the standard limits."""
    a = td.admin_attempts(spark, sf_dir)
    return A.admit(a).select("event_id", "user_id", "action", "admitted", "wait_s")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "scenario_intake": q_scenario_intake,
        "feeding_guidelines": q_feeding_guidelines,
        "diet_means": q_diet_means,
        "breed_options": q_breed_options,
        "rate_limit_stream": q_rate_limit_stream,
        "rate_limit_late": q_rate_limit_late,
        "history_stream": q_history_stream,
        "gain_forest": q_gain_forest,
        "session_report": q_session_report,
        "session_economics": q_session_economics,
        "gain_features": q_gain_features,
        "prediction_economics": q_prediction_economics,
        "money_text": q_money_text,
        "catalog_csv_read": q_catalog_csv_read,
        "trials_csv_read": q_trials_csv_read,
        "species_route": q_species_route,
        "species_requests": q_species_requests,
        "guide_csv": q_guide_csv,
        "formula_csv": q_formula_csv,
        "report_files": q_report_files,
        "history_append": q_history_append,
        "catalog_save": q_catalog_save,
        "catalog_sort_name": q_catalog_sort_name,
        "catalog_sort_cp": q_catalog_sort_cp,
        "catalog_sort_energy": q_catalog_sort_energy,
        "catalog_summary_regex": q_catalog_summary_regex,
        "formula_sorted": q_formula_sorted,
        "breed_stats": q_breed_stats,
        "rate_limit_default": q_rate_limit_default,
        "quarantine_ingest": q_quarantine_ingest,
        "catalog_csv_roundtrip": q_catalog_csv_roundtrip,
        "sanitize_text": q_sanitize_text,
        "sanitize_numeric": q_sanitize_numeric,
        "sanitize_catalog": q_sanitize_catalog,
        "range_midpoint": q_range_midpoint,
        "standards_unpivot": q_standards_unpivot,
        "standards_union": q_standards_union,
        "stage_targets_join": q_stage_targets_join,
        "breed_profile_lookup": q_breed_profile_lookup,
        "breed_semi_join": q_breed_semi_join,
        "breed_anti_join": q_breed_anti_join,
        "type_counts": q_type_counts,
        "growth_rate_counts": q_growth_rate_counts,
        "distinct_types": q_distinct_types,
        "type_filter_all": q_type_filter_all,
        "breed_search_literal": q_breed_search_literal,
        "catalog_search_regex": q_catalog_search_regex,
        "catalog_search_hits": q_catalog_search_hits,
        "catalog_search_figures": q_catalog_search_figures,
        "catalog_sort": q_catalog_sort,
        "catalog_summary": q_catalog_summary,
        "first_per_key": q_first_per_key,
        "catalog_merge": q_catalog_merge,
        "cost_projection": q_cost_projection,
        "herd_cost": q_herd_cost,
        "roi": q_roi,
        "roi_shares": q_roi_shares,
        "fcr_rating": q_fcr_rating,
        "days_to_market": q_days_to_market,
        "growth_metrics": q_growth_metrics,
        "growth_series": q_growth_series,
        "history_last3": q_history_last3,
        "report_text": q_report_text,
        "rate_limit_attempts": q_rate_limit_attempts,
        "rate_limit_exact": q_rate_limit_exact,
        "ration_min_cost": q_ration_min_cost,
        "ration_fiber_band": q_ration_fiber_band,
        "ration_infeasible": q_ration_infeasible,
        "formula_rows": q_formula_rows,
        "nutrient_achievement": q_nutrient_achievement,
        "ingredient_count_flag": q_ingredient_count_flag,
        "top5_cost": q_top5_cost,
        "cost_share": q_cost_share,
    }
