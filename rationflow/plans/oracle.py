"""DuckDB oracle SQL, one per registered query (same column names)."""

from __future__ import annotations

from . import queries as Q
from . import sql_funcs as SF
from . import sql_views as V

# The standard limits (calls, seconds).
STANDARD_LIMITS = [("optimize", 10, 60), ("predict", 20, 60), ("save_db", 5, 60), ("report", 15, 60)]

_TARGETS = "targets AS (SELECT DISTINCT species, cp_req, energy_req, fiber_min, fiber_max FROM scenarios)"
_T_EQ = ("{a}.species = {b}.species AND {a}.cp_req = {b}.cp_req AND {a}.energy_req = {b}.energy_req"
         " AND {a}.fiber_min IS NOT DISTINCT FROM {b}.fiber_min"
         " AND {a}.fiber_max IS NOT DISTINCT FROM {b}.fiber_max")


def _ration_prefix() -> str:
    """CTEs: catalog, scenarios, best (per target), kept (rows x > 0.001),
    tot (per-target totals) and solved (per scenario)."""
    bf = V.ration_brute_force_sql(_TARGETS)
    return V.with_views(V.CATALOG, V.SCENARIOS) + "," + bf + f""",
slots AS ({V.slots_long('best')}),
kept AS (SELECT * FROM slots WHERE x > 0.001),
tot AS (
  SELECT species, cp_req, energy_req, fiber_min, fiber_max, CAST(count(*) AS INTEGER) AS n_ingredients,
         sum(cp * x) AS total_cp, sum(energy * x) AS total_energy, sum(fiber * x) AS total_fiber
  FROM kept GROUP BY species, cp_req, energy_req, fiber_min, fiber_max),
solved AS (
  SELECT s.*, b.status, b.total_cost, tot.n_ingredients, tot.total_cp, tot.total_energy, tot.total_fiber
  FROM scenarios s JOIN best b ON {_T_EQ.format(a='s', b='b')}
  LEFT JOIN tot ON {_T_EQ.format(a='s', b='tot')}),
frows AS (
  SELECT s.scenario_id, k.pos, k.ingredient, k.x AS proportion,
         round_even((k.x * 100) * 100, 0) / 100 AS proportion_pct, k.cost AS unit_cost,
         round_even((k.x * k.cost) * 100, 0) / 100 AS cost_contribution,
         k.cp * k.x AS cp_contribution, k.energy * k.x AS energy_contribution
  FROM scenarios s JOIN kept k ON {_T_EQ.format(a='s', b='k')})
"""


def _ration_queries() -> dict[str, str]:
    p = _ration_prefix()
    return {
        "ration_min_cost": p + """
SELECT scenario_id, species, status, round(total_cost, 4) AS total_cost, n_ingredients,
       round(total_cp, 4) AS total_cp, round(total_energy, 4) AS total_energy FROM solved""",
        "ration_fiber_band": p + """
SELECT scenario_id, fiber_min, fiber_max, status, round(total_cost, 4) AS total_cost,
       round(total_fiber, 4) AS total_fiber FROM solved""",
        "ration_infeasible": p + """
SELECT species, status, CAST(count(*) AS BIGINT) AS n_scenarios, round(min(total_cost), 4) AS min_cost,
       round(max(total_cost), 4) AS max_cost FROM solved GROUP BY species, status""",
        "formula_rows": p + """
SELECT scenario_id, pos, ingredient, round(proportion, 6) AS proportion, proportion_pct, unit_cost,
       cost_contribution, round(cp_contribution, 4) AS cp_contribution,
       round(energy_contribution, 4) AS energy_contribution FROM frows""",
        "nutrient_achievement": p + """
SELECT scenario_id, status,
       round(CASE WHEN cp_req > 0 THEN total_cp / cp_req * 100 ELSE 0 END, 4) AS cp_pct,
       round(CASE WHEN energy_req > 0 THEN total_energy / energy_req * 100 ELSE 0 END, 4) AS energy_pct,
       round(total_cost * intake_kg, 4) AS daily_cost, round(total_cost * intake_kg * 30, 4) AS monthly_cost
FROM solved""",
        "ingredient_count_flag": p + """
SELECT scenario_id, max_ingredients, n_ingredients, n_ingredients > max_ingredients AS over_limit FROM solved""",
        "top5_cost": p + """
SELECT scenario_id, rank, ingredient, cost_contribution FROM (
  SELECT scenario_id, ingredient, cost_contribution,
         CAST(row_number() OVER (PARTITION BY scenario_id
              ORDER BY cost_contribution DESC, proportion DESC, ingredient) AS INTEGER) AS rank
  FROM frows) WHERE rank <= 5""",
        "cost_share": p + """
SELECT scenario_id, ingredient,
       round(cost_contribution / sum(cost_contribution) OVER (PARTITION BY scenario_id), 6) AS cost_share,
       round(proportion_pct / sum(proportion_pct) OVER (PARTITION BY scenario_id), 6) AS mass_share
FROM frows""",
    }


def _list(vals) -> str:
    return "[" + ", ".join(SF.lit(v) for v in vals) + "]"


def _scalar_queries() -> dict[str, str]:
    k_txt = "regexp_extract(props, '\"k\": (-?[0-9.]+)', 1)"
    clean = ", ".join([
        "species", "pos", f"{SF.sanitize_key('ingredient', 100)} AS ingredient",
        f"{SF.clip_or_zero('cp', 100)} AS cp", f"{SF.clip_or_zero('energy', 10000)} AS energy",
        f"{SF.clip_or_zero('fiber', 100)} AS fiber", f"{SF.clip_or_zero('cost', 100000)} AS cost"])
    return {
        "sanitize_text": f"""
SELECT doc_id, {SF.sanitize_text('text', 200)} AS clean,
       CAST(length({SF.sanitize_text('text', None)}) AS BIGINT) AS clean_chars FROM documents""",
        "sanitize_numeric": f"""
SELECT event_id, {SF.sanitize_numeric('value', 10, 30, 18)} AS v_num,
       {SF.sanitize_int_num('value', 1, 100, 7)} AS v_int,
       {SF.sanitize_numeric('props', 0, 100, -1)} AS props_num,
       {SF.sanitize_int_text(k_txt, 1, 50, 7)} AS k_int FROM events""",
        "sanitize_catalog": V.with_views(V.CATALOG_EDITS) + f"""
SELECT * FROM (SELECT {clean} FROM catalog_edits) WHERE {SF.py_strip('ingredient')} <> ''""",
        "range_midpoint": V.with_views(V.RANGE_TEXTS) + f"""
SELECT pos, raw, {SF.parse_mid('raw')} AS mid FROM range_texts""",
    }


_SCEN = V.with_views(V.CATALOG, V.SCENARIOS) + ",\n" + SF.STANDARDS_LONG + ",\n" + SF.BREEDS
# Nutrient keys and the columns they become, natural order.
_WIDE = {
    "Crude Protein (%)": "crude_protein", "Energy (kcal/kg)": "energy", "Crude Fiber (%)": "crude_fiber",
    "Calcium (%)": "calcium", "Phosphorus (%)": "phosphorus", "Lysine (%)": "lysine",
    "Methionine (%)": "methionine", "TDN (%)": "tdn", "Feed Intake (g/day)": "feed_intake_g_day",
    "Feed Intake (kg/day)": "feed_intake_kg_day"}


def _guide_queries() -> dict[str, str]:
    wide_cols = ", ".join(f"max(CASE WHEN nutrient = {SF.lit(k)} THEN requirement END) AS {v}"
                          for k, v in _WIDE.items())

    def nut(key, default):
        return f"coalesce(max(CASE WHEN nutrient = {SF.lit(key)} THEN requirement END), {SF.lit(default)})"
    cp, en, fi = (SF.parse_mid(nut("Crude Protein (%)", "16-18")), SF.parse_mid(nut("Energy (kcal/kg)", "2500-2700")),
                  SF.parse_mid(nut("Crude Fiber (%)", "12-16")))
    breeds_r = (f"breeds_r AS (SELECT species AS animal, pos AS breed_no, breed, type, growth_rate, recommended_cp, "
                f"{SF.parse_mid('recommended_cp')} AS recommended_cp_mid, market_age, "
                f"CASE WHEN species = 'Cattle' THEN 'months' ELSE 'weeks' END AS market_age_unit FROM breeds)")
    sb = f"{_SCEN},\n{breeds_r},\nsb AS (SELECT s.*, b.breed, b.type, b.growth_rate FROM scenarios s JOIN breeds_r b ON s.animal = b.animal AND s.breed_no = b.breed_no)"
    type_terms = _list(Q.TYPE_TERMS)
    breed_terms = _list(Q.BREED_TERMS)
    return {
        "standards_unpivot": _SCEN + f"""
SELECT s.scenario_id, l.nutrient_no, l.nutrient, {SF.short_label('l.nutrient')} AS short_label, l.requirement
FROM scenarios s JOIN standards_long l ON s.animal = l.species AND s.stage_no = l.stage_no""",
        "standards_union": _SCEN + f""",
wide AS (SELECT species, stage_no, stage, {wide_cols} FROM standards_long GROUP BY species, stage_no, stage)
SELECT s.scenario_id, w.stage, {', '.join('w.' + v for v in _WIDE.values())}
FROM scenarios s JOIN wide w ON s.animal = w.species AND s.stage_no = w.stage_no""",
        "stage_targets_join": _SCEN + f""",
t AS (SELECT species, stage_no, stage, {cp} AS cp_target, {en} AS energy_mid, {fi} AS fiber_mid
      FROM standards_long GROUP BY species, stage_no, stage)
SELECT s.scenario_id, t.stage, t.cp_target, least(t.energy_mid, 4500.0::DOUBLE) AS energy_target,
       greatest(0.0::DOUBLE, t.fiber_mid - 2) AS fiber_min_default, t.fiber_mid + 4 AS fiber_max_default
FROM scenarios s JOIN t ON s.animal = t.species AND s.stage_no = t.stage_no""",
        "breed_profile_lookup": f"{_SCEN},\n{breeds_r}" + """
SELECT s.scenario_id, b.breed, b.type, b.recommended_cp, b.recommended_cp_mid, b.market_age, b.market_age_unit
FROM scenarios s LEFT JOIN breeds_r b ON s.animal = b.animal AND s.breed_no = b.breed_no""",
        "breed_semi_join": f"{_SCEN},\n{breeds_r}" + """
SELECT scenario_id, animal, breed_no FROM scenarios s
WHERE EXISTS (SELECT 1 FROM breeds_r b WHERE b.animal = s.animal AND b.breed_no = s.breed_no)""",
        "breed_anti_join": f"{_SCEN},\n{breeds_r}" + """
SELECT scenario_id, animal, breed_no FROM scenarios s
WHERE NOT EXISTS (SELECT 1 FROM breeds_r b WHERE b.animal = s.animal AND b.breed_no = s.breed_no)""",
        "guide_csv": _SCEN + """,
wide AS (SELECT species, stage_no, stage, max(CASE WHEN nutrient = 'Crude Protein (%)' THEN requirement END) AS crude_protein,
                max(CASE WHEN nutrient = 'Energy (kcal/kg)' THEN requirement END) AS energy
         FROM standards_long GROUP BY species, stage_no, stage)
SELECT s.scenario_id, w.stage, w.crude_protein, w.energy
FROM scenarios s JOIN wide w ON s.animal = w.species AND s.stage_no = w.stage_no""",
        "breed_stats": _SCEN + """
SELECT species AS animal, type, CAST(count(*) AS BIGINT) AS n FROM breeds
WHERE species IN (SELECT animal FROM scenarios) GROUP BY ALL""",
        "type_counts": sb + "\nSELECT animal, type, CAST(count(*) AS BIGINT) AS n FROM sb GROUP BY animal, type",
        "growth_rate_counts": sb + "\nSELECT animal, growth_rate, CAST(count(*) AS BIGINT) AS n FROM sb GROUP BY animal, growth_rate",
        "distinct_types": sb + "\nSELECT animal, 'All|' || string_agg(DISTINCT type, '|' ORDER BY type) AS type_options FROM sb GROUP BY animal",
        "type_filter_all": f"{_SCEN},\n{breeds_r}" + f"""
SELECT scenario_id, breed FROM (
  SELECT s.scenario_id, b.breed, b.type, ({type_terms})[CAST(s.user_id % {len(Q.TYPE_TERMS)} + 1 AS INTEGER)] AS term
  FROM scenarios s JOIN breeds_r b ON s.animal = b.animal) WHERE term = 'All' OR type = term""",
        "breed_search_literal": f"{_SCEN},\n{breeds_r}" + f"""
SELECT scenario_id, breed FROM (
  SELECT s.scenario_id, b.breed,
         {SF.sanitize_text(f"({breed_terms})[CAST(s.user_id % {len(Q.BREED_TERMS)} + 1 AS INTEGER)]")} AS t
  FROM scenarios s JOIN breeds_r b ON s.animal = b.animal) WHERE t = '' OR contains(lower(breed), lower(t))""",
    }


def _searches(table: str, key: str) -> str:
    """CTEs for the search requests of ``table`` and the names each finds."""
    shape = lambda i: f"([{', '.join(SF.lit(s[i]) for s in Q.SEARCH_SHAPES)}])[CAST({key} % {len(Q.SEARCH_SHAPES)} + 1 AS INTEGER)]"
    return V.with_views(V.LISTING) + f""",
searches AS (
  SELECT {key} AS search_id, p_type AS species, {shape(0)} AS mode,
         {shape(1)} || substr(p_name, CAST({key} % 5 + 1 AS INTEGER), CAST({key} % 6 AS INTEGER)) || {shape(2)} AS term
  FROM {table} JOIN part ON p_partkey = ({key} * 7919) % (SELECT count(*) FROM part)),
cleaned AS (SELECT *, {SF.sanitize_text("term")} AS t FROM searches),
found AS (
  SELECT s.species, s.t, s.mode, n.ingredient
  FROM (SELECT DISTINCT species, t, mode FROM cleaned) s JOIN (SELECT DISTINCT species, ingredient FROM listing) n ON n.species = s.species
  WHERE s.t = '' OR CASE WHEN s.mode = 'regex' THEN regexp_matches(n.ingredient, '(?i)' || s.t)
                         ELSE contains(lower(n.ingredient), lower(s.t)) END),
hits AS (
  SELECT c.search_id, c.species, c.term, c.mode, l.pos, l.ingredient, l.cost, l.cp, l.energy
  FROM cleaned c JOIN found f ON f.species = c.species AND f.t = c.t AND f.mode = c.mode
  JOIN listing l ON l.species = f.species AND l.ingredient = f.ingredient)"""


def _catalog_queries() -> dict[str, str]:
    # the sanitised search terms: parentheses are among the deleted characters
    term, sterm = "RED gear|bolt", "gear"
    lv = V.with_views(V.LISTING)
    first = """first_l AS (
  SELECT species, ingredient, pos, brand, cp, energy, fiber, cost FROM (
    SELECT *, row_number() OVER (PARTITION BY species, ingredient ORDER BY pos) AS _rn FROM listing)
  WHERE _rn = 1)"""
    clean = ", ".join([
        "species", "pos", f"{SF.sanitize_key('ingredient', 100)} AS ingredient",
        f"{SF.clip_or_zero('cp', 100)} AS cp", f"{SF.clip_or_zero('energy', 10000)} AS energy",
        f"{SF.clip_or_zero('fiber', 100)} AS fiber", f"{SF.clip_or_zero('cost', 100000)} AS cost"])
    return {
        "catalog_search_regex": lv + f"""
SELECT species, pos, ingredient, cost FROM listing WHERE coalesce(regexp_matches(ingredient, {SF.lit('(?i)' + term)}), FALSE)""",
        "catalog_sort": lv + "\nSELECT species, pos, ingredient, cost FROM listing ORDER BY cost DESC, pos",
        "catalog_sort_name": lv + "\nSELECT species, pos, ingredient, cost FROM listing ORDER BY ingredient, pos",
        "catalog_sort_cp": lv + "\nSELECT species, pos, ingredient, cp FROM listing ORDER BY cp DESC, pos",
        "catalog_sort_energy": lv + "\nSELECT species, pos, ingredient, energy FROM listing ORDER BY energy DESC, pos",
        "catalog_summary_regex": lv + f"""
SELECT species, CAST(count(*) AS BIGINT) AS n_ingredients, round(avg(cost), 6) AS avg_cost,
       round(avg(cp), 6) AS avg_cp, round(avg(energy), 6) AS avg_energy
FROM listing WHERE coalesce(regexp_matches(ingredient, {SF.lit('(?i)' + term)}), FALSE) GROUP BY species""",
        "catalog_csv_read": lv + """
SELECT species, CAST(row_number() OVER (PARTITION BY species ORDER BY pos) AS BIGINT) AS pos, ingredient, cp, energy, fiber, cost
FROM listing""",
        "catalog_search_hits": _searches("supplier", "s_suppkey") + """
SELECT search_id, species, term, mode, pos, ingredient, cost FROM hits""",
        "catalog_search_figures": _searches("orders", "o_orderkey") + """,
sums AS (SELECT species, ingredient, count(*) AS n, sum(cost) AS cost, sum(cp) AS cp, sum(energy) AS energy FROM listing GROUP BY ALL),
figures AS (
  SELECT f.species, f.t, f.mode, sum(n) AS n, sum(cost) / sum(n) AS cost, sum(cp) / sum(n) AS cp, sum(energy) / sum(n) AS energy
  FROM found f JOIN sums s ON s.species = f.species AND s.ingredient = f.ingredient GROUP BY ALL)
SELECT c.search_id, c.species, c.term, c.mode, CAST(coalesce(n, 0) AS BIGINT) AS n_ingredients, round(cost, 6) AS avg_cost,
       round(cp, 6) AS avg_cp, round(energy, 6) AS avg_energy
FROM cleaned c LEFT JOIN figures f ON f.species = c.species AND f.t = c.t AND f.mode = c.mode""",
        "species_requests": V.with_views(V.LISTING, V.SCENARIOS) + """
SELECT scenario_id, species, n_offers, least_cost FROM scenarios
JOIN (SELECT species, CAST(count(*) AS BIGINT) AS n_offers, min(cost) AS least_cost FROM listing GROUP BY species) USING (species)""",
        "species_route": lv + """
SELECT species, pos, ingredient, cost FROM listing WHERE species = (SELECT min(species) FROM listing)""",
        "catalog_summary": lv + f"""
SELECT species, CAST(count(*) AS BIGINT) AS n_ingredients, round(avg(cost), 6) AS avg_cost,
       round(avg(cp), 6) AS avg_cp, round(avg(energy), 6) AS avg_energy
FROM listing WHERE {SF.lit(sterm)} = '' OR contains(lower(ingredient), lower({SF.lit(sterm)})) GROUP BY species""",
        "first_per_key": lv + ",\n" + first + "\nSELECT * FROM first_l",
        "catalog_merge": V.with_views(V.LISTING, V.CATALOG_EDITS) + ",\n" + first + f""",
clean AS (SELECT * FROM (SELECT {clean} FROM catalog_edits) WHERE {SF.py_strip('ingredient')} <> ''),
e AS (SELECT species, ingredient, pos, cp, energy, fiber, cost FROM (
        SELECT *, row_number() OVER (PARTITION BY species, ingredient ORDER BY pos) AS _rn FROM clean) WHERE _rn = 1)
SELECT coalesce(e.species, b.species) AS species, coalesce(e.ingredient, b.ingredient) AS ingredient,
       CASE WHEN e.species IS NOT NULL THEN e.pos ELSE b.pos END AS pos,
       CASE WHEN e.species IS NOT NULL THEN e.cp ELSE b.cp END AS cp,
       CASE WHEN e.species IS NOT NULL THEN e.energy ELSE b.energy END AS energy,
       CASE WHEN e.species IS NOT NULL THEN e.fiber ELSE b.fiber END AS fiber,
       CASE WHEN e.species IS NOT NULL THEN e.cost ELSE b.cost END AS cost,
       CASE WHEN e.species IS NULL THEN 'base' WHEN b.species IS NOT NULL THEN 'edit' ELSE 'new' END AS source
FROM first_l b FULL OUTER JOIN e ON b.species = e.species AND b.ingredient = e.ingredient""",
    }


def _econ_queries() -> dict[str, str]:
    p = _ration_prefix() + ",\n" + SF.SPECIES_PARAMS + """,
econ AS (
  SELECT s.*, p.excellent_above, p.good_above, p.target_weight_kg, p.default_price,
         s.total_cost * s.side_intake AS daily_cost,
         CASE WHEN s.scenario_id % 5 <> 0 THEN s.gain_g END AS pred
  FROM solved s LEFT JOIN species_params p ON s.animal = p.animal),
roi_b AS (
  SELECT *, least(greatest(CAST(cycle_days AS BIGINT), 30), 365) AS days_c,
         CASE WHEN price IS NULL THEN CAST(default_price AS BIGINT)
              ELSE least(greatest(CAST(trunc(price) AS BIGINT), 500), 5000) END AS unit_price
  FROM econ),
"""
    chain = lambda gain, n: f"""
roi_c{n} AS (
  SELECT *, daily_cost * days_c AS feed_cost, weight_kg + ({gain} * days_c) / 1000 AS final_weight_kg FROM roi_b),
roi_d{n} AS (
  SELECT *, final_weight_kg * unit_price AS revenue, final_weight_kg * unit_price - feed_cost AS profit FROM roi_c{n}),
roi_e{n} AS (
  SELECT *, CASE WHEN feed_cost > 0 THEN profit / feed_cost * 100 ELSE 0.0 END AS roi_pct,
         feed_cost + greatest(profit, 0.0) AS tot FROM roi_d{n})"""  # noqa: E731
    p += chain("gain_g", "") + "," + chain("pred", "_p") + "\n"
    n = "least(greatest(CAST(n_animals AS BIGINT), 1), 10000)"
    d = "least(greatest(CAST(duration_days AS BIGINT), 1), 365)"
    reach = "(gain_g > 0 AND weight_kg < target_weight_kg)"
    return {
        "cost_projection": p + """
SELECT scenario_id, round(daily_cost, 4) AS daily_cost, round(daily_cost * 7, 4) AS weekly_cost,
       round(daily_cost * 30, 4) AS monthly_cost, round(daily_cost * 365, 4) AS yearly_cost FROM econ""",
        "herd_cost": p + f"""
SELECT scenario_id, round(daily_cost * {n} * {d}, 4) AS herd_total_cost,
       round(daily_cost * {n} * {d} / {n}, 4) AS cost_per_animal, round(daily_cost * {n}, 4) AS daily_herd_cost
FROM econ""",
        "roi": p + """
SELECT scenario_id, CAST(unit_price AS INTEGER) AS price_per_kg, round(feed_cost, 4) AS feed_cost,
       round(final_weight_kg, 4) AS final_weight_kg, round(revenue, 4) AS revenue, round(profit, 4) AS profit,
       round(roi_pct, 4) AS roi_pct, CASE WHEN profit > 0 THEN 'profitable' ELSE 'loss' END AS verdict FROM roi_e""",
        "roi_shares": p + """
SELECT scenario_id, round(CASE WHEN tot > 0 THEN feed_cost / tot END, 6) AS feed_share,
       round(CASE WHEN tot > 0 THEN greatest(profit, 0.0) / tot END, 6) AS profit_share FROM roi_e""",
        "fcr_rating": p + """
SELECT scenario_id, round(CASE WHEN gain_g > 0 THEN side_intake * 1000 / gain_g ELSE 0.0 END, 4) AS fcr,
       CASE WHEN gain_g > excellent_above THEN 'Excellent' WHEN gain_g > good_above THEN 'Good'
            ELSE 'Below Average' END AS rating FROM econ""",
        "days_to_market": p + f"""
SELECT scenario_id, CASE WHEN {reach} THEN CAST(trunc((target_weight_kg - weight_kg) * 1000 / gain_g) AS BIGINT) END
       AS days_to_market, CASE WHEN {reach} THEN 'days' ELSE 'Achieved' END AS market_label,
       (gain_g <= 0 AND weight_kg < target_weight_kg) AS unreachable FROM econ""",
        "growth_metrics": p + """
SELECT scenario_id, round(gain_g * 7, 4) AS weekly_gain_g, round(gain_g * 30 / 1000, 4) AS monthly_gain_kg,
       round(weight_kg + (gain_g * 30 * 3 / 1000), 4) AS weight_90d_kg,
       round(CASE WHEN total_cost IS NOT NULL AND gain_g > 0 THEN total_cost * side_intake * 1000 / gain_g END, 4)
       AS cost_per_kg_gain FROM econ""",
        "prediction_economics": p + f"""
SELECT scenario_id, pred AS predicted_gain_g,
       round(CASE WHEN pred > 0 THEN side_intake * 1000 / pred ELSE 0.0 END, 4) AS fcr,
       round(pred * 7, 4) AS weekly_gain_g, round(pred * 30 / 1000, 4) AS monthly_gain_kg,
       round(weight_kg + (pred * 30 * 3 / 1000), 4) AS weight_90d_kg,
       round(CASE WHEN total_cost IS NOT NULL AND pred > 0 THEN total_cost * side_intake * 1000 / pred END, 4) AS cost_per_kg_gain,
       round(revenue, 4) AS revenue, round(profit, 4) AS profit, round(roi_pct, 4) AS roi_pct,
       CASE WHEN pred > excellent_above THEN 'Excellent' WHEN pred > good_above THEN 'Good'
            WHEN pred IS NOT NULL THEN 'Below Average' END AS rating,
       CASE WHEN pred > 0 AND weight_kg < target_weight_kg
            THEN CAST(trunc((target_weight_kg - weight_kg) * 1000 / pred) AS BIGINT) END AS days_to_market,
       CAST(unit_price AS INTEGER) AS price_per_kg FROM roi_e_p""",
        "money_text": p + """
SELECT scenario_id, printf('%.2f', daily_cost) AS daily, format('{:,.2f}', daily_cost * 365) AS yearly,
       printf('%.1f', pred) AS gain, printf('%.0f', pred * 7) AS weekly,
       printf('%.2f', CASE WHEN pred > 0 THEN side_intake * 1000 / pred ELSE 0.0 END) || ':1' AS fcr,
       format('{:,.2f}', revenue) AS revenue, printf('%.1f', roi_pct) || '% ROI' AS roi
FROM roi_e_p WHERE status = 'optimal'""",
        "growth_series": V.with_views(V.CATALOG, V.SCENARIOS) + """
SELECT scenario_id, CAST(day AS INTEGER) AS day, round(weight_kg + gain_g * day / 1000, 6) AS projected_weight_kg
FROM scenarios, range(0, 91) AS r(day)""",
    }


def _history_queries() -> dict[str, str]:
    p = _ration_prefix()
    rule = "═" * 50
    det = """string_agg('  ' || ingredient || ': ' || printf('%.2f', round_even((x * 100) * 100, 0) / 100) || '% (₦'
                 || printf('%.2f', round_even((x * cost) * 100, 0) / 100) || ')', chr(10) ORDER BY x DESC, ingredient)"""
    report = (f"'{rule}' || chr(10) || '          RATION FORMULATION REPORT' || chr(10) || '{rule}' || chr(10) || "
              f"'Report Generated: {Q.REPORT_TIME}' || chr(10) || "
              "'Species: ' || s.animal || '  |  Age: ' || CAST(s.age_weeks AS VARCHAR) || ' weeks  |  Weight: ' || "
              "CAST(s.weight_kg AS VARCHAR) || ' kg' || chr(10) || "
              "'CP Req: ' || CAST(s.cp_req AS VARCHAR) || '%  |  Energy: ' || CAST(s.energy_req AS VARCHAR) || ' kcal/kg' || chr(10) || "
              "'Total Cost/kg: ₦' || printf('%.2f', s.total_cost) || '  |  Daily Cost: ₦' || "
              "printf('%.2f', s.total_cost * s.intake_kg) || chr(10) || d.detail || chr(10) || "
              "CASE WHEN s.pred IS NULL THEN '' ELSE 'Daily Gain: ' || printf('%.1f', s.pred) || ' g  |  Weekly: ' || "
              "printf('%.0f', s.pred * 7) || ' g  |  Monthly: ' || printf('%.2f', s.pred * 30 / 1000) || ' kg' || chr(10) || "
              "'90-Day Weight: ' || printf('%.1f', s.weight_kg + s.pred * 30 * 3 / 1000) || ' kg  |  FCR: ' || "
              "printf('%.2f', CASE WHEN s.pred > 0 THEN s.intake_kg * 1000 / s.pred ELSE 0 END) || ':1' || chr(10) END || "
              "chr(10) || 'Generated by the ration engine' || chr(10)")
    reports = p + f""",
det AS (SELECT species, cp_req, energy_req, fiber_min, fiber_max, {det} AS detail
        FROM kept GROUP BY species, cp_req, energy_req, fiber_min, fiber_max),
reports AS (
SELECT s.scenario_id, {report} AS report, s.animal || '_feed_report_{Q.REPORT_DATE}.txt' AS file_name
FROM (SELECT *, CASE WHEN scenario_id % 5 <> 0 THEN gain_g END AS pred FROM solved) s
JOIN det d ON {_T_EQ.format(a='s', b='d')} WHERE s.status = 'optimal')"""
    return {
        "history_last3": p + """
SELECT user_id, scenario_id, recent_rank, strftime(ts, '%Y-%m-%d %H:%M') AS ts_text,
       round(total_cost, 4) AS total_cost, animal, age_weeks, weight_kg, cp_req, energy_req FROM (
  SELECT user_id, scenario_id, total_cost, ts, animal, age_weeks, weight_kg, cp_req, energy_req,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, scenario_id DESC) AS INTEGER) AS recent_rank
  FROM solved WHERE status = 'optimal') WHERE recent_rank <= 3""",
        "report_text": reports + "\nSELECT * FROM reports",
        "report_files": reports + """
SELECT file_name, scenario_id AS report_id, sha256(report) AS report_sha256 FROM reports""",
        "session_report": p + """,
asked AS (SELECT scenario_id AS report_id, user_id, ts + to_days(CAST(scenario_id * 7 % 2000 AS INTEGER)) AS ts FROM scenarios),
f AS (SELECT user_id, ts, max(scenario_id) AS scenario_id, arg_max(total_cost, scenario_id) AS total_cost
      FROM solved WHERE status = 'optimal' GROUP BY user_id, ts),
g AS (SELECT user_id, ts, max(scenario_id) AS scenario_id FROM scenarios WHERE scenario_id % 5 <> 0 GROUP BY user_id, ts)
SELECT a.report_id, a.user_id, f.scenario_id AS formula_id, round(f.total_cost, 4) AS total_cost, g.scenario_id AS prediction_id
FROM asked a ASOF LEFT JOIN f ON a.user_id = f.user_id AND a.ts >= f.ts ASOF LEFT JOIN g ON a.user_id = g.user_id AND a.ts >= g.ts""",
        "history_append": p + """
SELECT scenario_id, user_id, status, round(total_cost, 4) AS total_cost FROM solved WHERE status = 'optimal'""",
        "formula_csv": p + f"""
SELECT f.scenario_id, s.species, f.ingredient, round(f.proportion, 6) AS proportion, f.cost_contribution,
       '{Q.REPORT_DATE}' AS run_date FROM frows f JOIN scenarios s ON s.scenario_id = f.scenario_id""",
        "formula_sorted": p + """
SELECT scenario_id, CAST(row_number() OVER (PARTITION BY scenario_id ORDER BY proportion DESC, ingredient) AS INTEGER) AS place,
       ingredient, round(proportion, 6) AS proportion FROM frows""",
    }


def _admission(view: str, limits) -> str:
    """Row-by-row decisions over a view ``attempts``, as a recursive query."""
    lim = SF.values(limits, ["action", "max_calls", "window_seconds"])
    return "WITH RECURSIVE " + view.strip() + f""",
lim AS (SELECT * FROM {lim}),
ev AS (
  SELECT a.event_id, a.user_id, a.action, epoch_us(a.ts) AS t,
         coalesce(l.max_calls, 30) AS m, CAST(coalesce(l.window_seconds, 60) AS BIGINT) * 1000000 AS w,
         row_number() OVER (PARTITION BY a.user_id, a.action ORDER BY epoch_us(a.ts), a.event_id) AS rn
  FROM attempts a LEFT JOIN lim l ON a.action = l.action),
fold AS (
  SELECT user_id, action, rn, event_id, t, CASE WHEN m > 0 THEN [t] ELSE [] END AS held,
         m > 0 AS admitted, CAST(NULL AS BIGINT) AS wait_s
  FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.action, e.rn, e.event_id, e.t,
         CASE WHEN len(list_filter(f.held, lambda x: e.t - x < e.w)) >= e.m
              THEN list_filter(f.held, lambda x: e.t - x < e.w)
              ELSE list_append(list_filter(f.held, lambda x: e.t - x < e.w), e.t) END,
         len(list_filter(f.held, lambda x: e.t - x < e.w)) < e.m,
         CASE WHEN len(list_filter(f.held, lambda x: e.t - x < e.w)) >= e.m
              THEN CAST(trunc((e.w - (e.t - list_filter(f.held, lambda x: e.t - x < e.w)[1])) / 1000000.0) AS BIGINT) END
  FROM fold f JOIN ev e ON e.user_id = f.user_id AND e.action = f.action AND e.rn = f.rn + 1)
SELECT event_id, user_id, action, admitted, wait_s FROM fold"""


def _admission_queries() -> dict[str, str]:
    a = V.with_views(V.ATTEMPTS)
    return {
        "rate_limit_attempts": a + """
SELECT event_id, user_id, action,
  CAST(count(*) OVER (PARTITION BY user_id, action ORDER BY epoch_us(ts)
       RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS BIGINT) AS attempts_60s,
  CAST(count(*) OVER (PARTITION BY user_id, action ORDER BY epoch_us(ts)
       RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS BIGINT) AS attempts_1d
FROM attempts""",
        "rate_limit_exact": _admission(V.ATTEMPTS, Q.EVENT_LIMITS),
        "rate_limit_default": _admission(V.ADMIN_ATTEMPTS, STANDARD_LIMITS),
    }


def oracle_sql() -> dict[str, str]:
    out = {}
    out.update(_ration_queries())
    out.update(_scalar_queries())
    out.update(_guide_queries())
    out.update(_catalog_queries())
    out.update(_econ_queries())
    out.update(_history_queries())
    out.update(_admission_queries())
    out["rate_limit_stream"] = f"SELECT *, false AS late FROM ({out['rate_limit_exact']})"
    out["rate_limit_late"] = out["rate_limit_stream"] + """
UNION ALL SELECT event_id, user_id, event_type AS action, NULL, NULL, true FROM events"""
    out["history_stream"] = _ration_prefix() + """
SELECT scenario_id, user_id, status, round(total_cost, 4) AS total_cost FROM solved WHERE status = 'optimal'"""
    out["quarantine_ingest"] = V.with_views(V.LISTING) + """
SELECT ingredient, CASE WHEN pos % 7 = 0 THEN NULL ELSE energy END AS energy, pos % 7 = 0 AS quarantined
FROM listing"""
    out["catalog_csv_roundtrip"] = out["catalog_save"] = out["sanitize_catalog"]
    out.update(_more_queries())
    return {k: SF._rewrite_round(v) for k, v in out.items()}


def _more_queries() -> dict[str, str]:
    from ..sources import reference_tables as R
    cols = []
    stage_default = {"cp_req": "t.cp_target", "energy_req": "t.energy_mid",
                     "fiber_min": "t.fiber_min_default", "fiber_max": "t.fiber_max_default",
                     "price": "CASE s.animal " + " ".join(f"WHEN '{r[0]}' THEN {r[4]}" for r in R.SPECIES_PARAMS) + " END"}
    for c, (lo, hi, d) in R.INTAKE_RANGES.items():
        x = f"s.{c}"
        if c in R.INT_INTAKE:
            e = f"CAST({SF.sanitize_int_num(x, lo, hi, d)} AS INTEGER)"
        elif d is None:
            v = f"TRY_CAST({x} AS DOUBLE)"
            e = (f"CASE WHEN {v} IS NULL OR isnan({v}) OR isinf({v}) THEN {stage_default[c]} "
                 f"ELSE least(greatest({v}, CAST({float(lo)} AS DOUBLE)), CAST({float(hi)} AS DOUBLE)) END")
            if c.startswith("fiber"):
                e = f"CASE WHEN {x} IS NOT NULL THEN {e} END"
            if c == "price":
                e = f"CAST({e} AS INTEGER)"
        else:
            e = SF.sanitize_numeric(x, lo, hi, d)
        cols.append(f"{e} AS {c}")

    def nut(key, default):
        return f"coalesce(max(CASE WHEN nutrient = {SF.lit(key)} THEN requirement END), {SF.lit(default)})"
    t = (f"t AS (SELECT species, stage_no, {SF.parse_mid(nut('Crude Protein (%)', '16-18'))} AS cp_target, "
         f"{SF.parse_mid(nut('Energy (kcal/kg)', '2500-2700'))} AS energy_mid, "
         f"greatest(0.0::DOUBLE, {SF.parse_mid(nut('Crude Fiber (%)', '12-16'))} - 2) AS fiber_min_default, "
         f"{SF.parse_mid(nut('Crude Fiber (%)', '12-16'))} + 4 AS fiber_max_default "
         f"FROM standards_long GROUP BY species, stage_no)")
    return {
        "scenario_intake": _SCEN + ",\n" + t + f"""
SELECT s.scenario_id, {', '.join(cols)}
FROM scenarios s LEFT JOIN t ON s.animal = t.species AND s.stage_no = t.stage_no""",
        "feeding_guidelines": _SCEN + ",\n" + SF.GUIDELINES + """
SELECT s.scenario_id, g.guideline FROM scenarios s JOIN guidelines g ON s.animal = g.animal""",
        "diet_means": _SCEN + f""",
dm AS (SELECT species, avg(cp) AS _cp, avg(energy) AS _en FROM catalog GROUP BY species)
SELECT s.scenario_id, round({SF.sanitize_numeric('dm._cp', 0, 100, 18)}, 6) AS diet_cp,
       round({SF.sanitize_numeric('dm._en', 0, 10000, 2800)}, 6) AS diet_energy
FROM scenarios s JOIN dm ON s.species = dm.species""",
        "gain_features": _SCEN.replace("WITH ", "WITH " + V.LISTING + ",", 1) + V.TRIALS + """
SELECT trial_id, round(age_weeks, 4) AS age_weeks, round(weight_kg, 4) AS weight_kg, round(cp_req, 4) AS cp_req,
       round(energy_req, 4) AS energy_req, round(intake_kg, 4) AS intake_kg, round(diet_cp, 4) AS diet_cp,
       round(diet_energy, 4) AS diet_energy, round(gain_g, 4) AS gain_g FROM trials""",
        "trials_csv_read": _SCEN.replace("WITH ", "WITH " + V.LISTING + ",", 1) + V.TRIALS + """
SELECT animal AS animal_type, CAST(breed_no AS VARCHAR) AS breed, CAST(age_weeks AS INTEGER) AS age_weeks,
       weight_kg AS body_weight_kg, cp_req AS cp_requirement_pct, energy_req AS energy_requirement_kcal,
       intake_kg AS feed_intake_kg, diet_cp AS ingredient_cp_pct, diet_energy AS ingredient_energy,
       gain_g AS expected_daily_gain_g FROM trials""",
        "breed_options": _SCEN + f"""
SELECT animal, {SF.lit(R.NO_BREED)} || '|' || string_agg(breed, '|' ORDER BY pos) AS breed_options
FROM (SELECT DISTINCT s.animal, b.pos, b.breed FROM (SELECT DISTINCT animal FROM scenarios) s
      JOIN breeds b ON s.animal = b.species) GROUP BY animal""",
    }
