"""DuckDB SQL text for the derived inputs (mirror of ``sources/testdata.py``)
and for the brute-force ration oracle.

The oracle for the least-cost ration is deliberately a *different method*
from the engine's facet join: it enumerates every (tight set, ingredient
subset) basis for every distinct target, keeps the primal-feasible ones and
takes the cheapest -- no dual information at all.
"""

from __future__ import annotations

from itertools import combinations

from ..sources.reference_tables import ANIMALS, STANDARDS

ATTRS = ("cp", "energy", "fiber")


def det(m: list[list[str]]) -> str:
    """Determinant as SQL text, down the first column."""
    if len(m) == 1:
        return f"({m[0][0]})"
    terms = [f"{'-' if i % 2 else '+'} ({m[i][0]}) * {det([r[1:] for k, r in enumerate(m) if k != i])}" for i in range(len(m))]
    return "(0 " + " ".join(terms) + ")"


def cofactor(m: list[list[str]], r: int, c: int) -> str:
    if len(m) == 1:
        return "1"
    sub = [row[:c] + row[c + 1:] for k, row in enumerate(m) if k != r]
    return f"({'-' if (r + c) % 2 else ''}{det(sub)})"

SLOT_FIELDS = ("pos", "ingredient", "cost", "cp", "energy", "fiber")

LISTING = """
listing AS (
  SELECT p_type AS species, p_partkey AS pos, p_name AS ingredient, p_brand AS brand,
         CAST((CAST(p_size AS BIGINT) * 37 + p_partkey) % 450 AS DOUBLE) / 10 AS cp,
         CAST(1500 + (p_partkey * 7 + CAST(p_size AS BIGINT) * 131) % 2000 AS DOUBLE) AS energy,
         CAST((p_partkey * 3 + CAST(p_size AS BIGINT)) % 300 AS DOUBLE) / 10 AS fiber,
         CAST(40 + (p_partkey * 13 + CAST(p_size AS BIGINT)) % 960 AS DOUBLE) AS cost
  FROM part)"""

CATALOG = """
cat_g AS (
  SELECT p_type AS species, p_brand AS ingredient, SUM(CAST(p_size AS BIGINT)) AS _s,
         SUM(p_partkey) AS _k
  FROM part GROUP BY p_type, p_brand),
catalog AS (
  SELECT species,
         CAST(row_number() OVER (PARTITION BY species ORDER BY ingredient) AS BIGINT) AS pos,
         ingredient,
         CAST((_s * 37 + _k) % 450 AS DOUBLE) / 10 AS cp,
         CAST(1500 + (_k * 7 + _s * 131) % 2000 AS DOUBLE) AS energy,
         CAST((_k * 3 + _s) % 300 AS DOUBLE) / 10 AS fiber,
         CAST(40 + (_k * 13 + _s) % 960 AS DOUBLE) AS cost
  FROM cat_g)"""

_ANIMAL_LIST = "[" + ", ".join(f"'{a}'" for a in ANIMALS) + "]"

_STAGES = " ".join(f"WHEN '{a}' THEN {sum(r[0] == a for r in STANDARDS)}" for a in ANIMALS)

SCENARIOS = f"""
species_dim AS (
  SELECT species, idx AS species_idx, ({_ANIMAL_LIST})[CAST(idx % {len(ANIMALS)} + 1 AS INTEGER)] AS animal
  FROM (SELECT species, CAST(row_number() OVER (ORDER BY species) - 1 AS BIGINT) AS idx
        FROM (SELECT DISTINCT p_type AS species FROM part))),
n_species AS (SELECT CAST(count(*) AS BIGINT) AS n FROM species_dim),
scen_base AS (
  SELECT o_orderkey AS scenario_id, o_custkey AS user_id, o_orderdate AS ts,
         o_orderkey % (SELECT n FROM n_species) AS species_idx, o_orderkey // (SELECT n FROM n_species) AS _turn,
         o_custkey % 8 AS breed_no,
         CAST(1 + o_custkey % 120 AS INTEGER) AS age_weeks,
         CAST(10 + o_custkey % 36 AS DOUBLE) AS cp_req,
         CAST(1800 + 10 * (o_orderkey % 120) AS DOUBLE) AS energy_req,
         CASE WHEN (o_orderkey % 120) % 4 = 0 THEN CAST((o_custkey % 15) % 8 AS DOUBLE) / 1 END AS fiber_min,
         CASE WHEN (o_orderkey % 120) % 4 = 0
              THEN CAST((o_custkey % 15) % 8 AS DOUBLE) / 1 + CAST(6 + (o_orderkey % 120) % 5 AS DOUBLE) END AS fiber_max,
         CAST(1 + o_custkey % 40 AS DOUBLE) / 20 AS intake_kg,
         CAST(3 + o_custkey % 4 AS INTEGER) AS max_ingredients,
         CAST(10 + o_custkey % 21 AS DOUBLE) AS side_cp,
         CAST(2000 + 100 * (o_orderkey % 50) AS DOUBLE) AS side_energy,
         CAST(1 + o_orderkey % 30 AS DOUBLE) / 20 AS side_intake,
         CAST(1 + o_custkey % 500 AS INTEGER) AS n_animals,
         CAST(1 + o_orderkey % 365 AS INTEGER) AS duration_days,
         CAST(30 + o_orderkey % 336 AS INTEGER) AS cycle_days,
         CASE WHEN o_custkey % 4 <> 0 THEN CAST(300 + 100 * (o_orderkey % 60) AS DOUBLE) END AS price,
         o_orderkey % 97 AS _w, o_orderkey % 60 AS _g
  FROM orders),
scenarios AS (
  SELECT scenario_id, user_id, ts, d.species, d.animal,
         _turn % CASE d.animal {_STAGES} END AS stage_no, breed_no, age_weeks,
         CASE WHEN d.animal = 'Cattle' THEN CAST(50 + _w * 4 AS DOUBLE)
              ELSE CAST(1 + _w % 12 AS DOUBLE) / 4 END AS weight_kg,
         cp_req, energy_req, fiber_min, fiber_max, intake_kg, max_ingredients,
         side_cp, side_energy, side_intake, n_animals, duration_days, cycle_days, price,
         CASE WHEN d.animal = 'Cattle' THEN CAST(300 + _g * 10 AS DOUBLE) ELSE CAST(_g AS DOUBLE) END AS gain_g
  FROM scen_base b JOIN species_dim d ON b.species_idx = d.species_idx)"""

ATTEMPTS = """
attempts AS (
  SELECT event_id, user_id, event_type AS action, ts FROM events)"""


ADMIN_ATTEMPTS = """
attempts AS (
  SELECT event_id, user_id % 20 AS user_id,
         CASE event_id % 5 WHEN 0 THEN 'optimize' WHEN 1 THEN 'predict' WHEN 2 THEN 'save_db' WHEN 3 THEN 'report'
              ELSE 'browse' END AS action,
         CAST(date_trunc('month', ts) AS TIMESTAMP) + to_seconds(event_id * 7 % 300) AS ts
  FROM events)"""

TRIALS = """,
trials AS (
  SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS trial_id, s.animal, s.breed_no,
         CAST(s.age_weeks AS DOUBLE) AS age_weeks, s.weight_kg, s.side_cp AS cp_req, s.side_energy AS energy_req,
         s.side_intake AS intake_kg, p.cp AS diet_cp, p.energy AS diet_energy,
         10.0::DOUBLE + 2 * s.side_cp + s.side_energy / 200 + 40 * s.side_intake + p.cp / 2
           + CAST(l_suppkey % 5 AS DOUBLE) AS gain_g
  FROM lineitem l JOIN scenarios s ON s.scenario_id = l.l_orderkey JOIN listing p ON p.pos = l.l_partkey)"""


def with_views(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def _brute_force_branch(tight: tuple[str, ...], side: str | None) -> str:
    k = len(tight) + 1
    rows = [["1"] * k] + [[f"b{j}_{t}" for j in range(k)] for t in tight]
    cols = ", ".join(f"b{j}.{c} AS b{j}_{c}" for j in range(k) for c in SLOT_FIELDS)
    joins = "catalog b0" + "".join(
        f" JOIN catalog b{j} ON b{j}.species = b0.species AND b{j - 1}.pos < b{j}.pos" for j in range(1, k))
    cof = ", ".join(f"{cofactor(rows, r, j)} AS _c{r}_{j}" for r in range(k) for j in range(k))
    bases = f"SELECT b0.species AS species, {cols} FROM {joins}"
    algebra = f"SELECT *, {det(rows)} AS _det, {cof} FROM ({bases})"
    rhs = {"cp": "t.cp_req", "energy": "t.energy_req",
           "fiber": "t.fiber_min" if side == "min" else "t.fiber_max"}
    b = ["1"] + [rhs[t] for t in tight]
    xs = [" + ".join(f"_c{r}_{j} * {b[r]}" if b[r] != "1" else f"_c{r}_{j}" for r in range(k))
          for j in range(k)]
    sel = [f"({xs[j]}) / _det AS x{j}" for j in range(k)]
    sel += [f"CAST(NULL AS DOUBLE) AS x{j}" for j in range(k, 4)]
    slot = []
    for j in range(4):
        for c in SLOT_FIELDS:
            slot.append(f"a.b{j}_{c} AS s{j}_{c}" if j < k else
                        f"CAST(NULL AS {'BIGINT' if c == 'pos' else 'VARCHAR' if c == 'ingredient' else 'DOUBLE'}) AS s{j}_{c}")
    scale = " * ".join(["1.0"] + [f"greatest({', '.join(f'abs(a.b{j}_{t})' for j in range(k))}, 1e-300)"
                                   for t in tight])
    fiber_gate = "t.fiber_min IS NOT NULL" if side else "TRUE"
    return f"""
  SELECT t.species, t.cp_req, t.energy_req, t.fiber_min, t.fiber_max, {', '.join(slot)}, {', '.join(sel)}
  FROM targets t JOIN ({algebra}) a ON a.species = t.species
  WHERE {fiber_gate} AND abs(a._det) > 1e-10 * ({scale})"""


def ration_brute_force_sql(targets_cte: str) -> str:
    """CTE text defining ``best(species, cp_req, energy_req, fiber_min,
    fiber_max, status, total_cost, s0_*..s3_*, x0..x3)``; needs ``catalog``
    and a ``targets`` CTE given by ``targets_cte``."""
    branches = []
    for r in range(0, 4):
        for tight in combinations(ATTRS, r):
            sides = ["min", "max"] if "fiber" in tight else [None]
            for side in sides:
                branches.append(_brute_force_branch(tight, side))
    union = "\n  UNION ALL".join(branches)
    xs = [f"coalesce(x{j}, 0)" for j in range(4)]

    def ach(a: str) -> str:
        return " + ".join(f"coalesce(s{j}_{a}, 0) * {xs[j]}" for j in range(4))

    tol = "1e-9"
    feasible = " AND ".join(
        [f"{xs[j]} >= -{tol}" for j in range(4)]
        + [f"{ach('cp')} >= cp_req - {tol} * (1 + abs(cp_req))",
           f"{ach('energy')} >= energy_req - {tol} * (1 + abs(energy_req))",
           f"(fiber_min IS NULL OR ({ach('fiber')} >= fiber_min - {tol} * (1 + abs(fiber_min))"
           f" AND {ach('fiber')} <= fiber_max + {tol} * (1 + abs(fiber_max))))"])
    cost = " + ".join(f"coalesce(s{j}_cost, 0) * {xs[j]}" for j in range(4))
    support = "concat_ws(',', " + ", ".join(
        f"CASE WHEN {xs[j]} > 1e-9 THEN lpad(CAST(s{j}_pos AS VARCHAR), 12, '0') END" for j in range(4)) + ")"
    xvec = "list_filter([" + ", ".join(
        f"CASE WHEN {xs[j]} > 1e-9 THEN round({xs[j]}, 6) END" for j in range(4)) + "], lambda v: v IS NOT NULL)"
    return f"""{targets_cte},
cand AS ({union}
),
feas AS (
  SELECT *, {cost} AS total_cost, {support} AS support, {xvec} AS xvec FROM cand WHERE {feasible}
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY species, cp_req, energy_req, fiber_min, fiber_max
                               ORDER BY round(total_cost, 6), support, xvec) AS _rn
  FROM feas
),
best AS (
  SELECT t.species, t.cp_req, t.energy_req, t.fiber_min, t.fiber_max,
         CASE WHEN r._rn IS NULL THEN 'infeasible' ELSE 'optimal' END AS status,
         round(r.total_cost, 9) AS total_cost, {', '.join(f's{j}_{c}' for j in range(4) for c in SLOT_FIELDS)},
         round(x0, 12) AS x0, round(x1, 12) AS x1, round(x2, 12) AS x2, round(x3, 12) AS x3
  FROM targets t LEFT JOIN (SELECT * FROM ranked WHERE _rn = 1) r
    ON t.species = r.species AND t.cp_req = r.cp_req AND t.energy_req = r.energy_req
   AND t.fiber_min IS NOT DISTINCT FROM r.fiber_min AND t.fiber_max IS NOT DISTINCT FROM r.fiber_max
)"""


def slots_long(best: str = "best", extra_cols: str = "") -> str:
    """Explode the four slots of ``best`` into rows (pos, ingredient, ... , x)."""
    parts = []
    for j in range(4):
        parts.append(
            f"SELECT species, cp_req, energy_req, fiber_min, fiber_max{extra_cols}, "
            f"s{j}_pos AS pos, s{j}_ingredient AS ingredient, s{j}_cost AS cost, s{j}_cp AS cp, "
            f"s{j}_energy AS energy, s{j}_fiber AS fiber, x{j} AS x FROM {best} WHERE s{j}_pos IS NOT NULL")
    return " UNION ALL ".join(parts)

CATALOG_EDITS = """
catalog_edits AS (
  SELECT p_type AS species, p_partkey AS pos,
         CASE WHEN p_partkey % 50 = 0 THEN '   ' WHEN p_partkey % 3 = 0 THEN p_name
              ELSE concat(p_name, ' (', p_brand, ') & co') END AS ingredient,
         CASE WHEN p_partkey % 13 = 0 THEN 'n/a' ELSE CAST(p_size * 7 - 30 AS VARCHAR) END AS cp,
         CAST((p_partkey * 7) % 12000 AS DOUBLE) AS energy,
         CASE WHEN p_partkey % 11 = 0 THEN 'NaN'::DOUBLE ELSE CAST(p_size * 5 AS DOUBLE) / 2 END AS fiber,
         CAST((p_partkey * 131) % 150000 AS DOUBLE) AS cost
  FROM part)"""

RANGE_TEXTS = """
range_texts AS (
  SELECT p_partkey AS pos,
         CASE WHEN p_partkey % 5 = 0 THEN CAST(p_size AS VARCHAR)
              WHEN p_partkey % 9 = 0 THEN concat(CAST(p_size AS VARCHAR), '.', CAST(p_partkey % 10 AS VARCHAR), '-',
                   CAST(p_size + p_partkey % 7 AS VARCHAR), '.', CAST(p_partkey % 3 AS VARCHAR), ' (point of lay)')
              ELSE concat(CAST(p_size AS VARCHAR), '.', CAST(p_partkey % 10 AS VARCHAR), '-',
                   CAST(p_size + p_partkey % 7 AS VARCHAR), '.', CAST(p_partkey % 3 AS VARCHAR)) END AS raw
  FROM part)"""
