"""Least-cost ration formulation for tables of scenarios.

The LP solved per request is::

    min  sum_i cost_i x_i
    s.t. sum_i x_i = 1,  x_i >= 0
         sum_i cp_i x_i >= cp,  sum_i energy_i x_i >= energy
         optional: fmin <= sum_i fiber_i x_i <= fmax

Scenarios only move the right-hand side (cp, energy, fmin, fmax); optimality
of a basis (reduced costs >= 0) depends only on the catalog.  So the work is
split in two:

1. ``facets`` (once per species and content): the dual-feasible bases, each with
   its primal solution as *linear functions of the right-hand side*, found by
   walking from neighbour to neighbour, and a partition of the target space
   into cells with the few facets that can be optimal there.
2. ``solve`` (per scenario table): a request looks up its cell, keeps those of
   the cell's facets that are primal feasible for it and takes the cheapest.

A basis that is primal and dual feasible is optimal, so there is no search
per scenario.  Ties (alternate optima) are broken by (round(cost, 6), sorted
support, proportions over the support), a rule that depends only on the
chosen vertex, not on the basis that represents it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_table
from .facets import MAX_SLOTS, SLOT_FIELDS, Facets, cell_of

# Numeric tolerances (fixed values of the method, not tuning knobs).
PRIMAL_TOL = 1e-9
SUPPORT_TOL = 1e-9
TARGET_COLS = ("species", "cp_req", "energy_req", "fiber_min", "fiber_max")
# Rows a target has on average from which targets are solved once each.
REPEATS = 3
# Facets whose worth at a target differs by less count as level there.
LEVEL_TOL = 1e-6
# Reference behaviour: proportions kept in the formula are strictly > 0.001.
KEEP_THRESHOLD = 0.001
X_DP, COST_DP = 12, 9


def _x(j: int, f: str) -> str:
    """Share of slot j under facet f at the request's right-hand side."""
    return f"({f}.s{j}_k0 + {f}.s{j}_kcp * cp_req + {f}.s{j}_kenergy * energy_req + {f}.s{j}_kfiber * {_fiber_rhs(f)})"


def _fiber_rhs(f: str) -> str:
    return f"(CASE {f}.fiber_side WHEN 'min' THEN _fmin WHEN 'max' THEN _fmax ELSE 0.0D END)"


def _reached(a: str, f: str) -> str:
    return f"({f}.{a}_0 + {f}.{a}_cp * cp_req + {f}.{a}_energy * energy_req + {f}.{a}_fiber * {_fiber_rhs(f)})"


def _feasible(f: str) -> str:
    return " AND ".join(
        [f"({f}.fiber_side IS NULL OR _fmin IS NOT NULL)"]
        + [f"{_x(j, f)} >= -{PRIMAL_TOL}" for j in range(MAX_SLOTS)]
        + [f"{_reached('cp', f)} >= cp_req - {PRIMAL_TOL} * (1 + abs(cp_req))",
           f"{_reached('energy', f)} >= energy_req - {PRIMAL_TOL} * (1 + abs(energy_req))",
           f"(_fmin IS NULL OR ({_reached('fiber', f)} >= _fmin - {PRIMAL_TOL} * (1 + abs(_fmin))"
           f" AND {_reached('fiber', f)} <= _fmax + {PRIMAL_TOL} * (1 + abs(_fmax))))"])


def _cost(f: str) -> str:
    return f"({f}.y0 + {f}.y_cp * cp_req + {f}.y_energy * energy_req + {f}.y_fiber * {_fiber_rhs(f)})"


def _snap(x: str, nd: int) -> str:
    """Half-up rounding: solver output is snapped to 12 dp (proportions) / 9
    dp (cost) so the ~1e-13 noise of the closed-form algebra never flips a
    later rounding."""
    return f"(floor({x} * 1e{nd} + 0.5D) / 1e{nd})"


def _rank(f: str) -> str:
    """Struct whose least is the optimum: cost, support, proportions, facet."""
    support = "concat_ws(',', " + ", ".join(
        f"CASE WHEN {_x(j, f)} > {SUPPORT_TOL} THEN lpad(cast({f}.s{j}_pos AS string), 12, '0') END" for j in range(MAX_SLOTS)) + ")"
    xvec = "filter(array(" + ", ".join(
        f"CASE WHEN {_x(j, f)} > {SUPPORT_TOL} THEN {_snap(_x(j, f), 6)} END" for j in range(MAX_SLOTS)) + "), v -> v IS NOT NULL)"
    return f"named_struct('cost6', {_snap(_cost(f), 6)}, 'support', {support}, 'xvec', {xvec}, 'f', {f})"


def solve(scenarios: DataFrame, facets: Facets, repeats: bool | None = None) -> DataFrame:
    """Attach the optimal ration to every scenario row (J1-J3): ``status``
    ('optimal' / 'infeasible'), ``total_cost`` (raw objective), ``formula``
    ARRAY<STRUCT<pos, ingredient, cost, cp, energy, fiber, x>> (all basic
    variables, before the 0.001 threshold) and, of the rows above it,
    ``n_ingredients``, ``total_cp`` and ``total_energy``.  Fibre bounds null =
    constraint off, as it is for a catalog without a fibre column.

    ``repeats``: whether targets repeat so often that each is solved once and
    joined back (a written table of the distinct targets, broadcast if it is
    small enough); otherwise every row is solved where it stands, without a
    shuffle.  None: counted, by one pass over the target columns."""
    if repeats is None:
        r = scenarios.agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64(*TARGET_COLS)).alias("d")).first()
        repeats = r["n"] >= REPEATS * r["d"]
    if not repeats:
        return solve_rows(scenarios, facets)
    targets = write_table(solve_rows(scenarios.select(*TARGET_COLS).distinct(), facets), "solved_targets")
    targets = targets.withColumnsRenamed({c: f"_{c}" for c in TARGET_COLS})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in TARGET_COLS]
    return scenarios.join(targets, reduce(lambda a, b: a & b, same), "left").drop(*[f"_{c}" for c in TARGET_COLS])


def solve_rows(scenarios: DataFrame, facets: Facets) -> DataFrame:
    """:func:`solve` of every row where it stands.

    A request looks up the cells it lies in and their facets, and takes the one
    with the greatest worth at its right-hand side (the dual objective, which
    the optimum alone attains); only that one is then worked out and tested.
    Where several are level, all of those are, and the rule for ties decides.
    Whether the small tables are broadcast is left to Spark, which knows the
    size of their files; beyond the broadcast threshold the same joins are
    shuffle joins that AQE can split."""
    own = scenarios.columns
    s = scenarios.join(facets.spans, "species", "left")
    s = s.withColumns({"_fmin": F.when(F.coalesce("with_fiber", F.lit(False)), F.col("fiber_min")),
                       "_fmax": F.when(F.coalesce("with_fiber", F.lit(False)), F.col("fiber_max"))})
    for i, side in enumerate((None, "min", "max")):
        here = facets.cells.select("species", F.col("cell").alias(f"_cell{i}"), F.col("c").alias(f"_c{i}"))
        s = s.withColumn(f"_cell{i}", F.expr(cell_of(side))).join(here, ["species", f"_cell{i}"], "left")
    # inline() keeps what it yields a column: what reads it never works it out again
    barrier = lambda df, **cols: df.selectExpr("*", "inline(array(named_struct(" + ", ".join(
        f"'{k}', {v}" for k, v in cols.items()) + ")))")
    worth = lambda c, rhs: (f"transform({c}, c -> named_struct('v', c.y0 + c.y_cp * cp_req + c.y_energy * energy_req"  # noqa: E731
                            f"{f' + c.y_fiber * {rhs}' if rhs else ''}, 'c', c.fid))")
    s = barrier(s, _worth=f"CASE WHEN _c1 IS NULL AND _c2 IS NULL THEN {worth('_c0', '')} ELSE flatten(filter(array({worth('_c0', '')}, "
                          f"{worth('_c1', '_fmin')}, {worth('_c2', '_fmax')}), c -> c IS NOT NULL)) END")
    s = s.drop("_c0", "_c1", "_c2")
    s = barrier(s, _top="array_max(_worth)")
    s = barrier(s, _level=f"filter(_worth, w -> w.v >= _top.v - {LEVEL_TOL} * (1 + abs(_top.v)))")
    s = s.withColumns({"_one": F.when(F.size("_level") == 1, F.col("_top.c")),
                       "_crowd": F.when(F.size("_level") > 1, F.col("species"))}).drop("_worth")
    s = s.join(facets.facets.select("species", F.col("fid").alias("_one"), F.col("f").alias("_f")), ["species", "_one"], "left")
    s = s.join(facets.lists.select(F.col("species").alias("_crowd"), "fs"), "_crowd", "left")
    ranked = f"transform(filter(transform(_level, w -> fs[w.c].f), g -> {_feasible('g')}), g -> {_rank('g')})"
    s = barrier(s, _best=f"CASE WHEN _one IS NOT NULL THEN CASE WHEN {_feasible('_f')} THEN _f END "
                         f"WHEN fs IS NOT NULL THEN array_min({ranked}).f END")
    one = [f"named_struct({', '.join(f'{chr(39)}{c}{chr(39)}, _best.s{j}_{c}' for c in SLOT_FIELDS)}, 'x', {_snap(_x(j, '_best'), X_DP)})"
           for j in range(MAX_SLOTS)]
    s = barrier(s, formula=f"CASE WHEN _best IS NOT NULL THEN filter(array({', '.join(one)}), s -> s.pos IS NOT NULL) END")
    kept = F.filter("formula", lambda r: r["x"] > KEEP_THRESHOLD)
    return s.select(*own, *[c.alias(n) for n, c in {
        "status": F.when(F.col("_best").isNull(), "infeasible").otherwise("optimal"),
        "total_cost": F.expr(f"CASE WHEN _best IS NOT NULL THEN {_snap(_cost('_best'), COST_DP)} END"),
        "formula": F.col("formula"),
        "n_ingredients": F.when(F.col("formula").isNotNull(), F.size(kept)),
        "total_cp": F.aggregate(kept, F.lit(0.0), lambda acc, r: acc + r["cp"] * r["x"]),
        "total_energy": F.aggregate(kept, F.lit(0.0), lambda acc, r: acc + r["energy"] * r["x"])}.items()])


def with_totals(solved: DataFrame, intake_col: str = "intake_kg",
                max_ingredients_col: str | None = "max_ingredients") -> DataFrame:
    """J5/J6/E3/E8 on top of :func:`solve`: kept rows (x > 0.001) drive the
    contribution totals and the ingredient count; total cost is the raw
    objective; daily = cost x intake, monthly = daily x 30; the limit only
    raises a flag."""
    out = solved.withColumns({
        "daily_cost": F.col("total_cost") * F.col(intake_col),
        "monthly_cost": F.col("total_cost") * F.col(intake_col) * 30,
        "cp_pct": F.when(F.col("cp_req") > 0, F.col("total_cp") / F.col("cp_req") * 100).otherwise(F.lit(0.0)),
        "energy_pct": F.when(F.col("energy_req") > 0,
                             F.col("total_energy") / F.col("energy_req") * 100).otherwise(F.lit(0.0)),
    })
    if max_ingredients_col:
        out = out.withColumn("over_limit", F.col("n_ingredients") > F.col(max_ingredients_col))
    return out


def formula_rows(solved: DataFrame, key_cols: list[str]) -> DataFrame:
    """One row per kept ingredient with the reference's derived columns
    (percent and cost contribution rounded like pandas: half-even on the
    scaled value)."""
    rows = solved.where(F.col("status") == "optimal").select(
        *key_cols, F.explode(F.filter("formula", lambda s: s["x"] > KEEP_THRESHOLD)).alias("r"))
    return rows.select(
        *key_cols,
        F.col("r.pos").alias("pos"),
        F.col("r.ingredient").alias("ingredient"),
        F.col("r.x").alias("proportion"),
        (F.rint(F.col("r.x") * 100 * 100) / 100).alias("proportion_pct"),
        F.col("r.cost").alias("unit_cost"),
        (F.rint(F.col("r.x") * F.col("r.cost") * 100) / 100).alias("cost_contribution"),
        (F.col("r.cp") * F.col("r.x")).alias("cp_contribution"),
        (F.col("r.energy") * F.col("r.x")).alias("energy_contribution"),
    )


def ranked_formula(solved: DataFrame, key_cols: list[str]) -> DataFrame:
    """Formula rows with in-row totals and a rank by (cost contribution desc,
    proportion desc, ingredient): all computed on each scenario's own small
    array, so the per-scenario "window" needs no shuffle."""
    kept = F.filter("formula", lambda s: s["x"] > KEEP_THRESHOLD)
    rows = F.transform(kept, lambda s: F.struct(
        (-(F.rint(s["x"] * s["cost"] * 100) / 100)).alias("_k1"), (-s["x"]).alias("_k2"),
        s["ingredient"].alias("ingredient"), s["x"].alias("proportion"),
        (F.rint(s["x"] * 100 * 100) / 100).alias("proportion_pct"),
        (F.rint(s["x"] * s["cost"] * 100) / 100).alias("cost_contribution")))
    base = solved.where(F.col("status") == "optimal").select(*key_cols, F.array_sort(rows).alias("_r"))
    base = base.withColumns({
        "_cc_total": F.aggregate("_r", F.lit(0.0), lambda acc, r: acc + r["cost_contribution"]),
        "_pct_total": F.aggregate("_r", F.lit(0.0), lambda acc, r: acc + r["proportion_pct"]),
    })
    out = base.select(*key_cols, "_cc_total", "_pct_total", F.posexplode("_r").alias("_pos", "_e"))
    return out.select(*key_cols, (F.col("_pos") + 1).cast("int").alias("rank"),
                      "_e.ingredient", "_e.proportion", "_e.proportion_pct", "_e.cost_contribution",
                      "_cc_total", "_pct_total")
