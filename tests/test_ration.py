"""Least-cost ration: facet method vs an independent brute force, LP
properties, infeasibility and the 0.001 threshold."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from rationflow.operators import facets as facets_of
from rationflow.operators import ration

CAT = [  # species, pos, ingredient, cp, energy, fiber, cost
    ("S", 1, "maize", 9.0, 3300.0, 2.5, 180.0),
    ("S", 2, "soy", 44.0, 2400.0, 7.0, 450.0),
    ("S", 3, "bran", 15.0, 1900.0, 11.0, 90.0),
    ("S", 4, "oil", 0.0, 8800.0, 0.0, 900.0),
    ("S", 5, "hay", 12.0, 1800.0, 30.0, 60.0),
    ("S", 6, "fish", 60.0, 2800.0, 1.0, 1200.0),
    ("T", 1, "a", 10.0, 2000.0, 5.0, 100.0),
    ("T", 2, "b", 12.0, 2100.0, 6.0, 120.0),
]
CAT_SCHEMA = "species string, pos long, ingredient string, cp double, energy double, fiber double, cost double"


def brute_force(cat, cp, en, fmin=None, fmax=None):
    """Enumerate every basis; numpy solve; keep primal feasible; min cost."""
    rows = [r for r in cat]
    best = None
    attrs = {"cp": 3, "energy": 4, "fiber": 5}
    tights = [t for r in range(4) for t in itertools.combinations(attrs, r)]
    for tight in tights:
        if "fiber" in tight and fmin is None:
            continue
        sides = ["min", "max"] if "fiber" in tight else [None]
        for side in sides:
            rhs = {"cp": cp, "energy": en, "fiber": fmin if side == "min" else fmax}
            for B in itertools.combinations(rows, len(tight) + 1):
                A = np.array([[1.0] * len(B)] + [[b[attrs[t]] for b in B] for t in tight])
                if abs(np.linalg.det(A)) < 1e-9:
                    continue
                x = np.linalg.solve(A, np.array([1.0] + [rhs[t] for t in tight]))
                if (x < -1e-9).any():
                    continue
                ach = {a: sum(b[i] * xi for b, xi in zip(B, x)) for a, i in attrs.items()}
                if ach["cp"] < cp - 1e-7 or ach["energy"] < en - 1e-6:
                    continue
                if fmin is not None and not (fmin - 1e-7 <= ach["fiber"] <= fmax + 1e-7):
                    continue
                c = sum(b[6] * xi for b, xi in zip(B, x))
                best = c if best is None else min(best, c)
    return best


@pytest.fixture(scope="module")
def facets(spark):
    return facets_of.prepare(spark.createDataFrame(CAT, CAT_SCHEMA))


TARGETS = [("S", cp, en, fmin, fmax) for cp in (10.0, 14.0, 18.0, 25.0, 45.0, 61.0)
           for en in (1800.0, 2500.0, 3000.0, 4000.0)
           for fmin, fmax in ((None, None), (4.0, 8.0), (10.0, 12.0), (20.0, 15.0))] + \
          [("T", 11.0, 2050.0, None, None), ("T", 13.0, 2000.0, None, None)]


def test_facets_match_brute_force(spark, facets):
    t = spark.createDataFrame(TARGETS, "species string, cp_req double, energy_req double, "
                                       "fiber_min double, fiber_max double")
    got = {(r.species, r.cp_req, r.energy_req, r.fiber_min, r.fiber_max): r
           for r in ration.solve(t, facets).collect()}
    for tgt in TARGETS:
        sp, cp, en, fmin, fmax = tgt
        want = brute_force([c for c in CAT if c[0] == sp], cp, en, fmin, fmax)
        r = got[tgt]
        if want is None:
            assert r.status == "infeasible", tgt
        else:
            assert r.status == "optimal", tgt
            assert abs(r.total_cost - want) < 1e-6 * max(1, want), (tgt, r.total_cost, want)


def test_solution_properties(spark, facets):
    t = spark.createDataFrame([("S", 18.0, 2900.0, 4.0, 9.0)], "species string, cp_req double, "
                              "energy_req double, fiber_min double, fiber_max double")
    r = ration.solve(t, facets).first()
    xs = [s.x for s in r.formula]
    assert abs(sum(xs) - 1) < 1e-9 and min(xs) >= -1e-9
    assert sum(s.cp * s.x for s in r.formula) >= 18 - 1e-7
    assert sum(s.energy * s.x for s in r.formula) >= 2900 - 1e-6
    assert 4 - 1e-7 <= sum(s.fiber * s.x for s in r.formula) <= 9 + 1e-7
    assert abs(sum(s.cost * s.x for s in r.formula) - r.total_cost) < 1e-6


def test_cost_monotone_in_targets(spark, facets):
    t = spark.createDataFrame([("S", float(cp), 2500.0, None, None) for cp in range(10, 40, 3)],
                              "species string, cp_req double, energy_req double, fiber_min double, fiber_max double")
    costs = [r.total_cost for r in ration.solve(t, facets).orderBy("cp_req").collect()]
    assert all(b >= a - 1e-9 for a, b in zip(costs, costs[1:]))


def test_scenarios_join_back_and_totals(spark, facets):
    sc = spark.createDataFrame([(1, "S", 18.0, 2900.0, None, None, 0.5, 3), (2, "S", 18.0, 2900.0, None, None, 1.0, 3),
                                (3, "S", 99.0, 2900.0, None, None, 1.0, 3)],
                               "scenario_id long, species string, cp_req double, energy_req double, "
                               "fiber_min double, fiber_max double, intake_kg double, max_ingredients int")
    out = {r.scenario_id: r for r in ration.with_totals(ration.solve(sc, facets)).collect()}
    assert out[1].total_cost == out[2].total_cost and out[3].status == "infeasible"
    assert abs(out[2].daily_cost - out[2].total_cost) < 1e-12
    assert abs(out[1].monthly_cost - out[1].total_cost * 0.5 * 30) < 1e-9
    rows = ration.formula_rows(ration.solve(sc, facets), ["scenario_id"]).where("scenario_id = 1").collect()
    assert all(r.proportion > 0.001 for r in rows)


def test_requests_with_own_targets_are_not_shuffled(spark, facets, tmp_path):
    """All-distinct targets are solved where they stand: the request side has
    no exchange and no aggregate.  Repeated targets are solved once each."""
    path = str(tmp_path / "sc")
    spark.range(2000).selectExpr("id AS scenario_id", "'S' AS species", "10.0D + id / 100 AS cp_req", "2000.0D + id AS energy_req",
                                 "cast(null AS double) AS fiber_min", "cast(null AS double) AS fiber_max").write.parquet(path)
    df = ration.solve(spark.read.parquet(path), facets).select("scenario_id", "status", "total_cost")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Aggregate" not in plan
    assert df.count() == 2000
    many = spark.read.parquet(path).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(5))))
    again = ration.solve(many, facets)
    assert "scenario_id" in again.columns and "cell" not in again._jdf.queryExecution().executedPlan().toString()
    want = {r.scenario_id: (r.status, r.total_cost) for r in df.collect()}
    got = again.select("scenario_id", "status", "total_cost").collect()
    assert len(got) == 10_000 and all((r.status, r.total_cost) == want[r.scenario_id] for r in got)


def test_pricing_finds_the_facets_of_a_large_catalog(spark):
    """400 ingredients: few of them become active, and the rations are those
    of a linear-programming check on sampled targets."""
    r = np.random.default_rng(3)
    rows = [("S", i + 1, f"i{i}", float(round(r.uniform(2, 60), 2)), float(round(r.uniform(1500, 4000), 1)),
             float(round(r.uniform(0, 35), 2)), 0.0) for i in range(400)]
    rows = [(*x[:6], float(round(40 + 6 * x[3] + x[4] / 20 + r.uniform(0, 300), 2))) for x in rows]
    log = []
    facets = facets_of.prepare(spark.createDataFrame(rows, CAT_SCHEMA), log)
    assert len(log) < 12 and log[-1][0] < 200
    targets = [("S", 20.0, 2600.0, None, None), ("S", 35.0, 3100.0, 5.0, 9.0), ("S", 50.0, 3600.0, None, None),
               ("S", 12.0, 1900.0, 20.0, 24.0)]
    t = spark.createDataFrame(targets, "species string, cp_req double, energy_req double, fiber_min double, fiber_max double")
    got = {x.cp_req: x for x in ration.solve(t, facets).collect()}
    for _, cp, en, lo, hi in targets:
        x = got[cp]
        assert x.status == "optimal" and abs(sum(s.x for s in x.formula) - 1) < 1e-9
        # no ingredient improves the ration: dual prices from its own support
        support = [s for s in x.formula if s.x > 1e-9]
        assert sum(s.cp * s.x for s in support) >= cp - 1e-6 and sum(s.energy * s.x for s in support) >= en - 1e-5
        assert x.total_cost <= min((c[6] for c in rows if c[3] >= cp and c[4] >= en and (lo is None or lo <= c[5] <= hi)),
                                   default=float("inf")) + 1e-6


def test_catalog_without_fibre_solves_as_fibre_off(spark):
    cat = spark.createDataFrame(CAT, CAT_SCHEMA).drop("fiber")
    t = spark.createDataFrame([("S", 18.0, 2900.0, 5.0, 9.0), ("S", 18.0, 2900.0, None, None)],
                              "species string, cp_req double, energy_req double, fiber_min double, fiber_max double")
    a, b = ration.solve(t, facets_of.prepare(cat)).collect()
    assert a.status == b.status == "optimal" and a.total_cost == b.total_cost


def test_facets_follow_the_catalog(spark, tmp_path):
    """A saved catalog is never answered from the facets of the one before."""
    folder = str(tmp_path / "facets")
    t = spark.createDataFrame([("S", 18.0, 2900.0, None, None)],
                              "species string, cp_req double, energy_req double, fiber_min double, fiber_max double")
    cost = lambda cat: ration.solve(t, facets_of.of_catalog(cat, folder)).first().total_cost
    old = spark.createDataFrame(CAT, CAT_SCHEMA)
    new = old.withColumn("cost", F.col("cost") * 2)
    first = cost(old)
    assert abs(cost(new) - 2 * first) < 1e-6 and cost(old) == first


def _all_facets(cat, cp, en, lo, hi, f):
    """Every facet tried, as ``solve`` did before there were cells."""
    best = None
    for g in f:
        rhs = {"min": lo, "max": hi, None: 0.0}[g["fiber_side"]]
        if rhs is None:
            continue
        x = [g[f"s{j}_k0"] + g[f"s{j}_kcp"] * cp + g[f"s{j}_kenergy"] * en + g[f"s{j}_kfiber"] * rhs for j in range(4)]
        got = {a: sum((g[f"s{j}_{a}"] or 0.0) * x[j] for j in range(4)) for a in ("cp", "energy", "fiber")}
        if min(x) < -1e-9 or got["cp"] < cp - 1e-9 * (1 + cp) or got["energy"] < en - 1e-9 * (1 + en):
            continue
        if lo is not None and not lo - 1e-9 * (1 + lo) <= got["fiber"] <= hi + 1e-9 * (1 + hi):
            continue
        cost = g["y0"] + g["y_cp"] * cp + g["y_energy"] * en + g["y_fiber"] * rhs
        best = cost if best is None else min(best, cost)
    return best


def test_cells_lose_no_facet(spark):
    """Targets on cell borders, on the catalog's own values, outside all cells
    and at random: the looked-up ration costs what trying all facets gives."""
    f = facets_of.prepare(spark.createDataFrame(CAT, CAT_SCHEMA))
    every = [r["f"].asDict() for r in f.facets.where("species = 'S'").collect()]
    r = np.random.default_rng(8)
    lo, w = {"cp": 0.0, "energy": 1800.0, "fiber": 0.0}, {"cp": 60.0, "energy": 7000.0, "fiber": 30.0}
    edge = lambda a, n: lo[a] + w[a] * r.integers(0, n + 1) / n
    targets = set()
    for i in range(1200):
        kind = i % 4
        cp = (edge("cp", 48), edge("cp", 20), float(r.choice([c[3] for c in CAT])), r.uniform(-5, 70))[kind]
        en = (edge("energy", 48), edge("energy", 20), float(r.choice([c[4] for c in CAT])), r.uniform(1000, 9500))[kind]
        band = (None, None)
        if i % 3:
            a = edge("fiber", 20) if i % 2 else r.uniform(-2, 33)
            band = (float(a), float(a + r.choice([0.0, 1.5, 6.0, -1.0])))
        targets.add(("S", float(cp), float(en), *band))
    t = spark.createDataFrame(list(targets), "species string, cp_req double, energy_req double, fiber_min double, fiber_max double")
    status = set()
    for row in ration.solve(t, f).collect():
        want = _all_facets(CAT, row.cp_req, row.energy_req, row.fiber_min, row.fiber_max, every)
        status.add(row.status)
        assert (row.status == "infeasible") == (want is None), row
        assert want is None or abs(row.total_cost - want) < 1e-6 * (1 + abs(want)), row
    assert status == {"optimal", "infeasible"}


def _enumerated(rows):
    """Every dual-feasible basis by trying all of them: (positions, tight rows)."""
    found = set()
    a = {"cp": 3, "energy": 4, "fiber": 5}
    cost = np.array([r[6] for r in rows])
    for k in range(1, 5):
        for tight in itertools.combinations(a, k - 1):
            for b in itertools.combinations(range(len(rows)), k):
                m = np.array([[1.0] * k] + [[rows[i][a[t]] for i in b] for t in tight])
                scale = np.prod([np.abs(x).max() or 1e-300 for x in m])
                if abs(np.linalg.det(m)) <= 1e-10 * scale:
                    continue
                y = np.linalg.solve(m.T, cost[list(b)])
                price = dict(zip(tight, y[1:], strict=True))
                if price.get("cp", 0) < -1e-9 or price.get("energy", 0) < -1e-9:
                    continue
                rc = cost - y[0] - sum(price[t] * np.array([r[a[t]] for r in rows]) for t in tight)
                if (rc >= -1e-7 * (1 + np.abs(cost))).all():
                    found.add((tuple(sorted(rows[i][1] for i in b)), tight))
    return found


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_the_walk_finds_what_enumeration_finds(spark, seed):
    """Generic catalogs, and one of small whole numbers with repeated rows,
    where many ingredients meet in one corner."""
    r = np.random.default_rng(seed)
    if seed < 3:
        rows = [("S", i + 1, f"i{i}", float(r.uniform(2, 60)), float(r.uniform(1500, 4000)), float(r.uniform(0, 35)), float(r.uniform(40, 900)))
                for i in range(18)]
    else:
        rows = [("S", i + 1, f"i{i}", float(r.integers(0, 4) * 10), float(r.integers(1, 4) * 1000), float(r.integers(0, 3) * 5),
                 float(r.integers(1, 5) * 100)) for i in range(14)]
        rows += [("S", 20, "twin", *rows[3][3:]), ("S", 21, "same fibre", 10.0, 1000.0, 5.0, 100.0)]
    log = []
    got = facets_of.active_facets(facets_of.catalog_rows(spark.createDataFrame(rows, CAT_SCHEMA)), log).collect()
    have = {(tuple(sorted(x[f"s{j}_pos"] for j in range(x.nb))), tuple(a for a in ("cp", "energy", "fiber") if x[f"tight_{a}"])) for x in got}
    want = _enumerated(rows)
    assert have <= want and len(got) == len(have)
    if seed < 3:
        assert have == want
    else:  # rows that no walk makes active are level with active ones: equal costs
        active = {p for ps, _ in have for p in ps}
        assert {w for w in want if set(w[0]) <= active} == have


def test_two_thousand_ingredients(spark):
    """Few ingredients matter, few rounds find them, and no ingredient undercuts
    a facet."""
    r = np.random.default_rng(5)
    rows = [("S", i + 1, f"i{i}", float(r.uniform(2, 60)), float(r.uniform(1500, 4000)), float(r.uniform(0, 35)), 0.0) for i in range(2000)]
    rows = [(*x[:6], float(40 + 6 * x[3] + x[4] / 20 + r.uniform(0, 300))) for x in rows]
    log = []
    got = facets_of.active_facets(facets_of.catalog_rows(spark.createDataFrame(rows, CAT_SCHEMA)), log).collect()
    assert len(log) <= 8 and log[-1][0] < 300, log
    a = np.array([[1.0, x[3], x[4], x[5]] for x in rows])
    y = np.array([[g.y0, g.y_cp, g.y_energy, g.y_fiber] for g in got])
    assert (a @ y.T <= np.array([x[6] for x in rows])[:, None] * (1 + 1e-6) + 1e-6).all()


def test_facets_of_unchanged_species_are_kept(spark, tmp_path):
    """After an edit of one species the other's tables are the files they were."""
    import glob
    import os
    folder = str(tmp_path / "f")
    files = lambda: {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{folder}/batch=*/**/*.parquet", recursive=True)}
    old = spark.createDataFrame(CAT, CAT_SCHEMA)
    t = spark.createDataFrame([("S", 18.0, 2900.0, None, None), ("T", 11.0, 2050.0, None, None)],
                              "species string, cp_req double, energy_req double, fiber_min double, fiber_max double")
    solve = lambda cat: {r.species: r.total_cost for r in ration.solve(t, facets_of.of_catalog(cat, folder)).collect()}
    first = solve(old)
    before = files()
    edited = solve(old.withColumn("cost", F.expr("CASE WHEN species = 'T' THEN cost * 3 ELSE cost END")))
    assert edited["S"] == first["S"] and abs(edited["T"] - 3 * first["T"]) < 1e-6
    new = {p for p in files() if p not in before}
    assert new and all(files()[p] == m for p, m in before.items())
    made = spark.read.parquet(*{os.path.dirname(p) for p in new if "/facets/" in p})
    assert {r.species for r in made.select("species").distinct().collect()} == {"T"}
    again = files()
    assert solve(old) == first and files() == again  # the first version is still there


def test_rows_without_a_species_are_nobodys(spark, tmp_path):
    rows = [(s, i, f"i{i}", 10.0 + i, 2000.0 + 100 * i, 5.0, 50.0 + 7 * i) for s in ("a", None) for i in range(4)]
    catalog = spark.createDataFrame(rows, CAT_SCHEMA)
    for _ in range(2):  # worked out, then kept
        found = facets_of.of_catalog(catalog, str(tmp_path))
        assert [r.species for r in found.facets.select("species").distinct().collect()] == ["a"]
