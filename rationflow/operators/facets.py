"""Facets of the parametric ration problem: found by walking from neighbour to
neighbour (D7, D8), kept per species and content (A7).

Prices y = (y0, y_cp, y_energy, y_fiber) of the constraint rows are feasible
when no ingredient is dearer to replace than it costs,
``y0 + y_cp cp_i + y_energy energy_i + y_fiber fiber_i <= cost_i``, and
``y_cp, y_energy >= 0``.  A facet is a corner of that polyhedron (with fibre
tight) or of its cut ``y_fiber = 0`` (without), together with one choice of
tight rows that gives the corner.  From a corner the ratio test over the
ingredients gives the next corner along every edge, so all facets are reached
from one; nothing is enumerated that is not a facet.

The walk of a species runs in one task over its *active* ingredients: those
tight at some corner found so far.  Spark prices the whole catalog against the
corners and the unbounded edges of every walk (a join on the species with one
aggregate a corner); ingredients that undercut join the active set, and the
walk is done again until none is left.  Corners that no ingredient of the
catalog undercuts, and edges that none bounds, are those of the whole catalog.
The task never holds more than the ingredients that matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import cofactors
from ..session import path_exists, write_table

ATTRS = ("cp", "energy", "fiber")
MAX_SLOTS = 4
SLOT_FIELDS = ("pos", "ingredient", "cost", "cp", "energy", "fiber")
# Numeric tolerances (fixed values of the method, not tuning knobs).
DET_REL_TOL = 1e-10
REDUCED_COST_TOL = 1e-7
DUAL_SIGN_TOL = 1e-9
RATE_TOL = 1e-10
# Steps of each nutrient's price in the grid of directions of the first active set.
DIRECTIONS = 6
# Corners whose neighbours are worked out at once.
WAVE = 256

_SLOT_TYPES = dict(zip(SLOT_FIELDS, ("bigint", "string", "double", "double", "double", "double"), strict=True))
_LINEAR = ("0", *ATTRS)
#: One corner (fid not null) or unbounded edge of a walk.  s{j}_k*: the share of
#: slot j, linear in the right-hand side; {a}_*: the nutrient reached, likewise.
WALK_SCHEMA = ", ".join(
    ["species string", "edge boolean", "nb int", *[f"tight_{a} boolean" for a in ATTRS], "y0 double", *[f"y_{a} double" for a in ATTRS]]
    + [f"s{j}_{c} {_SLOT_TYPES[c]}" for j in range(MAX_SLOTS) for c in SLOT_FIELDS]
    + [f"s{j}_k{t} double" for j in range(MAX_SLOTS) for t in _LINEAR]
    + [f"{a}_{t} double" for a in ATTRS for t in _LINEAR])


# -- the walk of one species ---------------------------------------------------

class Polyhedron:
    """{y: rows y <= bound}: the ingredients' rows, then -y_cp and -y_energy."""

    def __init__(self, cat: pd.DataFrame, fiber: bool):
        names = ATTRS if fiber else ATTRS[:2]
        self.scale = np.array([1.0] + [max(float(cat[a].abs().max()), 1e-12) for a in names])
        self.n, self.dim = len(cat), 1 + len(names)
        own = np.column_stack([np.ones(self.n)] + [cat[a].to_numpy(float) for a in names]) / self.scale
        signs = np.zeros((2, self.dim))
        signs[0, 1] = signs[1, 2] = -1.0
        self.rows = np.vstack([own, signs])
        cost = cat["cost"].to_numpy(float)
        self.bound = np.append(cost, [0.0, 0.0])
        self.zero = np.append(REDUCED_COST_TOL * (1 + np.abs(cost)), DUAL_SIGN_TOL * self.scale[1:3])

    def first(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """(a basis to start from, unbounded edges met on the way)."""
        cheapest = int(np.argmin(self.bound[:self.n]))
        start = [cheapest, self.n, self.n + 1]
        if self.dim == 3:
            return np.array([start]), []
        # no price on cp and energy: along the fibre price to the next ingredient
        found, edges = [], []
        for way in (1.0, -1.0):
            d = np.zeros(self.dim)
            d[3], d[0] = way, -way * self.rows[cheapest, 3]
            y = np.zeros(self.dim)
            y[0] = self.bound[cheapest]
            rate = self.rows @ d
            rate[start] = 0
            hit = np.flatnonzero(rate > RATE_TOL)
            if len(hit):
                t = np.maximum(self.bound - self.rows @ y, 0)[hit] / rate[hit]
                found += [start + [int(i)] for i in hit[t <= t.min() + 1e-12]]
            else:
                edges.append(d)
        return np.sort(np.array(found, np.int64).reshape(-1, self.dim), axis=1), edges

    def neighbours(self, bases: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(which of the bases are feasible, neighbours of those, their
        unbounded edges)."""
        m = self.rows[bases]
        det = np.linalg.det(m)
        sound = np.abs(det) > 1e-13
        inv = np.linalg.inv(np.where(sound[:, None, None], m, np.eye(self.dim)))
        y = np.einsum("fij,fj->fi", inv, self.bound[bases])
        slack = self.bound - y @ self.rows.T
        np.put_along_axis(slack, bases, 0.0, axis=1)
        sound &= (slack >= -self.zero).all(axis=1)
        inv, slack, bases = inv[sound], slack[sound], bases[sound]
        rate = -np.einsum("mi,fir->fmr", self.rows, inv)  # moving off tight row r
        inside = np.zeros(slack.shape, bool)
        np.put_along_axis(inside, bases, True, axis=1)
        rate[inside] = 0
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(rate > RATE_TOL, np.maximum(slack, 0)[:, :, None] / rate, np.inf)
        least = t.min(axis=1, keepdims=True)
        enters = (t <= least * (1 + 1e-9) + 1e-12) & np.isfinite(t)
        # several rows meet at the corner: its other bases
        enters |= ((slack <= self.zero) & ~inside)[:, :, None] & (np.abs(rate) > RATE_TOL)
        f, i, r = np.nonzero(enters)
        new = bases[f].copy()
        new[np.arange(len(f)), r] = i
        ef, er = np.nonzero(~np.isfinite(least[:, 0, :]))
        return sound, np.unique(np.sort(new, axis=1), axis=0), list(-inv[ef, :, er])

    def walk(self) -> tuple[np.ndarray, np.ndarray]:
        """(all feasible bases, all unbounded edges)."""
        front, edges = self.first()
        seen: set[bytes] = set()
        kept = []
        while len(front):
            todo = []
            for b in front:
                if (name := b.tobytes()) not in seen:
                    seen.add(name)
                    todo.append(b)
            front = []
            for at in range(0, len(todo), WAVE):
                wave = np.array(todo[at:at + WAVE])
                sound, near, rays = self.neighbours(wave)
                kept.append(wave[sound])
                edges += rays
                front.extend(near)
        rays = np.array(edges).reshape(-1, self.dim)
        if len(rays):
            rays = np.unique(np.round(rays / np.maximum(np.abs(rays).max(axis=1, keepdims=True), 1e-300), 12), axis=0) / self.scale
        bases = np.concatenate(kept) if kept else np.zeros((0, self.dim), np.int64)
        return bases, rays


def _facet_rows(cat: pd.DataFrame, bases: np.ndarray, n: int, fiber: bool) -> Iterator[pd.DataFrame]:
    """Bases with their duals and primal solutions, both in closed form."""
    pos_order = np.argsort(cat["pos"].to_numpy(), kind="stable")
    rank = np.empty(n, np.int64)
    rank[pos_order] = np.arange(n)
    values = {c: cat[c].to_numpy() for c in SLOT_FIELDS}
    tight_cp, tight_energy = ~(bases == n).any(axis=1), ~(bases == n + 1).any(axis=1)
    for cp in (False, True):
        for energy in (False, True):
            some = bases[(tight_cp == cp) & (tight_energy == energy)]
            tight = [a for a, on in zip(ATTRS, (cp, energy, fiber), strict=True) if on]
            k = len(tight) + 1
            if not len(some):
                continue
            own = np.sort(np.where(some < n, rank[np.minimum(some, n - 1)], n), axis=1)[:, :k]
            ids = pos_order[own]
            cost = [values["cost"][ids[:, j]] for j in range(k)]
            m = [[np.ones(len(ids))] * k] + [[values[a][ids[:, j]] for j in range(k)] for a in tight]
            c = cofactors(m)
            det = sum(c[0])  # the first row is all ones
            scale = np.ones(len(ids))
            for row in m[1:]:
                scale = scale * np.maximum(np.abs(row).max(axis=0), 1e-300)
            good = np.abs(det) > DET_REL_TOL * scale
            det = np.where(good, det, 1.0)
            inv = [[c[r][j] / det for r in range(k)] for j in range(k)]  # share j by right-hand side r
            y = [sum(cost[j] * inv[j][r] for j in range(k)) for r in range(k)]
            out = {"edge": False, "nb": k, **{f"tight_{a}": a in tight for a in ATTRS}, "y0": y[0]}
            price = {a: y[1 + tight.index(a)] if a in tight else np.zeros(len(ids)) for a in ATTRS}
            out |= {f"y_{a}": price[a] for a in ATTRS}
            good &= (price["cp"] >= -DUAL_SIGN_TOL) & (price["energy"] >= -DUAL_SIGN_TOL)
            for i in range(0, len(ids), WAVE):  # priced against all active ingredients
                s = slice(i, i + WAVE)
                rc = values["cost"] - (y[0][s, None] + sum(price[a][s, None] * values[a] for a in ATTRS))
                good[s] &= (rc >= -REDUCED_COST_TOL * (1 + np.abs(values["cost"]))).all(axis=1)
            for j in range(MAX_SLOTS):
                for f in SLOT_FIELDS:
                    out[f"s{j}_{f}"] = values[f][ids[:, j]] if j < k else None
                out[f"s{j}_k0"] = inv[j][0] if j < k else 0.0
                for a in ATTRS:
                    out[f"s{j}_k{a}"] = inv[j][1 + tight.index(a)] if j < k and a in tight else 0.0
            for a in ATTRS:
                for t in _LINEAR:
                    out[f"{a}_{t}"] = sum((values[a][ids[:, j]] * out[f"s{j}_k{t}"] for j in range(k)), np.zeros(len(ids)))
            yield pd.DataFrame(out, index=range(len(ids)))[good]


def walk_species(cat: pd.DataFrame) -> pd.DataFrame:
    """All corners and unbounded edges over one species' active ingredients
    (rows of ``WALK_SCHEMA``)."""
    names = [f.strip().split(" ")[0] for f in WALK_SCHEMA.split(",")]
    cat = cat.reset_index(drop=True)
    found = []
    for fiber in (False, True):
        poly = Polyhedron(cat, fiber)
        bases, edges = poly.walk()
        found += list(_facet_rows(cat, bases, poly.n, fiber))
        if len(edges):
            found.append(pd.DataFrame({"edge": True, "y0": edges[:, 0], "y_cp": edges[:, 1], "y_energy": edges[:, 2],
                                       "y_fiber": edges[:, 3] if fiber else 0.0}))
    rows = [r for f in found for r in f.to_dict("records")]
    out = pd.DataFrame.from_records(rows, columns=names)
    out["species"] = cat["species"].iloc[0]
    return out.astype({c: object for c in ("species", *(f"s{j}_ingredient" for j in range(MAX_SLOTS)))})


# -- pricing rounds over the catalog -------------------------------------------

def _first_active(cat: DataFrame) -> DataFrame:
    """Ingredients cheapest in some direction of prices: a hash aggregate of
    the catalog per direction, whatever its size."""
    span = cat.groupBy("species").agg(
        F.max(F.abs("cost")).alias("_kc"), *[F.max(F.abs(a)).alias(f"_k{a}") for a in ATTRS])
    g = DIRECTIONS
    way = F.explode(F.sequence(F.lit(-2), F.lit(g * g * g - 1))).alias("w")
    unit = lambda c, k: F.col(c) / F.greatest(F.col(k), F.lit(1e-300))
    rows = cat.withColumn("_row", F.struct(*cat.columns)).join(span, "species").select(
        "species", "_row", way, unit("cost", "_kc").alias("c"), *[unit(a, f"_k{a}").alias(a) for a in ATTRS])
    step = lambda e: F.expr(f"0.5D * ({e}) / {g - 1} / (1.0D - 0.9D * ({e}) / {g - 1})")  # noqa: E731  0 .. 5, finer near 0
    fiber = step(f"abs(2 * (w div {g * g}) - {g - 1})") * F.expr(f"sign(2 * (w div {g * g}) - {g - 1})")
    inside = F.col("c") - step(f"w % {g}") * F.col("cp") - step(f"w div {g} % {g}") * F.col("energy") - fiber * F.col("fiber")
    price = F.when(F.col("w") >= 0, inside).when(F.col("w") == -1, F.col("c")).otherwise(-F.col("cp"))
    return (rows.withColumn("p", price).groupBy("species", "w")
            .agg(F.min(F.struct("p", F.col("_row.pos").alias("pos"), "_row")).alias("m")).select("m._row.*").distinct())


def active_facets(cat: DataFrame, log: list | None = None) -> DataFrame:
    """Corners of the whole catalog by walks and pricing rounds; each round is
    two written tables.  ``log`` receives (active ingredients, corners) of each."""
    cols = cat.columns
    active = write_table(_first_active(cat), "active")
    priced = cat.select(*[F.col(c).alias(f"_c_{c}") for c in cols])
    worth = "y0 + y_cp * _c_cp + y_energy * _c_energy + y_fiber * _c_fiber"
    while True:
        walked = write_table(active.groupBy("species").applyInPandas(walk_species, WALK_SCHEMA), "walk")
        if log is not None:
            log.append((active.count(), walked.where("NOT edge").count()))
        # a corner is undercut by an ingredient cheaper than its worth; an edge is
        # bounded by one whose worth grows along it
        gain = F.expr(f"CASE WHEN edge THEN {worth} ELSE {worth} - _c_cost END")
        least = F.expr(f"CASE WHEN edge THEN 1e-9D * (abs(y0) + abs(y_cp * _c_cp) + abs(y_energy * _c_energy) + abs(y_fiber * _c_fiber)) "
                       f"ELSE {REDUCED_COST_TOL} * (1 + abs(_c_cost)) END")
        duals = walked.select("species", "edge", "y0", *[f"y_{a}" for a in ATTRS]).withColumn("_corner", F.monotonically_increasing_id())
        best = (duals.join(priced, F.col("species") == F.col("_c_species")).withColumn("_gain", gain).where(F.col("_gain") > least)
                .groupBy("_corner").agg(F.max(F.struct("_gain", *[f"_c_{c}" for c in cols])).alias("b"))
                .select(*[F.col(f"b._c_{c}").alias(c) for c in cols]).distinct())
        more = write_table(best.join(active.select("species", "pos"), ["species", "pos"], "left_anti").select(*cols), "priced_in")
        if more.isEmpty():
            return walked.where("NOT edge").drop("edge")
        active = write_table(active.unionByName(more), "active")


def has_fiber(catalog: DataFrame) -> bool:
    return "fiber" in catalog.columns


def catalog_rows(catalog: DataFrame) -> DataFrame:
    fiber = F.coalesce(F.col("fiber").cast("double"), F.lit(0.0)) if has_fiber(catalog) else F.lit(0.0)
    return catalog.select("species", F.col("pos").cast("bigint").alias("pos"), "ingredient", F.col("cp").cast("double").alias("cp"),
                          F.col("energy").cast("double").alias("energy"), fiber.alias("fiber"), F.col("cost").cast("double").alias("cost"))


def with_sides(corners: DataFrame, with_fiber: bool) -> DataFrame:
    """One row a facet: a corner at the least, the most or no fibre bound."""
    side = F.when(~F.col("tight_fiber"), F.array(F.lit(None).cast("string"))).otherwise(
        F.filter(F.array(F.when(F.col("y_fiber") >= -DUAL_SIGN_TOL, F.lit("min")),
                         F.when(F.col("y_fiber") <= DUAL_SIGN_TOL, F.lit("max"))), lambda s: s.isNotNull()))
    if not with_fiber:
        corners = corners.where("NOT tight_fiber")
    return corners.withColumn("fiber_side", F.explode(side))


# -- point location ------------------------------------------------------------

#: Cells of the target space: steps of (cp, energy) for facets that leave the
#: fibre alone, of (cp, energy, fibre bound) for those at a fibre bound.
GRID, GRID_FIBER = (32, 32), (12, 12, 12)
#: Where the cells of each kind of facet begin.
AT = {None: 0, "min": GRID[0] * GRID[1], "max": GRID[0] * GRID[1] + GRID_FIBER[0] * GRID_FIBER[1] * GRID_FIBER[2]}
# How far beyond its cell a facet still counts as possible there.
CELL_SLACK = 1e-6


def spans(cat: DataFrame, with_fiber: bool) -> DataFrame:
    """Per species the range of each nutrient: the ends of the cells (the
    outermost cells have no end)."""
    return cat.groupBy("species").agg(
        *[F.min(a).alias(f"_{a}_lo") for a in ATTRS],
        *[F.greatest(F.max(a) - F.min(a), F.lit(1e-9)).alias(f"_{a}_w") for a in ATTRS]).withColumn("with_fiber", F.lit(with_fiber))


def cell_of(side: str | None) -> str:
    """The cell of a target among those of one kind (null where a value is);
    reads cp_req, energy_req and _fmin or _fmax beside the species' span."""
    def step(value: str, attr: str, steps: int) -> str:
        return f"cast(greatest(0, least({steps - 1}, floor(({value} - _{attr}_lo) / _{attr}_w * {steps}))) AS int)"
    n = GRID_FIBER if side else GRID
    plane = f"{step('cp_req', 'cp', n[0])} * {n[1]} + {step('energy_req', 'energy', n[1])}"
    if not side:
        return plane
    return f"{AT[side]} + ({plane}) * {n[2]} + {step(f'_f{side}', 'fiber', n[2])}"


def cells(facets: DataFrame, span: DataFrame) -> DataFrame:
    """(species, cell, c): the facets that can be a ration's at some target of
    the cell, each with its prices and its number.  A facet is left out only where one of its own conditions (a share
    or a nutrient reached), which are linear, fails in the whole cell; cells
    without any are left out, too."""
    def ends(attr: str, i: str, n: int) -> list[str]:  # closed, and a little wider than the cell
        return [f"CASE WHEN {i} = 0 THEN double('-Infinity') ELSE _{attr}_lo + _{attr}_w * (({i}) - 1e-7D) / {n} END AS _{attr}_a",
                f"CASE WHEN {i} = {n - 1} THEN double('Infinity') ELSE _{attr}_lo + _{attr}_w * (({i}) + 1 + 1e-7D) / {n} END AS _{attr}_b"]

    def possible(form: dict[str, str], k0: str, scale: str) -> str:
        """k0 + sum of form reaches zero somewhere in the cell."""
        parts = [f"CASE WHEN {c} > 0 THEN ({c}) * _{a}_b WHEN {c} < 0 THEN ({c}) * _{a}_a ELSE 0.0D END" for a, c in form.items()]
        return f"{' + '.join([k0, *parts])} >= -{CELL_SLACK} * (1 + {scale})"

    def conditions(attrs: tuple[str, ...]) -> str:
        out = [possible({a: f"s{j}_k{a}" for a in attrs}, f"s{j}_k0", "0") for j in range(MAX_SLOTS)]
        for own in ("cp", "energy"):
            out.append(possible({a: f"({own}_{a}{' - 1' if a == own else ''})" for a in attrs}, f"{own}_0", f"abs(_{own}_lo) + _{own}_w"))
        return " AND ".join(out)

    # few rows that each become thousands: only what the conditions read, dealt
    # over the cores first
    needed = ["species", "fid", "fiber_side", "y0", *[f"y_{x}" for x in ATTRS], *[f"s{j}_k{t}" for j in range(MAX_SLOTS) for t in _LINEAR],
              *[f"{x}_{t}" for x in ("cp", "energy") for t in _LINEAR]]
    every = facets.select(*needed).join(span.drop("with_fiber"), "species").repartition(max(8, int(facets.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    (a, b), (p, q, r) = GRID, GRID_FIBER
    free = every.where("fiber_side IS NULL").withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(a * b - 1)))).selectExpr(
        "*", *ends("cp", f"_i div {b}", a), *ends("energy", f"_i % {b}", b)).where(conditions(("cp", "energy")))
    bound = every.where("fiber_side IS NOT NULL").withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(p * q * r - 1)))).selectExpr(
        "*", *ends("cp", f"_i div {q * r}", p), *ends("energy", f"_i div {r} % {q}", q), *ends("fiber", f"_i % {r}", r)).where(conditions(ATTRS))
    one = "struct(fid, y0, y_cp, y_energy, y_fiber) AS f"
    found = free.selectExpr("species", "_i AS cell", one).unionByName(
        bound.selectExpr("species", f"_i + CASE fiber_side WHEN 'min' THEN {AT['min']} ELSE {AT['max']} END AS cell", one))
    return found.groupBy("species", "cell").agg(F.collect_list("f").alias("c"))  # at most the facets of the species


# -- tables of a catalog ---------------------------------------------------------

@dataclass
class Facets:
    """What ``ration.solve`` looks up: the facets of every species (species,
    fid, f), all of a species in one row (species, fs), the cells and the spans."""
    facets: DataFrame
    lists: DataFrame
    cells: DataFrame
    spans: DataFrame


TABLES = ("facets", "lists", "cells", "spans")


def prepare(catalog: DataFrame, log: list | None = None, keep: list[str] = (),
            table: Callable[[DataFrame, str], DataFrame] = write_table) -> Facets:
    """Facets and cells of every species of ``catalog``, as written tables.

    ``catalog``: species, pos, ingredient, cp, energy, fiber (nullable; without
    the column requests are solved with the fibre constraint off, C8), cost;
    ``(species, ingredient)`` unique (apply ``first_per_key`` first).
    ``keep``: columns that belong to a species and stand in every table;
    ``table``: writes one of the results under its name and reads it back."""
    cat = write_table(catalog_rows(catalog), "catalog")
    own = catalog.select("species", *keep).distinct() if keep else None
    tag = (lambda df: df.join(own, "species")) if keep else (lambda df: df)
    corners = with_sides(active_facets(cat, log), has_fiber(catalog))
    numbered = corners.groupBy("species").agg(F.collect_list(F.struct(*[c for c in corners.columns if c != "species"])).alias("fs")).select(
        "species", F.posexplode("fs").alias("fid", "f"))  # at most a few thousand facets a species
    flat = table(tag(numbered), "facets")
    in_order = flat.groupBy("species").agg(F.sort_array(F.collect_list(F.struct("fid", "f"))).alias("fs"))
    span = table(tag(spans(cat, has_fiber(catalog))), "spans")
    return Facets(flat, table(tag(in_order), "lists"), table(tag(cells(flat.select("species", "fid", "f.*"), span.drop(*keep))), "cells"), span)


def versions(catalog: DataFrame) -> DataFrame:
    """(species, version): a version is the content of one species."""
    cols = [F.col(c) for c in ("species", "pos", "ingredient", "cp", "energy", "fiber", "cost") if c in catalog.columns]
    return catalog.groupBy("species").agg(F.concat_ws(
        "_", F.count("*"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(1), *cols)),
        F.lit(int(has_fiber(catalog)))).alias("version"))


def of_catalog(catalog: DataFrame, folder: str) -> Facets:
    """:func:`prepare`, kept under ``folder`` by the content of each species: only
    species whose content is new are worked out, and a saved catalog is never
    answered from the facets of an older one (A7).

    Every run writes a batch folder of its own and then its lines of the
    ledger (species, version, batch); what no ledger line names is not read, and
    of two runs that worked out the same version one is taken.  Rows without a
    species belong to no request's catalog."""
    spark, catalog = catalog.sparkSession, catalog.where("species IS NOT NULL")
    folder = folder.rstrip("/")
    now = versions(catalog)

    def state() -> DataFrame:
        """(species, version, batch) of the catalog; batch null if not kept."""
        kept = (spark.read.schema("species string, version string, batch string").parquet(f"{folder}/ledger")
                if path_exists(spark, f"{folder}/ledger") else spark.createDataFrame([], "species string, version string, batch string"))
        kept = kept.groupBy("species", "version").agg(F.min("batch").alias("batch"))
        return write_table(now.join(kept, ["species", "version"], "left"), "versions")

    used = state()
    new = used.where("batch IS NULL").select("species", "version")
    if not new.isEmpty():
        batch = f"b{uuid.uuid4().hex}"

        def table(rows: DataFrame, name: str) -> DataFrame:
            path, schema = f"{folder}/batch={batch}/{name}", rows.schema
            rows.write.parquet(path)
            return spark.read.schema(schema).parquet(path)

        prepare(catalog.join(new, "species"), keep=["version"], table=table)
        new.withColumn("batch", F.lit(batch)).coalesce(1).write.mode("append").parquet(f"{folder}/ledger")
        used = state()
    batches = sorted(r["batch"] for r in used.select("batch").distinct().collect())  # one a save that is still in use
    if not batches:
        return prepare(catalog)

    def read(name: str) -> DataFrame:
        rows = spark.read.option("basePath", folder).parquet(*[f"{folder}/batch={b}/{name}" for b in batches])
        return rows.join(used, ["species", "version", "batch"], "left_semi").drop("version", "batch")

    return Facets(*[read(name) for name in TABLES])
