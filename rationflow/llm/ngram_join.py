"""Operator 1: exact Jaccard self-join on word n-grams with set-relation skipping.

Which n-grams can matter is settled first.  Tasks send the n-grams of their
documents' distinct sets, packed in blocks, to parts of the n-gram space; a
part counts in how many distinct sets each of its n-grams occurs and sends the
shared ones back.  A set whose shared n-grams are fewer than the least overlap
any link needs has no partner and goes no further; the others keep their shared
n-grams, rarest first.

Lists of the index hold, for each n-gram of a prefix (as long as the least
overlap allows it to be missed), the sets that have it there, with the position.
Answers are derived along set relations instead of being computed per pair:

* Each set is first compared with one set only, the most central one (fewest
  unshared n-grams) of the lists it shares most.  If they link, its later
  answers follow from that leader's: Jaccard distance is a metric, so sets x
  and z with leaders a and b can link only if d(a,b) <= limit + d(x,a) + d(z,b).
* In every list the members of one leader form a block with its size range and
  its smallest position; two blocks are skipped as a whole when sizes or the
  overlap possible after those positions rule out any link.  Blocks that remain
  cost one comparison of their leaders.  Linked leaders settle all their
  members (one component); too distant ones settle that no members link.
* Only members of leaders in between, and not yet in one component, are
  compared themselves, entry by entry, under the position bound.

Components then come from the links by star rounds.  Groups of equal sets take
part once; a document of such a group finds its component through its set.

Defined cases: null text is empty; a document without words has an empty set,
links with nothing and is its own component; fewer than ``n`` words make one
n-gram of all of them; repeated rows are equal sets; an empty table gives no
rows; null ``doc_id`` never is a component's id while another id is there;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .util import WordHashes, bounded_batches, flat_hashes, mix, raw_text, shuffle_partitions, tidy, tidy_group, window_hashes, words_of, written

#: n-grams a part of the index counts at once, about.
PART_KEYS = 2_000_000
BATCH = 2000
NO_SET = b"\0" * 16


def shingle_sets(texts: list[bytes], n: int, cache: WordHashes) -> tuple[list[np.ndarray], list[bytes]]:
    """(sorted distinct n-gram hashes, id of that set) of each text; the id is
    a 128-bit digest of the set, NO_SET for the empty set."""
    flat, lens = flat_hashes(words_of(texts), cache)
    grams = window_hashes(flat, n)
    ends = np.cumsum(lens)
    sets, ids = [], []
    for a, b in zip((ends - lens).tolist(), ends.tolist(), strict=True):
        if b - a >= n:
            s = np.sort(grams[a:b - n + 1])
            s = s[np.append(True, s[1:] != s[:-1])]
        elif b > a:  # the whole sequence as one, apart from any n-gram
            h = window_hashes(flat[a:b], b - a)[:1]
            s = mix(h ^ np.uint64(0x51ED270B7A2C + b - a))
        else:
            s = flat[:0]
        sets.append(s)
        ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else NO_SET)
    return sets, ids


def document_sets(docs: DataFrame, n: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, sid, n) of every row."""
    def run(batches):
        cache = WordHashes()
        for b in batches:
            sets, ids = shingle_sets(b.column(0).to_pylist(), n, cache)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(ids, pa.binary()), pa.array(list(map(len, sets)), pa.int64())],
                                             names=["doc_id", "sid", "n"])

    return bounded_batches(docs.select(raw_text(text), F.col(key).cast("long").alias("doc_id")), BATCH).mapInArrow(
        tidy(run), "doc_id long, sid binary, n long")


def _blocks(docs: DataFrame, n: int, parts: int, text: str) -> DataFrame:
    """Packed n-grams: one row for each batch of documents and part."""
    def run(batches):
        cache, sent = WordHashes(), set()
        for b in batches:
            sets, ids = shingle_sets(b.column(0).to_pylist(), n, cache)
            fresh = []
            for i, sid in enumerate(ids):
                if sid != NO_SET and sid not in sent:
                    sent.add(sid)
                    fresh.append(i)
            if not fresh:
                continue
            flat = np.concatenate([sets[i] for i in fresh])
            size = np.array([len(sets[i]) for i in fresh], np.int64)
            own = np.frombuffer(b"".join(ids[i] for i in fresh), np.dtype("V16"))
            name = xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)
            doc = np.repeat(np.arange(len(fresh), dtype=np.int64), size)
            part = (flat % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part.astype(np.uint16) if parts < 65536 else part, kind="stable")
            part, flat, doc = part[order], flat[order], doc[order]
            cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist() + [len(part)]
            rows = {"part": [], "batch": [], "sids": [], "sizes": [], "counts": [], "grams": []}
            for a, e in zip(cuts[:-1], cuts[1:], strict=True):
                some, count = np.unique(doc[a:e], return_counts=True)
                for c, v in (("part", int(part[a])), ("batch", name), ("sids", own[some].tobytes()),
                             ("sizes", size[some].astype(np.int32).tobytes()), ("counts", count.astype(np.int32).tobytes()),
                             ("grams", flat[a:e].tobytes())):
                    rows[c].append(v)
            yield pa.RecordBatch.from_pydict(
                {c: pa.array(v, pa.int64() if c in ("part", "batch") else pa.binary()) for c, v in rows.items()})

    return bounded_batches(docs.select(raw_text(text)), BATCH).mapInArrow(
        tidy(run), "part long, batch long, sids binary, sizes binary, counts binary, grams binary")


def _runs(sid: np.ndarray, then: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by set id and ``then``, where in it a new set id starts)."""
    half = np.ascontiguousarray(sid).view(np.uint64).reshape(-1, 2)
    order = np.lexsort((then, half[:, 1], half[:, 0]))
    half = half[order]
    return order, np.append(True, (half[1:] != half[:-1]).any(axis=1))


def _shared(table: pa.Table) -> pa.Table:
    """Of one part: the n-grams that two or more distinct sets have, with the
    number of those sets, for the first batch that holds each set."""
    cells = lambda c, t: [np.frombuffer(x, t) for x in table.column(c).to_pylist()]
    sids, sizes, counts = cells("sids", np.dtype("V16")), cells("sizes", np.int32), cells("counts", np.int32)
    grams = np.concatenate(cells("grams", np.uint64))
    names = table.column("batch").to_numpy()
    sid, size, count = np.concatenate(sids), np.concatenate(sizes), np.concatenate(counts)
    batch = np.repeat(np.arange(len(names)), [len(x) for x in sids])
    order, new = _runs(sid, names[batch])
    owner = np.zeros(len(sid), bool)
    owner[order[new]] = True
    entry = np.repeat(np.arange(len(sid), dtype=np.int32), count)
    keep = owner[entry]
    grams, entry = grams[keep], entry[keep]
    by = np.argsort(grams, kind="stable")
    start = np.flatnonzero(np.append(True, grams[by][1:] != grams[by][:-1]))
    times = np.diff(np.append(start, len(grams)))
    df = np.empty(len(grams), np.int32)
    df[by] = np.repeat(times.astype(np.int32), times)
    ok = df > 1
    grams, entry, df = grams[ok], entry[ok], df[ok]
    out = {"batch": [], "sids": [], "sizes": [], "counts": [], "grams": [], "dfs": []}
    for a, e in zip(*(lambda c: (c[:-1], c[1:]))(np.searchsorted(batch[entry], np.arange(len(names) + 1)).tolist()), strict=True):
        if a == e:
            continue
        some, n = np.unique(entry[a:e], return_counts=True)
        for c, v in (("batch", names[batch[some[0]]]), ("sids", sid[some].tobytes()), ("sizes", size[some].tobytes()),
                     ("counts", n.astype(np.int32).tobytes()), ("grams", grams[a:e].tobytes()), ("dfs", df[a:e].tobytes())):
            out[c].append(v)
    return pa.table({c: pa.array(v, pa.int64() if c == "batch" else pa.binary()) for c, v in out.items()})


def _sets_of_batch(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        """The sets of one batch that may have a partner, shared n-grams first by rarity."""
        cat = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()])
        sid, size, count = cat("sids", np.dtype("V16")), cat("sizes", np.int32), cat("counts", np.int32)
        grams, df = cat("grams", np.uint64), cat("dfs", np.int32)
        order, new = _runs(sid, np.arange(len(sid)))
        number = np.empty(len(sid), np.int64)
        number[order] = np.cumsum(new) - 1
        first = order[new]
        of = np.repeat(number, count)
        shared = np.bincount(of, minlength=len(first))
        may = shared * den >= num * size[first].astype(np.int64)
        keep = may[of]
        grams, df, of = grams[keep], df[keep], of[keep]
        by = np.lexsort((grams, df, of))
        grams, of = grams[by].view(np.int64), of[by]
        ends = np.searchsorted(of, np.arange(len(first) + 1))
        some = np.flatnonzero(may)
        upto = np.append(ends[some], ends[some[-1] + 1] if len(some) else 0).astype(np.int32)  # sets left out have no n-grams left
        return pa.table({
            "sid": pa.array([sid[first[i]].tobytes() for i in some.tolist()], pa.binary()),
            "n": pa.array(size[first[some]].astype(np.int64)),
            "unshared": pa.array(size[first[some]].astype(np.int64) - shared[some]),
            "grams": pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(grams))})

    return run


def candidate_sets(docs: DataFrame, n: int, num: int, den: int, grams_in_all: int, text: str = "text") -> DataFrame:
    """(sid, n, unshared, grams): the distinct sets that can have a partner,
    with the n-grams other sets have too, rarest first."""
    parts = max(shuffle_partitions(docs.sparkSession), grams_in_all // PART_KEYS + 1)
    shared = (_blocks(docs, n, parts, text).groupBy("part").applyInArrow(
        tidy_group(_shared), "batch long, sids binary, sizes binary, counts binary, grams binary, dfs binary"))
    return shared.groupBy("batch").applyInArrow(
        tidy_group(_sets_of_batch(num, den)), "sid binary, n long, unshared long, grams array<long>")


def _compared(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    """Adds the overlap, the sizes na and nb, and the Jaccard distance."""
    side = lambda c, s: sets.select(F.col("sid").alias(c), F.col("n").alias(f"n{s}"), F.col("grams").alias(f"g{s}"))
    both = (pairs.join(side(a, "a"), a).join(side(b, "b"), b)
            .withColumn("overlap", F.size(F.array_intersect("ga", "gb")).cast("long")).drop("ga", "gb"))
    return both.withColumn("dist", 1.0 - F.col("overlap") / (F.col("na") + F.col("nb") - F.col("overlap")))


def set_components(sets: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """(node, component) under the ids in ``reps`` (sid, rep): the components
    of all links of the join; sets without a link are not listed."""
    limit = 1 - num / den + 1e-9
    links = lambda: (den + num) * F.col("overlap") >= num * (F.col("na") + F.col("nb"))
    # the prefix of a set, cut to its shared n-grams
    entries = (sets.select("sid", "n", "unshared", F.posexplode(F.expr(
        f"slice(grams, 1, cast(greatest(n - cast(({num} * n + {den - 1}) div {den} as bigint) + 1 - unshared, 0) as int))"))
        .alias("at", "gram")).withColumn("pos", F.col("unshared") + F.col("at")).drop("at"))
    entries = written(entries)

    # one comparison a set: with the most central set of the lists it shares most
    centre = (entries.groupBy("gram").agg(F.min(F.struct("unshared", "sid")).alias("c"), F.count("*").alias("k"))
              .where("k > 1").select("gram", F.col("c.sid").alias("leader")))
    votes = (entries.join(centre, "gram").where("sid != leader").groupBy("sid", "leader").agg(F.count("*").alias("k"))
             .groupBy("sid").agg(F.max(F.struct("k", "leader")).alias("v")).select("sid", F.col("v.leader").alias("leader")))
    stars = written(_compared(votes, sets, "sid", "leader").where(links()).select("sid", "leader", "dist"))
    bound = stars.select(F.col("sid").alias("leader"), F.lit(True).alias("_bound"))
    # who follows a set that itself follows another one leads itself
    led = written(sets.select("sid").join(stars.join(bound, "leader", "left"), "sid", "left").select(
        "sid", F.when(F.col("_bound").isNull() & F.col("dist").isNotNull(), F.col("leader")).otherwise(F.col("sid")).alias("leader"),
        F.when(F.col("_bound").isNull() & F.col("dist").isNotNull(), F.col("dist")).otherwise(0.0).alias("dist")))

    # blocks of the lists, one for each leader; whole blocks are skipped
    member = entries.join(led, "sid")
    blocks = member.groupBy("gram", "leader").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("rest"))
    several = blocks.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1").select("gram")
    blocks = written(blocks.join(several, "gram"))
    x, z = blocks.alias("x"), blocks.alias("z")
    pairs = (x.join(z, (F.col("x.gram") == F.col("z.gram")) & (F.col("x.leader") < F.col("z.leader"))
                    & (den * F.col("x.hi") >= num * F.col("z.lo")) & (den * F.col("z.hi") >= num * F.col("x.lo"))
                    & ((den + num) * F.least("x.rest", "z.rest") >= num * (F.col("x.lo") + F.col("z.lo"))))
             .select(F.col("x.leader").alias("a"), F.col("z.leader").alias("b")).distinct())
    radius = led.groupBy("leader").agg(F.max("dist").alias("r"))
    told = written(_compared(pairs, sets, "a", "b")
                   .join(radius.select(F.col("leader").alias("a"), F.col("r").alias("ra")), "a")
                   .join(radius.select(F.col("leader").alias("b"), F.col("r").alias("rb")), "b")
                   .select("a", "b", "dist", "ra", "rb", links().alias("linked"))
                   .where(F.col("linked") | (F.col("dist") <= limit + F.col("ra") + F.col("rb")) & (F.col("ra") + F.col("rb") > 0)))
    rep = reps.select("sid", "rep")
    as_ids = lambda d, a, b: (d.join(rep.select(F.col("sid").alias(a), F.col("rep").alias("_a")), a)
                              .join(rep.select(F.col("sid").alias(b), F.col("rep").alias("_b")), b)
                              .select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    found = as_ids(stars, "sid", "leader").union(as_ids(told.where("linked"), "a", "b"))
    part = written(components(found))
    between = told.where("not linked").select("a", "b", "dist")
    if between.isEmpty():
        return part

    # members of leaders that are neither near nor far, and still apart: the
    # lists again, in blocks of one component and a range of positions; only
    # the members of two blocks that can link meet, under their own bounds
    place = rep.join(part.withColumnRenamed("node", "rep"), "rep", "left").select(
        "sid", F.coalesce("component", "rep").alias("comp"))
    unsettled = between.select(F.col("a").alias("leader")).union(between.select(F.col("b").alias("leader"))).distinct()
    member = written(member.join(unsettled, "leader").join(place, "sid").select(
        "gram", "sid", "leader", "n", (F.col("n") - F.col("pos")).alias("rest"), "dist", "comp",
        F.floor(F.log2(F.col("pos") + 1)).alias("band")))
    blocks = member.groupBy("gram", "comp", "band").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("rest").alias("rest"))
    several = blocks.groupBy("gram").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 < c2").select("gram")
    blocks = blocks.join(several, "gram")
    x, z = blocks.alias("x"), blocks.alias("z")
    meet = (x.join(z, (F.col("x.gram") == F.col("z.gram")) & (F.col("x.comp") < F.col("z.comp"))
                   & (den * F.col("x.hi") >= num * F.col("z.lo")) & (den * F.col("z.hi") >= num * F.col("x.lo"))
                   & ((den + num) * F.least("x.rest", "z.rest") >= num * (F.col("x.lo") + F.col("z.lo"))))
            .select(F.col("x.gram").alias("gram"), F.col("x.comp").alias("cx"), F.col("x.band").alias("bx"),
                    F.col("z.comp").alias("cz"), F.col("z.band").alias("bz")))
    side = lambda s: member.select("gram", F.col("comp").alias(f"c{s}"), F.col("band").alias(f"b{s}"), F.col("sid").alias(s),
                                   F.col("leader").alias(f"l{s}"), F.col("n").alias(f"n{s}"), F.col("rest").alias(f"r{s}"),
                                   F.col("dist").alias(f"d{s}"))
    one = meet.join(side("x"), ["gram", "cx", "bx"])
    two = side("z")
    fits = ((den * F.col("nx") >= num * F.col("nz")) & (den * F.col("nz") >= num * F.col("nx"))
            & ((den + num) * F.least("rx", "rz") >= num * (F.col("nx") + F.col("nz"))) & (F.col("dx") + F.col("dz") > 0))
    same = (one["gram"] == two["gram"]) & (one["cz"] == two["cz"]) & (one["bz"] == two["bz"])
    near = (one.join(two, same & fits).select("x", "z", F.least("lx", "lz").alias("a"), F.greatest("lx", "lz").alias("b"), "dx", "dz")
            .distinct().join(between.withColumnRenamed("dist", "dab"), ["a", "b"])
            .where(F.col("dab") <= limit + F.col("dx") + F.col("dz")).select("x", "z"))
    more = written(as_ids(_compared(near, sets, "x", "z").where(links()), "x", "z"))
    if more.isEmpty():
        return part
    return components(part.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))


def ngram_join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id of every row: documents link when
    den * |intersection| >= num * |union| of their n-gram sets."""
    rows = written(document_sets(docs, n, text, key))
    in_all = rows.agg(F.sum("n")).first()[0] or 0
    some = rows.where("n > 0")
    # a set stands under its least document (under a hash if all ids are null)
    reps = written(some.groupBy("sid").agg(F.min("doc_id").alias("least"))
                   .select("sid", "least", F.coalesce("least", F.xxhash64("sid")).alias("rep")))
    sets = written(candidate_sets(docs, n, num, den, in_all, text))
    parts = set_components(sets, reps.join(sets.select("sid"), "sid", "left_semi"), num, den)
    placed = (reps.join(parts.withColumnRenamed("node", "rep"), "rep", "left")
              .select("sid", "least", F.coalesce("component", "rep").alias("part")))
    least = (placed.select("sid", "part").join(placed.groupBy("part").agg(F.min("least").alias("component_id")), "part")
             .select("sid", "component_id"))
    return (rows.join(least, "sid", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))
