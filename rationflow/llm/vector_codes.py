"""Operator 13: product codes of vectors, fitted over tries of their parts.

Components become integers (floor of ``scale`` times the component), vectors are
cut into equal consecutive parts, and the distinct parts of each position are
counted once and kept in lexicographic order in a written table.  Read in that
order they are the leaves of a trie over their components.  A task walks its
range of the trie depth first: the distances of a prefix to all entries of the
codebook are worked out once and every longer prefix adds one component's
squares to them, so parts with a common beginning share that work; a leaf takes
the nearest entry and adds its weighted components to that entry's sums.  Only
these sums (parts x entries rows of every task) leave the walk.  The order is
walked in blocks of rows, a level at a time within a block, and the vectors of
the path to a block's last leaf are handed to the next block.

The last assignment walks the trie of each batch's own distinct parts, so the
vectors themselves are never shuffled.

Defined cases: vectors that are null, empty, or hold null or non-finite components
are dropped, and so are those whose length is not that of the kept vector with
the smallest id; parts differ by one component where the length does not divide,
the longer ones first; integers beyond +-2**27 count as that bound, so that sums
stay whole; with fewer kept rows than entries the codebooks are smaller; null ids
come after all others when the first entries are chosen, equal ids go by their
components; equal distances take the lower index; entries without parts stay;
null labels are one group; an empty table gives no rows and empty codebooks;
further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .util import shuffle_partitions, written

BOUND = 1 << 27
#: Rows of a block of the walk.
BLOCK = 8192


class Walk:
    """Depth-first walk over one position's parts in ascending order."""

    def __init__(self, book: np.ndarray):
        self.book = book  # entries x components
        self.last: np.ndarray | None = None  # the latest leaf and the distances along its path
        self.path = np.zeros((book.shape[1], len(book)), np.int64)

    def block(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest entry, squared distance) of ascending parts that follow
        those walked before."""
        m, d = parts.shape
        above = np.empty((m, d), np.int64)
        above[1:] = parts[:-1]
        above[0] = parts[0] if self.last is None else self.last
        differs = parts != above
        if self.last is None:
            differs[0, 0] = True
        fresh = np.logical_or.accumulate(differs, axis=1)  # the prefix up to here is a node of its own
        dist, node = np.zeros((1, len(self.book)), np.int64), np.zeros(m, np.int64)
        for j in range(d):
            rows = np.flatnonzero(fresh[:, j])
            step = parts[rows, j][:, None] - self.book[None, :, j]
            here = dist[node[rows]] + step * step
            node = np.cumsum(fresh[:, j]) - 1
            if not fresh[0, j]:  # the first rows lie below a node of the block before
                here, node = np.concatenate([self.path[j][None], here]), node + 1
            dist = here
            self.path[j] = dist[node[-1]]
        self.last = parts[-1].copy()
        leaf = dist[node]
        best = leaf.argmin(axis=1)
        return best, leaf[np.arange(m), best]


def assign(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, squared distance) of parts in any order: the trie of
    the distinct ones is walked and each part takes its leaf's result."""
    if not parts.shape[1]:
        return np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    order = np.lexsort(parts.T[::-1])
    ranked = parts[order]
    new = np.append(True, (ranked[1:] != ranked[:-1]).any(axis=1))
    leaves, walk = ranked[new], Walk(book)
    found = [walk.block(leaves[i:i + BLOCK]) for i in range(0, len(leaves), BLOCK)]
    best, error = (np.concatenate(x) for x in zip(*found, strict=True))
    back = np.empty(len(parts), np.int64)
    back[order] = np.cumsum(new) - 1
    return best[back], error[back]


def cuts(dim: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of each part."""
    sizes = [dim // parts + (i < dim % parts) for i in range(parts)]
    return [(sum(sizes[:i]), n) for i, n in enumerate(sizes)]


def kept(vectors: DataFrame, scale: int = 4096, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """(vec_id, label, v): the vectors that count, as whole numbers."""
    v = F.col(vector)
    whole = F.transform(v, lambda x: F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.floor(
        F.when(F.abs(x) < BOUND, x).otherwise(F.signum(x) * BOUND).cast("double") * scale))).cast("int"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where((F.size(v) > 0) & fine).select(
        F.col(key).alias("vec_id"), F.col(label).alias("label"), whole.alias("v"))


def distinct_parts(rows: DataFrame, dim: int, parts: int) -> DataFrame:
    """(pos, part, weight): the distinct parts of each position in ascending
    order within every file.  Equal parts fold in each task first, so copies
    of one vector never meet as rows; the range cut comes after that."""
    pieces = F.array(*[F.struct(F.lit(i).alias("pos"), F.slice("v", s + 1, n).alias("part"))
                       for i, (s, n) in enumerate(cuts(dim, parts))])
    once = (rows.where(F.size("v") == dim).select(F.explode(pieces).alias("p"))
            .groupBy("p.pos", "p.part").agg(F.count("*").alias("weight")))
    spark = rows.sparkSession
    return written(once.repartitionByRange(shuffle_partitions(spark), "pos", "part").sortWithinPartitions("pos", "part"))


def _first_entries(rows: DataFrame, entries: int) -> list[list[int]]:
    return [list(r["v"]) for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]


SUMS = StructType([StructField("pos", IntegerType()), StructField("entry", IntegerType()),
                   StructField("n", LongType()), StructField("s", ArrayType(LongType()))])


def refine(leaves: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: every part to its nearest entry, then every entry with parts
    becomes the floor of their mean."""
    def run(batches):
        walk, at, n, s = None, -1, {}, {}
        for b in batches:
            pos = b.column(0).to_numpy()
            weight = b.column(2).to_numpy()
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            start = 0
            for lo, hi in _runs(pos):
                p = int(pos[lo])
                d = books[p].shape[1]
                block = flat[start:start + (hi - lo) * d].reshape(hi - lo, d)
                start += (hi - lo) * d
                if not d:
                    continue
                if p != at:
                    walk, at = Walk(books[p]), p
                    n.setdefault(p, np.zeros(len(books[p]), np.int64))
                    s.setdefault(p, np.zeros(books[p].shape, np.int64))
                for i in range(0, hi - lo, BLOCK):
                    leaf, w = block[i:i + BLOCK], weight[lo + i:min(hi, lo + i + BLOCK)]
                    best, _ = walk.block(leaf)
                    np.add.at(n[p], best, w)
                    np.add.at(s[p], best, leaf * w[:, None])
        out = [(p, e, int(n[p][e]), s[p][e].tolist()) for p in n for e in np.flatnonzero(n[p]).tolist()]
        yield pa.RecordBatch.from_pylist([dict(zip(SUMS.names, r, strict=True)) for r in out],
                                         schema=pa.schema([("pos", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()),
                                                           ("s", pa.list_(pa.int64()))]))

    d = max((b.shape[1] for b in books), default=0)
    sums = (leaves.mapInArrow(run, SUMS).groupBy("pos", "entry")
            .agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(j))).alias(f"s{j}") for j in range(d)]))
    out = [b.copy() for b in books]
    for r in sums.collect():  # parts x entries rows at most
        book = out[r["pos"]]
        book[r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(book.shape[1])]
    return out


def _runs(pos: np.ndarray):
    ends = np.append(np.flatnonzero(np.diff(pos)) + 1, len(pos))
    return zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True) if len(pos) else ()


def fit(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> list[np.ndarray]:
    """A codebook (entries x components) for each part position."""
    first = _first_entries(rows, entries)
    if not first:
        return []
    dim = len(first[0])
    if any(len(v) != dim for v in first):
        first = _first_entries(rows.where(F.size("v") == dim), entries)
    books = [np.array([v[s:s + n] for v in first], np.int64).reshape(len(first), n) for s, n in cuts(dim, parts)]
    leaves = distinct_parts(rows, dim, parts)
    for _ in range(rounds):
        books = refine(leaves, books)
    return books


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of the vectors that fit the codebooks."""
    dim = sum(b.shape[1] for b in books)
    schema = StructType([rows.schema["vec_id"], rows.schema["label"], StructField("code", StringType()), StructField("error", LongType())])

    def run(batches):
        two = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), "S2")
        for b in batches:
            v = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, dim)
            codes, error, at = np.empty((b.num_rows, len(books)), np.int64), np.zeros(b.num_rows, np.int64), 0
            for i, book in enumerate(books):
                codes[:, i], e = assign(v[:, at:at + book.shape[1]], book)
                error, at = error + e, at + book.shape[1]
            hexed = np.ascontiguousarray(two[codes]).view(f"S{2 * len(books)}").ravel().astype(str)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hexed.tolist(), pa.string()), pa.array(error)],
                                             names=schema.names)

    return rows.where(F.size("v") == dim).mapInArrow(run, schema)


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
             vector: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """vec_id, code (two hex digits a part), error (squared distance to the
    coded vector), label_error (over equal labels), codebooks_sha256."""
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    rows = kept(vectors, scale, vector, key, label)
    books = fit(rows, parts, entries, rounds)
    coded = written(encode(rows, books))
    totals = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("_label")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
