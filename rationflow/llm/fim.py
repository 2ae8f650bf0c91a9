"""Operator 12: fill-in-middle over a Fenwick tree of text blocks.

A text is cut into units, which are code points, words (a word and the white
space behind it; leading white space goes to the first) or lines (a line and
its line feed).  The UTF-8 bytes lie in fixed blocks; a Fenwick tree holds how
many units and how many code points begin in each block.  Binary-lifting
descent finds the block where the wanted unit begins and the counts in front of
it, and the boundary is then located inside that one block.  All texts of an
Arrow batch lie in one flat array and are descended together.

The draws come from the id alone, so a lost task gives the same cuts again.
``restore`` rebuilds the text from output and form with column functions.

Defined cases: null text is empty, and an empty text is plain; a text that
holds a sentinel is plain; a null ``doc_id`` draws as the empty decimal; an
empty table gives no rows; repeated rows are transformed alike; further columns
are kept unless they are named like one of ``OUT``, which win.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .util import fresh, named

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
OUT = ("n", "form", "prefix_chars", "middle_chars", "output")
#: Bytes of a block, and bytes of text that are worked on at once.
BLOCK, SLICE = 256, 8 << 20
UNITS = ("char", "word", "line")


def unit_starts(data: np.ndarray, at: np.ndarray, unit: str) -> np.ndarray:
    """Which bytes begin a unit; ``at``: first byte of each (non-empty) text."""
    if unit == "char":
        return (data & 0xC0) != 0x80
    starts = np.zeros(len(data), bool)
    if unit == "line":
        starts[1:] = data[:-1] == 10
    else:
        gap = (data == 32) | ((data >= 9) & (data <= 13))
        starts[1:] = gap[:-1] & ~gap[1:]
        # the white space in front of a text's first word belongs to that word
        solid = np.append(np.flatnonzero(~gap), len(data))
        first = solid[np.searchsorted(solid, at[gap[at]])]
        starts[first[first < len(data)]] = False
    starts[at] = True
    return starts


class BlockTree:
    """Fenwick trees of several texts, one after the other in flat arrays."""

    def __init__(self, data: np.ndarray, at: np.ndarray, size: np.ndarray, unit: str):
        self.data, self.at, self.size = data, at, size
        self.starts = unit_starts(data, at[size > 0], unit)
        self.points = self.starts if unit == "char" else (data & 0xC0) != 0x80
        self.blocks = -(-size // BLOCK)
        # block boundaries of all texts as one ascending list of byte places
        first = np.repeat(at, self.blocks)
        self.root = np.cumsum(self.blocks) - self.blocks
        nth = np.arange(int(self.blocks.sum())) - np.repeat(self.root, self.blocks)
        begin = first + nth * BLOCK
        self.units_tree, self.units = self._tree(self.starts, begin, nth)
        self.points_tree, self.n_points = (self.units_tree, self.units) if unit == "char" else self._tree(self.points, begin, nth)

    def _tree(self, marks: np.ndarray, begin: np.ndarray, nth: np.ndarray):
        """(Fenwick nodes, total of each text)."""
        if not len(begin):
            return np.zeros(0, np.int64), np.zeros(len(self.size), np.int64)
        counts = np.add.reduceat(marks, begin, dtype=np.int64)
        upto = np.append(0, np.cumsum(counts))
        place = np.arange(len(begin))
        low = (nth + 1) & -(nth + 1)  # node i sums the low bit of i blocks up to its own
        return upto[place + 1] - upto[place + 1 - low], upto[self.root + self.blocks] - upto[self.root]

    def find(self, text: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, code points) of text[i] in front of its unit k[i]; the end
        of the text where it has no such unit."""
        inside = k < self.units[text]
        byte, chars = np.where(inside, 0, self.size[text]), np.where(inside, 0, self.n_points[text])
        t, rest = text[inside], k[inside].copy()
        if not len(t):
            return byte, chars
        pos, seen = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
        step = 1 << int(self.blocks[t].max()).bit_length()
        while step:  # descend: take a node while it holds no more than what is to be passed
            to = pos + step
            ok = to <= self.blocks[t]
            node = np.where(ok, self.root[t] + to - 1, 0)
            ok &= self.units_tree[node] <= rest
            rest -= np.where(ok, self.units_tree[node], 0)
            seen += np.where(ok, self.points_tree[node], 0)
            pos = np.where(ok, to, pos)
            step >>= 1
        # inside the block: the byte where the rest-th unit begins
        begin = self.at[t] + pos * BLOCK
        end = np.minimum(begin + BLOCK, self.at[t] + self.size[t])
        cell = begin[:, None] + np.arange(BLOCK)
        real = cell < end[:, None]
        cell = np.where(real, cell, 0)
        local = np.argmax((self.starts[cell] & real).cumsum(axis=1) > rest[:, None], axis=1)
        byte[inside] = begin - self.at[t] + local
        chars[inside] = seen + ((self.points[cell] & real) & (np.arange(BLOCK) < local[:, None])).sum(axis=1)
        return byte, chars


def cut(texts: list[bytes], h1: np.ndarray, h2: np.ndarray, unit: str = "char"):
    """(units of each text, byte and code-point places of both cuts, code
    points of each text); the cuts come after h % (units + 1) units."""
    size = np.fromiter(map(len, texts), np.int64, count=len(texts))
    tree = BlockTree(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size, unit)
    x, y = h1 % (tree.units + 1), h2 % (tree.units + 1)
    every = np.arange(len(texts))
    return tree.units, tree.find(every, np.minimum(x, y)), tree.find(every, np.maximum(x, y))


def _draw(key: str, salt: str, nth: int) -> Column:
    """The nth 8-digit group of sha256(salt:id) as an unsigned number."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * nth + 1, 8), 16, 10).cast("bigint")


def _slices(batch: pa.RecordBatch, at: int):
    """Parts of a batch with about SLICE bytes of text, one row at least."""
    part = np.cumsum(pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE
    ends = np.append(np.flatnonzero(np.diff(part)) + 1, batch.num_rows)
    for lo, hi in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
        yield batch.slice(lo, hi - lo)


def fill_in_middle(docs: DataFrame, salt: str = "1", fim_percent: int = 90, spm_percent: int = 20, unit: str = "char",
                   text: str = "text", key: str = "doc_id") -> DataFrame:
    """Adds ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars``,
    ``middle_chars`` (code points, null if plain) and ``output``."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    keep = [c for c in docs.columns if c not in OUT]
    body = F.coalesce(F.col(text), F.lit(""))
    plain = (F.length(body) == 0) | (_draw(key, salt, 2) % 100 >= fim_percent)
    for s in SENTINELS:
        plain |= body.contains(s)
    form = F.when(plain, "plain").when(_draw(key, salt, 3) % 100 < spm_percent, "spm").otherwise("psm")
    own = fresh(docs, "body", "h1", "h2")
    src = docs.select(*[named(c) for c in keep], body.cast("binary").alias(own[0]), _draw(key, salt, 0).alias(own[1]),
                      _draw(key, salt, 1).alias(own[2]), form.alias("form"))
    schema = StructType([docs.schema[c] for c in keep] + [
        StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()),
        StructField("middle_chars", LongType()), StructField("output", StringType())])
    p, s, m = (x.encode() for x in SENTINELS)
    k = len(keep)

    def run(batches):
        for whole in batches:
            for b in _slices(whole, k):
                texts = b.column(k).to_pylist()
                forms = b.column(k + 3).to_pylist()
                h1, h2 = (b.column(k + i).to_numpy().astype(np.int64) for i in (1, 2))
                n, (b1, c1), (b2, c2) = cut(texts, h1, h2, unit)
                out = [t if f == "plain" else
                       b"".join((p, t[:x], s, t[y:], m, t[x:y]) if f == "psm" else (s, t[y:], p, t[:x], m, t[x:y]))
                       for t, f, x, y in zip(texts, forms, b1.tolist(), b2.tolist(), strict=True)]
                none = np.array([f == "plain" for f in forms], bool)
                yield pa.RecordBatch.from_arrays(
                    [b.column(i) for i in range(k)]
                    + [pa.array(n, pa.int64()), b.column(k + 3), pa.array(c1, pa.int64(), mask=none),
                       pa.array(c2 - c1, pa.int64(), mask=none), pa.array(out, pa.binary()).view(pa.string())],
                    names=schema.names)

    return src.mapInArrow(run, schema)


def restore(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of.  No sentinel is in a text that is
    not plain, and none can arise where a text meets a sentinel, since none
    begins with the sign another ends with."""
    out, f = F.col(output), F.col(form)
    middle = F.substring_index(out, MIDDLE, -1)
    head = F.substring_index(out, MIDDLE, 1)  # both outer parts
    first = lambda mark: F.substring_index(head, mark, 1)
    second = lambda mark: F.substring_index(head, mark, -1)
    skip = lambda part: F.substring(part, len(PREFIX) + 1, 2147483647)
    psm = F.concat(skip(first(SUFFIX)), middle, second(SUFFIX))
    spm = F.concat(second(PREFIX), middle, skip(first(PREFIX)))
    return F.when(f == "plain", out).when(f == "psm", psm).otherwise(spm)
