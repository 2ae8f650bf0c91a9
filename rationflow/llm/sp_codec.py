"""Operator 9: sentencepiece encoding and decoding by vectorised merge rounds.

The distinct pre-tokens of a batch are laid out as one flat symbol array.  A
round looks up the rank of every adjacent pair, takes the least rank of each
word (segmented minimum), merges its leftmost occurrences in all words at once
and compacts the array; words without a pair leave it.  All occurrences in a
word are merged in one round only when no merge with the new piece can outrank
it (known from the vocabulary), else the leftmost alone, which is the order of
the library.  Finished words go to a bounded cache of the task, and the ids of
whole texts are gathered from it.  A very long word is merged in blocks, whose
seams are merged again and, where they do not fit, taken out (``merge_words``),
so that its time grows with its length, not with the square of it.

Defined cases: null text is empty; an empty text is the begin and end ids and
decodes to the empty text; malformed UTF-8 counts as U+FFFD; an empty table
gives no rows; repeated rows are encoded alike; the input's other columns are
kept unless they are named like one of ``ids`` and ``decoded``, which win.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .sp_model import SPACE, Vocabulary, pretokens, raw, spread, vocabulary
from .util import bounded_batches, looked_up, tidy

#: Words and ids a task keeps encoded before the cache starts afresh.
CACHE_WORDS, CACHE_IDS = 400_000, 8_000_000
#: Symbols of a block of a very long word, and tokens looked at on either side of a seam.
BLOCK, SEAM = 64, 8
NOTHING = np.iinfo(np.int32).min


def merge_rounds(sym: np.ndarray, word: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """sym: flat symbols of all words, word: ascending word number of each.
    Returns both after the last merge, words in their order."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(sym):
        made, rank = v.pair(sym[:-1], sym[1:])
        rank[word[:-1] != word[1:]] = v.NONE
        rank, made = np.append(rank, v.NONE), np.append(made, 0)
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        least = np.minimum.reduceat(rank, starts)
        lens = np.diff(np.append(starts, len(sym)))
        live = np.repeat(least < v.NONE, lens)
        if not live.all():
            done.append((sym[~live], word[~live]))
            sym, word, rank, made = sym[live], word[live], rank[live], made[live]
            least, lens = least[least < v.NONE], lens[least < v.NONE]
            if not len(sym):
                break
        hit = np.flatnonzero(rank == np.repeat(least, lens))
        # runs of overlapping candidates: every second one, from the left
        fresh = np.append(True, hit[1:] != hit[:-1] + 1)
        place = np.arange(len(hit))
        hit_ok = (place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0
        first = np.append(True, word[hit[1:]] != word[hit[:-1]])
        alone = v.single[made[hit]]
        if alone.any():  # the leftmost of the word alone, whatever the others are
            some = np.zeros(int(word[-1]) + 1, bool)
            some[word[hit[alone]]] = True
            hit_ok = np.where(some[word[hit]], first, hit_ok)
        hit = hit[hit_ok]
        sym[hit] = made[hit]
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        sym, word = sym[keep], word[keep]
    if not done:
        return sym, word
    sym, word = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(word, kind="stable")
    return sym[order], word[order]


def merge_words(sym: np.ndarray, word: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """``merge_rounds`` with the words of over two blocks cut into blocks.

    A row of tokens is what the merges make of its text exactly if every two
    neighbours are what they make of theirs: the first merge over a border of
    two tokens would be made between those two alone as well.  Inside a block
    that holds; at a seam the last tokens before it and the first behind it are
    merged anew, and if the outermost of them come out as they were, it holds
    there too.  Otherwise the seam is taken out and its blocks are merged as
    one, until all seams hold."""
    n = np.bincount(word)
    if not len(sym) or n.max() <= 2 * BLOCK:
        return merge_rounds(sym, word, v)
    place = np.arange(len(sym)) - (np.cumsum(n) - n)[word]
    cut = (place == 0) | ((n[word] > 2 * BLOCK) & (place % BLOCK == 0) & (n[word] - place >= BLOCK // 2))
    base = np.full(len(sym), NOTHING, np.int32)  # at a token's first symbol its id: of the blocks
    final = base.copy()                          # and with the seams

    def merged(a, b):
        """Ids, places and range numbers of the tokens of symbols a..b."""
        lens = b - a
        at = spread(a, lens)
        ids, of = merge_rounds(sym[at], np.repeat(np.arange(len(a)), lens), v)
        size = np.where(ids < 0, 1, v.points[np.maximum(ids, 0)])
        return ids, at[np.cumsum(size) - size], of

    a = np.flatnonzero(cut)
    b = np.append(a[1:], len(sym))
    while len(a):
        inside = spread(a, b - a)
        base[inside] = final[inside] = NOTHING
        ids, at, _ = merged(a, b)
        base[at] = final[at] = ids
        seams = np.unique(np.append(a, b[b < len(sym)]))
        seams = seams[place[seams] > 0]
        starts = np.append(np.flatnonzero(base != NOTHING), len(sym))
        cuts = np.append(np.flatnonzero(cut), len(sym))
        c = np.searchsorted(cuts, seams)
        mid, lo, hi = (np.searchsorted(starts, x) for x in (seams, cuts[c - 1], cuts[c + 1]))
        # half of a block's tokens at most, so that the windows of its two seams never meet
        left, right = mid - np.minimum(SEAM, (mid - lo) // 2), mid + np.minimum(SEAM, (hi - mid) // 2)
        holds = (left < mid) & (mid < right)
        at_a, at_b, outer = starts[left[holds]], starts[right[holds]], starts[right[holds] - 1]
        if len(at_a):
            ids, at, of = merged(at_a, at_b)
            first = np.searchsorted(of, np.arange(len(at_a)))
            last = np.append(first[1:], len(of)) - 1
            agree = (ids[first] == base[at_a]) & (ids[last] == base[outer])
            holds[holds] = agree
            final[spread(at_a[agree], (at_b - at_a)[agree])] = NOTHING
            final[at[agree[of]]] = ids[agree[of]]
        cut[seams[~holds]] = False
        cuts = np.append(np.flatnonzero(cut), len(sym))
        of = np.unique(np.searchsorted(cuts, seams[~holds], "right") - 1)
        a, b = cuts[of], cuts[of + 1]
    at = np.flatnonzero(final != NOTHING)
    return final[at], word[at]


class Numbers(dict):
    """key -> its number, in the order they are first looked up."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class Encoder:
    """Pre-token key -> ids, with a bounded cache."""

    def __init__(self, v: Vocabulary):
        self.v, self.space = v, v.chars[ord(SPACE)]
        self.clear()

    def clear(self) -> None:
        self.index = Numbers()
        self.pool = np.zeros(0, np.int32)
        self.at = np.zeros(0, np.int64)
        self.len = np.zeros(0, np.int64)

    def learn(self, keys: list[bytes]) -> None:
        """The ids of the last keys of the index."""
        v = self.v
        points = [np.frombuffer(raw(k).decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for k in keys]
        n = np.array([len(p) for p in points], np.int64)
        flat = np.concatenate(points).astype(np.int64)
        values, back = np.unique(flat, return_inverse=True)
        known = np.array([self.space if c == 32 else v.chars.get(c, -int(c) - 1) for c in values.tolist()], np.int32)
        sym, word = merge_words(known[back], np.repeat(np.arange(len(keys)), n), v)
        if (sym < 0).any():  # code points outside the vocabulary: their bytes
            parts, size = [], np.ones(len(sym), np.int64)
            for i in np.flatnonzero(sym < 0).tolist():
                parts.append(v.byte_id[np.frombuffer(chr(-int(sym[i]) - 1).encode("utf-8", "replace"), np.uint8)])
                size[i] = len(parts[-1])
            wide = np.repeat(sym, size)
            wide[np.repeat(sym < 0, size)] = np.concatenate(parts)
            sym, word = wide, np.repeat(word, size)
        lens = np.bincount(word, minlength=len(keys)).astype(np.int64)
        self.at = np.append(self.at, len(self.pool) + np.cumsum(lens) - lens)
        self.len = np.append(self.len, lens)
        self.pool = np.append(self.pool, sym.astype(np.int32))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with begin and end ids, number of ids of each)."""
        if len(self.index) > CACHE_WORDS or len(self.pool) > CACHE_IDS:
            self.clear()
        idx, n = looked_up(map(pretokens, texts), self.index, np.int64)
        if len(self.index) > len(self.at):
            self.learn(list(islice(self.index, len(self.at), None)))
        lens = self.len[idx]
        ids = self.pool[spread(self.at[idx], lens)]
        ends = np.cumsum(n)
        upto = np.append(0, np.cumsum(lens))
        body = upto[ends] - upto[ends - n]
        out = np.empty(len(ids) + 2 * len(texts), np.int32)
        total = body + 2
        at = np.cumsum(total) - total
        inner = np.ones(len(out), bool)
        inner[at] = inner[at + total - 1] = False
        out[inner] = ids
        out[at], out[at + total - 1] = self.v.bos, self.v.eos
        return out, total


def decode_flat(ids: np.ndarray, total: np.ndarray, v: Vocabulary) -> list[str]:
    """Texts of id sequences that lie one after the other."""
    ends = np.cumsum(total)
    out = []
    for a, b in zip((ends - total).tolist(), ends.tolist(), strict=True):
        data = b"".join(v.blobs[ids[a:b]].tolist())
        if data[:1] == b" ":  # the space sign the encoder put in front
            data = data[1:]
        out.append(data.decode("utf-8", "replace"))
    return out


def pack(ids: np.ndarray, total: np.ndarray) -> list[bytes]:
    """Each sequence as little-endian unsigned 32-bit integers."""
    data = ids.astype("<u4").tobytes()
    ends = np.cumsum(total) * 4
    return [data[a:b] for a, b in zip((ends - total * 4).tolist(), ends.tolist(), strict=True)]


def encode_decode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` (binary, little-endian unsigned 32-bit integers, begin and
    end ids included) and ``decoded`` (the text those ids decode to)."""
    keep = [c for c in docs.columns if c not in ("ids", "decoded")]
    schema = StructType([docs.schema[c] for c in keep] + [StructField("ids", BinaryType()), StructField("decoded", StringType())])
    at = keep.index(text)

    def run(batches):
        coder = Encoder(vocabulary(model))
        for b in batches:
            raw8 = [t or b"" for t in b.column(len(keep)).to_pylist()]
            ids, total = coder.encode(raw8)
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(len(keep))]
                + [pa.array(pack(ids, total), pa.binary()), pa.array(decode_flat(ids, total, coder.v), pa.string())],
                names=[*keep, "ids", "decoded"])

    src = docs.select(*keep, F.col(keep[at]).cast("binary").alias("_raw"))
    return bounded_batches(src, 250).mapInArrow(tidy(run), schema)
