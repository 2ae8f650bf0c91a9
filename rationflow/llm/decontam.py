"""Operator 5: benchmark decontamination by rare seeds and local alignment.

The n-grams of a test item are counted over all items.  Those that only few items
have are its rare seeds; the others are a stem many items begin or end with, and
say nothing about which item a passage was copied from.  How many *documents*
hold a seed never matters: an edited copy in many documents is still a copy.
An item all of whose n-grams are common has them as seeds.

One pass over the training texts takes the passages around the places where a
seed occurs and aligns them with the item (Smith-Waterman over words: match +2,
mismatch and gap -1); a document is a hit if the best alignment reaches ``least``
of the score of a full copy, and so does the alignment with the item's own words,
those outside the stem.  Passages with too few of the item's words for that score
are left out by this bound before they are aligned; equal ones, cut to the item's
words at both ends, are aligned once a task.  Equal items are one item.

Texts are not shuffled: the items travel to them.  Items go in blocks of at
most ``block_words`` words (one item is never cut), each broadcast in turn, so
the broadcast is bounded however many items there are; a seed stands in at most
``stem_items`` items of distinct text, which bounds what a hit can lead to.

Words are compared without case (A-Z) and without punctuation at their ends.

Defined cases: null texts and items without words are no hit; items shorter
than ``n`` words are their own seed; several copies in a document give one row
(the best, the first if equal) with their number; repeated rows give a row
each; an empty table on either side gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import WORD_CACHE, WordHashes, bounded_batches, flat_hashes, fresh, mix, raw_text, tidy, window_hashes, words_of, written

ENDS = b".,;:!?\"'()[]{}"
FILTER_BITS = 22
KNOWN = 10_000  # alignments a task remembers
STEM_ITEMS = 8  # an n-gram of more items than these is a stem


class BareHashes(WordHashes):
    """word -> hash without the punctuation at its ends."""

    def __missing__(self, word):
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.strip(ENDS) or word)
        return h


class Item:
    """Word hashes of an item, the ids that have this text, which of its n-grams
    are seeds, and its words outside the stem (None: all of them)."""

    def __init__(self, ids: list[int], words: np.ndarray, n: int, stem: list[int]):
        self.ids, self.words = ids, words
        k = min(n, len(words))
        seed = np.ones(len(words) - k + 1, bool)
        seed[stem] = False
        own = np.ones(len(words), bool)
        for place in stem:
            own[place:place + k] = False
        self.seeds = np.flatnonzero(seed) if seed.any() else np.arange(len(seed))
        # too little beside the stem to judge by: the whole item is judged
        self.own = words[own] if seed.any() and not own.all() and own.sum() >= max(n, len(words) // 4) else None


class Seeds:
    """Sorted hashes of a block's seeds, with item and place of each."""

    def __init__(self, items: list[Item], n: int):
        self.items, self.n = items, n
        grams, item, place = [], [], []
        for i, x in enumerate(items):
            k = min(n, len(x.words))
            grams.append(self.hashes(x.words, k)[: len(x.words) - k + 1][x.seeds])
            item.append(np.full(len(x.seeds), i)), place.append(x.seeds)
        order = np.argsort(g := np.concatenate(grams), kind="stable")
        self.grams, self.item, self.place = g[order], np.concatenate(item)[order], np.concatenate(place)[order]
        self.lens = sorted({min(n, len(x.words)) for x in items})
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[(self.grams & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True

    @staticmethod
    def hashes(flat: np.ndarray, k: int) -> np.ndarray:
        return mix(window_hashes(flat, k) + np.uint64(k))

    def find(self, flat: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word number, index into grams of the first equal one) of all hits."""
        ends = np.cumsum(lens)
        at_, to_ = [], []
        for k in self.lens:
            h = self.hashes(flat, k)
            ok = np.ones(len(flat), bool)
            for j in range(1, k):  # windows that run into the next text
                tail = ends[lens >= j] - j
                ok[tail] = False
            at = np.flatnonzero(ok & self.maybe[(h & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
            to = np.minimum(np.searchsorted(self.grams, h[at]), max(len(self.grams) - 1, 0))
            hit = self.grams[to] == h[at] if len(self.grams) else np.zeros(len(at), bool)
            at_.append(at[hit]), to_.append(to[hit])
        at, to = np.concatenate(at_), np.concatenate(to_)
        order = np.argsort(at, kind="stable")
        return at[order], to[order]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """(best score, passage word behind its end) of the local alignment."""
    gap = np.arange(len(passage) + 1)
    prev = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        cur = np.maximum(prev - 1, 0)
        cur[1:] = np.maximum(cur[1:], prev[:-1] + np.where(passage == w, 2, -1))
        cur = np.maximum.accumulate(cur + gap) - gap  # gaps along the passage
        top = int(cur.argmax())
        if cur[top] > best:
            best, end = int(cur[top]), top
        prev = cur
    return best, end


def passages(at: np.ndarray, place: np.ndarray, m: int, size: int) -> list[tuple[int, int]]:
    """Word ranges a copy of an item of m words may cover around seed hits."""
    slack = m // 4 + 4
    out: list[list[int]] = []
    for p, q in sorted(zip(at.tolist(), place.tolist(), strict=True)):
        lo, hi = max(p - q - slack, 0), min(p - q + m + slack, size)
        if out and lo <= out[-1][0] + slack:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _item_grams(items: DataFrame, n: int) -> DataFrame:
    """(txt, place, gram) of every n-gram of items (txt, text)."""
    def run(batches):
        cache = BareHashes()
        for b in batches:
            flat, lens = flat_hashes(words_of(b.column(1).to_pylist()), cache)
            txt, place, gram = [], [], []
            for t, e, m in zip(b.column(0).to_pylist(), np.cumsum(lens).tolist(), lens.tolist(), strict=True):
                if m:
                    k = min(n, m)
                    g = Seeds.hashes(flat[e - m:e], k)[: m - k + 1].view(np.int64)
                    txt.append(np.full(len(g), t)), place.append(np.arange(len(g))), gram.append(g)
            if txt:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (txt, place, gram)],
                                                 names=["txt", "place", "gram"])

    return bounded_batches(items.select("txt", raw_text("text"))).mapInArrow(tidy(run), "txt long, place long, gram long")


def _blocks(benchmark: DataFrame, block_words: int, n: int, stem_items: int, text: str, key: str):
    """Lists of items, each list of about block_words words."""
    folded = benchmark.select(F.col(key).cast("long").alias("item_id"), raw_text(text).alias("text"))
    folded = written(folded.groupBy("text").agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
                     .withColumn("txt", F.xxhash64("text")))
    grams = written(_item_grams(folded, n))
    common = grams.select("gram", "txt").distinct().groupBy("gram").count().where(F.col("count") > stem_items).select("gram")
    stem = grams.join(common, "gram", "left_semi").groupBy("txt").agg(F.sort_array(F.collect_list("place")).alias("stem"))  # of one item
    items = written(folded.join(stem, "txt", "left"))
    words = grams.groupBy("txt").agg(F.max("place").alias("m")).agg(F.sum(F.col("m") + n)).first()[0] or 0
    blocks = int(words) // block_words + 1
    for i in range(blocks):
        part = items.where(F.pmod("txt", F.lit(blocks)) == i).collect()  # about block_words words
        cache, out = BareHashes(), []
        for r in sorted(part, key=lambda r: (r["ids"][0] if r["ids"] else -1, r["txt"])):
            flat, _ = flat_hashes(words_of([bytes(r["text"])]), cache)
            if len(flat):
                out.append(Item(list(r["ids"]) or [None], flat, n, list(r["stem"] or [])))
        if out:
            yield out


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, n: int = 4, least: float = 0.5, block_words: int = 1_000_000, stem_items: int = STEM_ITEMS,
                   text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """doc_id, item_id, score, share (of a full copy's score), end_word,
    n_passages, txt (hash of the text) of every hit."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score long, share double, end_word long, n_passages long, txt long"
    hits = None
    for items in _blocks(benchmark, block_words, n, stem_items, item_text, item_key):
        found = _block_hits(docs, items, n, least, text, key, schema)
        hits = found if hits is None else hits.unionByName(found)
    return spark.createDataFrame([], schema) if hits is None else hits


def _block_hits(docs, items, n, least, text, key, schema) -> DataFrame:
    every = docs.sparkSession.sparkContext.broadcast(Seeds(items, n))

    def hits(batches):
        s, cache, known = every.value, BareHashes(), {}
        for b in batches:
            flat, lens = flat_hashes(words_of(b.column(0).to_pylist()), cache)
            ends = np.cumsum(lens)
            out = {c: [] for c in ("row", "item_id", "score", "share", "end_word", "n_passages")}
            if len(flat) and len(s.grams):
                at, to = s.find(flat, lens)
                # an n-gram of several items counts for each of them
                more = np.searchsorted(s.grams, s.grams[to], side="right") - to
                at = np.repeat(at, more)
                to = np.repeat(to - (np.cumsum(more) - more), more) + np.arange(int(more.sum()))
                doc = np.searchsorted(ends, at, side="right")
                order = np.lexsort((at, s.item[to], doc))
                at, to, doc = at[order], to[order], doc[order]
                cut = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (s.item[to][1:] != s.item[to][:-1]))).tolist()
                for a, e in zip(cut, cut[1:] + [len(at)], strict=True) if len(at) else ():
                    d = int(doc[a])
                    no = int(s.item[to[a]])
                    w = s.items[no].words
                    begin = int(ends[d] - lens[d])
                    body, need = flat[begin:int(ends[d])], least * 2 * len(w)
                    best = (0, 0)
                    n_good = 0
                    for lo, hi in passages(at[a:e] - begin, s.place[to[a:e]], len(w), len(body)):
                        common = np.flatnonzero(np.isin(body[lo:hi], w))
                        if 2 * len(common) < need:  # too few common words for any alignment
                            continue
                        lo, hi = lo + int(common[0]), lo + int(common[-1]) + 1
                        same = no, body[lo:hi].tobytes()
                        if same not in known:
                            if len(known) >= KNOWN:
                                known.clear()
                            known[same] = found = align(w, body[lo:hi])
                            own = s.items[no].own
                            if found[0] >= need and own is not None and align(own, body[lo:hi])[0] < least * 2 * len(own):
                                known[same] = (0, 0)  # the stem alone
                        score, end = known[same]
                        n_good += score >= need
                        if score > best[0]:
                            best = (score, lo + end)
                    if n_good:
                        for item_id in s.items[no].ids:
                            for c, v in (("row", d), ("item_id", item_id), ("score", best[0]),
                                         ("share", best[0] / (2 * len(w))), ("end_word", best[1]), ("n_passages", n_good)):
                                out[c].append(v)
            rows = pa.array(out.pop("row"), pa.int64())
            cols = [b.column(1).take(rows), *(pa.array(v, pa.float64() if c == "share" else pa.int64()) for c, v in out.items()),
                    b.column(2).take(rows)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *out, "txt"])

    src = docs.select(raw_text(text), F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("txt"))
    return bounded_batches(src).mapInArrow(tidy(hits), schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """``docs`` without those whose text is a hit."""
    (bad,) = fresh(docs, "bad")
    hit = benchmark_hits(docs, benchmark, text=text, key=key, **how).select(F.col("txt").alias(bad)).distinct()
    return docs.join(hit, F.xxhash64(F.col(text)) == F.col(bad), "left_anti")
