"""Operator 3: language-model scores by prediction by partial matching.

The byte-context trie of order ``order`` is kept as tables, one per order: the
(context, symbol) grams of all training texts with their counts.  A symbol is
coded in its longest context; if the context never saw it, an escape (method C:
distinct symbols / (occurrences + distinct symbols)) leads to the next shorter
context, in which the symbols of the longer one are excluded, down to a uniform
choice among the symbols no training text has.  The code length of a gram thus
depends on the gram alone, so it is worked out once per distinct gram with
joins from short to long contexts, and a document's score is the sum over its
grams.  The unigram base score is the same with words in place of grams.

Values reach documents in two halves: those that make up at least 1/HEAD of
all occurrences (at most HEAD, whatever the corpus) are broadcast as two sorted
arrays; the rest is joined by a shuffle on per-document frequencies.

Texts are coded as their UTF-8 bytes with A-Z lower-cased, after ``order``
bytes 0xFF and before one byte 0xFE (the end), neither of which UTF-8 has.

Defined cases: null text is empty (its end is its one token and symbol); a
null ``doc_id`` has the checksum of the empty text; an empty table gives no
rows; with no training text every word is unknown and every symbol costs the
uniform choice; repeated rows count and score each; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import WordHashes, bounded_batches, flat_hashes, raw_text, words_of, written

ORDER = 5
HEAD = 1 << 21
#: Bytes of text a task works on at once, and keys it gathers before it counts
#: them together and passes them on.
CHUNK, TASK_KEYS = 1_000_000, 1_500_000
END_WORD = -1  # no hash is asked to be it: hashes are shifted right by one
GRAM, WORD_KIND = 0, 1


def held_out(key: str = "doc_id", folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds == fold


def _word_keys(texts: list[bytes], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the words and the end of each text, number of them per text)."""
    flat, lens = flat_hashes(words_of(texts), cache)
    out = np.full(len(flat) + len(texts), END_WORD, np.int64)
    total = lens + 1
    inner = np.ones(len(out), bool)
    inner[np.cumsum(total) - 1] = False
    out[inner] = (flat >> np.uint64(1)).astype(np.int64)
    return out, total


def _gram_keys(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(the order + 1 bytes that end at each symbol, as an integer; symbols per text)."""
    pad = b"\xff" * order
    data = np.frombuffer(b"".join(x for t in texts for x in (pad, t.lower(), b"\xfe")), np.uint8).astype(np.int64)
    total = np.fromiter(map(len, texts), np.int64, count=len(texts)) + 1
    key = np.zeros(max(len(data) - order, 0), np.int64)
    for j in range(order + 1):
        key |= data[j: len(data) - order + j] << (8 * (order - j))
    keep = np.ones(len(key), bool)  # windows that end in the next text's padding
    starts = np.cumsum(total + order)[:-1] - order
    for j in range(order):
        keep[starts + j] = False
    return key[keep], total


def _slices(texts: list[bytes], *more, rows: int = 1 << 20):
    """Cuts a batch into parts of about CHUNK bytes and ``rows`` texts at most."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK or i + 1 - at >= rows or i == len(texts) - 1:
            yield (texts[at:i + 1], *(m[at:i + 1] for m in more))
            at, size = i + 1, 0


def _counted(keys: np.ndarray, weights: np.ndarray | None = None):
    """Distinct sorted keys with their counts (or summed weights)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if weights is None:
        keys = np.sort(keys)
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[at], np.diff(np.append(at, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[at], np.add.reduceat(weights, at)


def corpus_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", folds: int = 7, fold: int = 2,
                  order: int = ORDER) -> DataFrame:
    """(kind, key, n, total): occurrences of each gram and word in training
    texts, and in all texts."""
    def run(batches):
        cache, held, size = WordHashes(), {}, 0

        def together():
            """Counts equal keys of the gathered parts as one."""
            for at, parts in held.items():
                if len(parts) > 1:
                    held[at] = [_counted(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
            return sum(len(parts[0][0]) for parts in held.values())

        def flush():
            together()
            for (kind, train), [(k, n)] in held.items():
                for i in range(0, len(k), 100_000):
                    part, times = k[i:i + 100_000], n[i:i + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), kind, np.int8)), pa.array(part),
                         pa.array(times if train else np.zeros(len(part), np.int64)), pa.array(times)],
                        names=["kind", "key", "n", "total"])
            held.clear()

        for b in batches:
            out, texts = b.column(1).to_pylist(), b.column(0).to_pylist()
            for train in (True, False):
                for (part,) in _slices([t for t, o in zip(texts, out, strict=True) if o != train]):
                    for kind, keys in ((GRAM, _gram_keys(part, order)[0]), (WORD_KIND, _word_keys(part, cache)[0])):
                        found = _counted(keys)
                        held.setdefault((kind, train), []).append(found)
                        size += len(found[0])
                    if size > TASK_KEYS:
                        size = together()
                        if size > TASK_KEYS // 2:
                            yield from flush()
                            size = 0
        yield from flush()

    src = docs.select(raw_text(text), held_out(key, folds, fold).alias("out"))
    return (bounded_batches(src).mapInArrow(run, "kind byte, key long, n long, total long")
            .groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))


def gram_costs(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """grams (key, n, total) of the longest order -> (key, total, value): the log10
    probability of coding the gram's last symbol after the bytes before it."""
    mask = lambda k: (1 << (8 * (k + 1))) - 1
    level = (grams.groupBy(F.col("key").bitwiseAND(mask(0)).alias("key")).agg(F.sum("n").alias("n")))
    # at most 256 rows; their totals are two numbers
    t0, q0 = level.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    b = (level.withColumn("t", F.lit(t0)).withColumn("q", F.lit(q0))
         .withColumn("d", F.when(F.col("n") == 0, F.lit(-math.log10(256 - q0) if q0 < 256 else 0.0)).otherwise(0.0)))
    for k in range(1, order + 1):
        a = (grams.groupBy(F.col("key").bitwiseAND(mask(k)).alias("key")).agg(F.sum("n").alias("n"))
             if k < order else grams.select("key", "n", "total"))
        shorter = b.select(F.col("key").alias("_k"), F.col("n").alias("n1"), F.col("t").alias("t1"),
                           F.col("q").alias("q1"), F.col("d").alias("d1"))
        a = a.withColumn("_k", F.col("key").bitwiseAND(mask(k - 1))).join(shorter, "_k").drop("_k")
        seen = F.col("n") > 0
        ctx = Window.partitionBy(F.shiftright("key", 8))  # at most 256 rows a context
        a = (a.withColumn("t", F.sum("n").over(ctx)).withColumn("q", F.sum(F.when(seen, 1).otherwise(0)).over(ctx))
             .withColumn("x", F.sum(F.when(seen, F.col("n1")).otherwise(0)).over(ctx)))
        # the next shorter context without the symbols this one knows
        t2, q2 = F.col("t1") - F.col("x"), F.col("q1") - F.col("q")
        escape = F.when(q2 > 0, F.log10(q2 / (t2 + q2))).otherwise(0.0) + F.col("d1")
        d = F.when(seen, 0.0).when(F.col("n1") > 0, F.log10(F.col("n1") / (t2 + q2))).otherwise(escape)
        b = a.withColumn("d", d)
    t, q, n = F.col("t"), F.col("q"), F.col("n")
    value = F.when(n > 0, F.log10(n / (t + q))).otherwise(F.when(q > 0, F.log10(q / (t + q))).otherwise(0.0) + F.col("d"))
    return b.select("key", "total", value.alias("value"))


def ppm_score(docs: DataFrame, text: str = "text", key: str = "doc_id", folds: int = 7, fold: int = 2,
              head: int = HEAD, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    counts = written(corpus_counts(docs, text, key, folds, fold, order))
    words = counts.where(F.col("kind") == WORD_KIND)
    sums = {r["kind"]: r for r in counts.groupBy("kind").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("v")).collect()}
    n_train = int(sums[WORD_KIND]["n"]) if sums else 0
    bottom = n_train + (int(sums[WORD_KIND]["v"]) if sums else 0) + 1
    all_of = {k: int(r["total"]) for k, r in sums.items()}
    word_values = words.select("kind", "key", "total", F.log10((F.col("n") + 1) / F.lit(float(bottom))).alias("value"),
                               (F.col("n") > 0).cast("long").alias("known"))
    values = written(word_values.unionByName(
        gram_costs(counts.where(F.col("kind") == GRAM).select("key", "n", "total"), order)
        .select(F.lit(GRAM).cast("byte").alias("kind"), "key", "total", "value", F.lit(0).cast("long").alias("known"))))
    common = F.coalesce(F.when(F.col("kind") == GRAM, F.col("total") * head >= all_of.get(GRAM, 0))
                        .otherwise(F.col("total") * head >= all_of.get(WORD_KIND, 0)), F.lit(False))
    tables = {}
    for kind in (GRAM, WORD_KIND):  # at most `head` rows each, as columns
        t = values.where(common & (F.col("kind") == kind)).select("key", "value", "known").toArrow()
        by = np.argsort(k := t["key"].to_numpy().astype(np.int64))
        tables[kind] = (k[by], t["value"].to_numpy()[by], t["known"].to_numpy()[by])
    shared = spark.sparkContext.broadcast(tables)

    def run(batches):
        cache = WordHashes()
        bits = 63 - 8 * (order + 1)  # of the document's number, below those of the gram
        for b in batches:
            texts, uids = b.column(0).to_pylist(), b.column(1).to_numpy()
            docid, out = b.column(2).to_pylist(), b.column(3).to_pylist()
            for part, uid, ids, outs in _slices(texts, uids, docid, out, rows=1 << bits):
                n = len(part)
                score, base, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
                kinds, keys, owner, freq = [], [], [], []
                flat, total = _gram_keys(part, order)
                both, times = _counted(flat << bits | np.repeat(np.arange(n), total))
                found = [(GRAM, both >> bits, both & ((1 << bits) - 1), times)]
                flat, total = _word_keys(part, cache)
                ids_, back = np.unique(flat, return_inverse=True)
                both, times = _counted(back.astype(np.int64) * n + np.repeat(np.arange(n), total))
                found.append((WORD_KIND, ids_[both // n], both % n, times))
                for kind, k, doc, times in found:
                    table, value, is_known = shared.value[kind]
                    at = np.minimum(np.searchsorted(table, k), max(len(table) - 1, 0))
                    hit = table[at] == k if len(table) else np.zeros(len(k), bool)
                    add = np.bincount(doc[hit], value[at[hit]] * times[hit], n)
                    if kind == GRAM:
                        score += add
                    else:
                        base += add
                        known += np.bincount(doc[hit], is_known[at[hit]] * times[hit], n).astype(np.int64)
                    kinds.append(np.full(int((~hit).sum()), kind, np.int8))
                    keys.append(k[~hit]), owner.append(uid[doc[~hit]]), freq.append(times[~hit])
                # the row of the document itself has a kind and key of its own
                m = sum(map(len, keys))
                some = lambda x, t: pa.concat_arrays([pa.array(x, t), pa.nulls(m, t)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([uid, *owner])), pa.array(np.concatenate([np.full(n, 2, np.int8), *kinds])),
                    pa.array(np.concatenate([uid, *keys])), pa.array(np.concatenate([np.zeros(n, np.int64), *freq])),
                    some(ids, pa.int64()), some(outs, pa.bool_()), some(total, pa.int64()), some(known, pa.int64()),
                    some(base, pa.float64()), some(score, pa.float64())],
                    names=["uid", "kind", "key", "freq", "doc_id", "held_out", "n_tokens", "n_head", "base_head", "score_head"])

    src = docs.select(raw_text(text), F.monotonically_increasing_id().alias("uid"),
                      F.col(key).cast("long").alias("doc_id"), held_out(key, folds, fold).alias("out"))
    parts = bounded_batches(src).mapInArrow(run, "uid long, kind byte, key long, freq long, doc_id long, held_out boolean,"
                                                 " n_tokens long, n_head long, base_head double, score_head double")
    rare = values.where(~common).select("kind", "key", "value", "known")
    zero = lambda c: F.coalesce(c, F.lit(0))
    gain = F.coalesce(F.col("freq") * F.col("value"), F.lit(0.0))
    return (parts.join(rare, ["kind", "key"], "left").groupBy("uid")
            .agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
                 F.sum(zero(F.col("n_head")) + zero(F.col("freq") * F.col("known"))).cast("bigint").alias("n_known"),
                 F.sum(F.coalesce("base_head", F.lit(0.0)) + F.when(F.col("kind") == WORD_KIND, gain).otherwise(0.0)).alias("base_score"),
                 F.sum(F.coalesce("score_head", F.lit(0.0)) + F.when(F.col("kind") == GRAM, gain).otherwise(0.0)).alias("score"))
            .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("bigint").alias("train_tokens"),
                    "base_score", "score"))
