"""Operator 4: quality rules and cross-document line frequency.

Lines are normalised (A-Z lower-cased, runs of ASCII white space one space) and
hashed; for each host the documents with a line are counted, equal texts once.
So that copies of one document do not make its lines look like boilerplate, near
copies count once, too: a text most of whose other lines stand in other texts of
the host counts with the texts that have the same least of these lines.  A line is
removed from the documents of a host when its count is above the limit
(``limit``): ``share`` of the host's distinct texts, and at least ``min_docs``, for
small hosts half of the texts but no fewer than five.  A document is rejected when
it fails the base rules, or when removal leaves it fewer than ``least_words`` words
or less than ``least_part`` of its words.  ``quality`` gives the verdicts, ``clean``
the kept documents without the lines.

Lines of all documents meet their counts by a shuffle join on (host, line); no
list of lines is broadcast or collected.

Defined cases: null text has no words and fails; null host is a host of its
own; an empty table gives no rows; repeated rows are judged alike and count as
one text; a line without a word counts for nothing; further columns of the
input are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from .util import WordHashes, bounded_batches, flat_hashes, fresh, in_bitmap, key_bitmap, named, raw_text, tidy, window_hashes, words_of, written

SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
INNER_BYTES = bytes(range(0x80, 0xC0))  # bytes of a code point after its first
WINDOW = 5
LEAST_TEXTS = 5  # texts a line may stand in at any host


def line_hash(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def repeated_words(flat: np.ndarray, k: int = WINDOW) -> int:
    """Words that lie in a window of k words found twice or more."""
    m = len(flat) - k + 1
    if m < 2:
        return 0
    h = window_hashes(flat, k)[:m]
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(flat) + 1, np.int64)
    edge[:m] += twice
    edge[k:k + m] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _lines(text: bytes) -> list[bytes]:
    return [x for x in text.split(b"\n") if x and not x.isspace()]


def line_counts(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """(host, line, n_docs): distinct texts of a host with the line, and for
    line null the distinct texts of the host."""
    def run(batches):
        for b in batches:
            hosts, out_h, out_l, out_t = b.column(1).to_pylist(), [], [], []
            for h, t in zip(hosts, b.column(0).to_pylist(), strict=True):
                own = xxhash.xxh3_64_intdigest(t) - (1 << 63)
                lines = {line_hash(x.lower().split()) for x in _lines(t)}
                out_h.extend([h] * (len(lines) + 1))
                out_l.extend(lines)
                out_l.append(None)
                out_t.extend([own] * (len(lines) + 1))
            yield pa.RecordBatch.from_arrays([pa.array(out_h, pa.int64()), pa.array(out_l, pa.int64()),
                                              pa.array(out_t, pa.int64())], names=["host", "line", "txt"])

    src = docs.select(raw_text(text), F.xxhash64(F.col(host)).alias("host"))
    # the count of distinct texts is spread over (host, line, txt) first, so a
    # line of every document is no task of its own
    return (bounded_batches(src).mapInArrow(tidy(run), "host long, line long, txt long")
            .distinct().groupBy("host", "line").agg(F.count("*").alias("n_docs")))


def limit(n_texts: str, min_docs: int, share: float):
    """A line of more texts of a host with so many texts is removed."""
    n = F.col(n_texts)
    return F.greatest(F.lit(float(share)) * n, F.least(F.lit(float(min_docs)), F.greatest(F.lit(float(LEAST_TEXTS)), n / 2)))


def line_rank(words: list[bytes]) -> int:
    """The order of lines in which a text's least is sought (60 bits)."""
    return int(hashlib.md5(b" ".join(words), usedforsecurity=False).hexdigest()[:15], 16)


def _pair(host: int, line: int) -> int:
    return xxhash.xxh3_64_intdigest(struct.pack("<qq", host, line))


@F.arrow_udf(LongType())
def _pairs(hosts: pa.Array, lines: pa.Array) -> pa.Array:
    return pa.array(np.array([_pair(h, x) for h, x in zip(hosts.to_pylist(), lines.to_pylist(), strict=True)], np.uint64).view(np.int64))


def _shared_lines(docs: DataFrame, counts: DataFrame, host: str, text: str) -> DataFrame:
    """(host, txt, n_lines, line, rank): the lines of each distinct text that
    other texts of its host have.  A bitmap of these lines (1 MB) spares most
    of the others the way to the join that tells."""
    shared = counts.where("line IS NOT NULL").select("host", "line")
    bits = docs.sparkSession.sparkContext.broadcast(key_bitmap(shared.select(_pairs("host", "line").alias("key")), "key"))

    def run(batches):
        bitmap = np.frombuffer(bits.value, np.int64)
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lines = {line_hash(w): w for w in (x.lower().split() for x in _lines(t))}
                keys = list(lines)
                hit = in_bitmap(bitmap, np.array([_pair(h, x) for x in keys], np.uint64))
                some = [x for x, ok in zip(keys, hit.tolist(), strict=True) if ok]
                own = xxhash.xxh3_64_intdigest(t) - (1 << 63)
                for c, v in zip(out, ([h] * len(some), [own] * len(some), [len(keys)] * len(some), some,
                                      [line_rank(lines[x]) for x in some]), strict=True):
                    c.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["host", "txt", "n_lines", "line", "rank"])

    src = docs.select(raw_text(text), F.xxhash64(F.col(host)).alias("host"))
    found = bounded_batches(src).mapInArrow(tidy(run), "host long, txt long, n_lines long, line long, rank long").distinct()
    return found.join(shared, ["host", "line"], "left_semi")


def frequent_lines(docs: DataFrame, min_docs: int = 20, share: float = 0.002, host: str = "source",
                   text: str = "text") -> DataFrame:
    """(host, line) above the limit of the host."""
    counts = written(line_counts(docs, host, text).where("line IS NULL OR n_docs > 1"))
    hosts = counts.where("line IS NULL").select("host", limit("n_docs", min_docs, share).alias("_limit"))
    many = counts.where("line IS NOT NULL").join(hosts, "host").where("n_docs > _limit").select("host", "line", "_limit")
    shared = written(_shared_lines(docs, counts, host, text))
    texts = shared.groupBy("host", "txt").agg(  # one text's lines
        F.slice(F.array_sort(F.collect_set("rank")), 1, 2).alias("least"), (2 * (F.count("*") - 1) > F.max("n_lines") - 1).alias("mostly"))
    rank = F.when(F.get("least", F.lit(0)) == F.col("rank"), F.get("least", F.lit(1))).otherwise(F.get("least", F.lit(0)))
    group = F.when(F.col("mostly"), rank)
    return (shared.join(many, ["host", "line"]).join(texts, ["host", "txt"])
            .select("host", "line", "_limit", group.alias("group"), F.when(group.isNull(), F.col("txt")).alias("alone")).distinct()
            .groupBy("host", "line", "_limit").agg(F.count("*").alias("n")).where("n > _limit").select("host", "line"))


def quality(docs: DataFrame, min_docs: int = 20, share: float = 0.002, least_words: int = 10, least_part: float = 0.2,
            host: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a document: the base counts, base_failed, kept, words_left and
    the hashes of text and host, on which alone the verdict depends."""
    return _judged(docs, min_docs, share, least_words, least_part, host, text, key).drop("flagged")


def _judged(docs, min_docs, share, least_words, least_part, host, text, key) -> DataFrame:
    """quality with ``flagged``, the hashes of the document's lines above the limit."""
    bad = frequent_lines(docs, min_docs, share, host, text)

    def run(batches):
        cache = WordHashes()
        for b in batches:
            texts = b.column(0).to_pylist()
            uid, hosts, ids, own = (b.column(i).to_pylist() for i in range(1, 5))
            flat, lens = flat_hashes(words_of(texts, lower=False), cache)
            ends = np.cumsum(lens).tolist()
            cols = {c: [] for c in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
            l_uid, l_host, l_line, l_words = [], [], [], []
            for i, t in enumerate(texts):
                cols["word_chars"].append(len(t.translate(None, SPACES + INNER_BYTES)))
                cols["n_symbols"].append(len(t) - len(t.translate(None, SYMBOLS)))
                lines = _lines(t)
                cols["n_dup_lines"].append(len(lines) - len(set(lines)))
                cols["n_repeat_words"].append(repeated_words(flat[ends[i] - int(lens[i]):ends[i]]))
                words: dict[int, int] = {}
                for x in lines:
                    w = x.lower().split()
                    h = line_hash(w)
                    words[h] = words.get(h, 0) + len(w)
                l_uid.extend([uid[i]] * len(words))
                l_host.extend([hosts[i]] * len(words))
                l_line.extend(words.keys())
                l_words.extend(words.values())
            n, m = len(texts), len(l_uid)
            some = lambda x: pa.array(list(x) + [None] * m, pa.int64())
            yield pa.RecordBatch.from_arrays(
                # the document's own row has a host of its own, which no line has
                [pa.array(uid + l_uid, pa.int64()), pa.array(uid + l_host, pa.int64()), pa.array(uid + l_line, pa.int64()),
                 pa.array([False] * n + [True] * m), pa.array([0] * n + l_words, pa.int64()), some(ids), some(own),
                 some(hosts), some(lens.tolist()), *(some(c) for c in cols.values())],
                names=["uid", "host", "line", "is_line", "words", "doc_id", "txt", "own_host", "n_words", *cols])

    src = docs.select(raw_text(text), F.monotonically_increasing_id().alias("uid"), F.xxhash64(F.col(host)).alias("host"),
                      F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("txt"))
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    parts = bounded_batches(src).mapInArrow(tidy(run), "uid long, host long, line long, is_line boolean, words long, doc_id long, txt long, own_host long,"
                                                 " n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    removed = F.when(F.col("is_line") & F.col("_bad"), F.col("words")).otherwise(0)
    judged = (parts.join(bad.withColumn("_bad", F.lit(True)), ["host", "line"], "left").groupBy("uid")
              .agg(F.max("doc_id").alias("doc_id"), F.max("txt").alias("txt"),
                   F.max("own_host").alias("host"), *[F.max(c).alias(c) for c in cols],
                   F.sum(removed).alias("_removed"),
                   F.sort_array(F.collect_set(F.when(F.col("is_line") & F.col("_bad"), F.col("line")))).alias("flagged")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.col("_removed")
    return judged.select("doc_id", *cols, failed.alias("base_failed"),
                         (~failed & (left >= least_words) & (left >= least_part * F.col("n_words"))).alias("kept"),
                         left.cast("bigint").alias("words_left"), "txt", "host", "flagged")


@F.arrow_udf(BinaryType())
def _without(texts: pa.Array, flagged: pa.Array) -> pa.Array:
    """The texts without the lines of these hashes; null stays null."""
    out = []
    for t, gone in zip(texts.to_pylist(), flagged.to_pylist(), strict=True):
        if t is not None:
            gone = set(gone)
            t = b"\n".join(x for x in t.split(b"\n") if not x or x.isspace() or line_hash(x.lower().split()) not in gone)
        out.append(t)
    return pa.array(out, pa.binary())


def clean(docs: DataFrame, min_docs: int = 20, share: float = 0.002, least_words: int = 10, least_part: float = 0.2,
          host: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without the rejected documents, the others without their lines
    above the limit.  Verdict and lines depend on text and host alone, so these
    two are the key they are joined on."""
    judged = _judged(docs, min_docs, share, least_words, least_part, host, text, key)
    txt, own, kept, flagged = fresh(docs, "txt", "host", "kept", "flagged")
    change = (judged.where(~F.col("kept") | (F.size("flagged") > 0))
              .select(F.col("txt").alias(txt), F.col("host").alias(own), F.col("kept").alias(kept),
                      F.col("flagged").alias(flagged)).distinct())
    joined = docs.join(change, (F.xxhash64(F.col(text)) == F.col(txt)) & (F.xxhash64(F.col(host)) == F.col(own)), "left")
    cut = F.col(kept).isNotNull()
    left = _without(F.when(cut, F.col(text).cast("binary")), F.col(flagged)).cast("string")
    return (bounded_batches(joined.where(F.coalesce(F.col(kept), F.lit(True))))
            .select(*[F.when(cut, left).otherwise(F.col(c)).alias(c) if c == text else named(c) for c in docs.columns]))
