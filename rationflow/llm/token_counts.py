"""Operator 7: token counts from the counts of distinct pre-tokens.

Pieces are counted once per distinct pre-token of the corpus and joined to the
pre-token frequencies of each document; no ids are made.  The join has two
halves.  A pre-token that makes up at least 1/HEAD of all occurrences, and is
not longer than HEAD_BYTES, is broadcast: there are at most HEAD such, whatever
the corpus.  All others are joined by a shuffle, pre-aggregated per document.

Defined cases: null text is empty (0 bytes, 0 tokens); an empty table gives no
rows; repeated rows are counted each; null ``doc_id`` is kept; very long words
are pre-tokens like others; further columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sp_model import count_pieces, pretokens, processor
from .util import bounded_batches, raw_text, written

HEAD, HEAD_BYTES = 1 << 20, 64
#: Distinct pre-tokens a task gathers before it passes their counts on.
TASK_KEYS = 400_000


def pretoken_totals(docs: DataFrame, text: str = "text") -> DataFrame:
    """(piece key, n) of all pre-tokens of the corpus."""
    def run(batches):
        seen: Counter = Counter()

        def flush():
            keys = list(seen)
            for i in range(0, len(keys), 50_000):
                part = keys[i:i + 50_000]
                yield pa.RecordBatch.from_pydict({"pretoken": pa.array(part, pa.binary()),
                                                  "n": pa.array([seen[k] for k in part], pa.int64())})
            seen.clear()

        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(pretokens(t))
                if len(seen) > TASK_KEYS:
                    yield from flush()
        yield from flush()

    return (bounded_batches(docs.select(raw_text(text))).mapInArrow(run, "pretoken binary, n long")
            .groupBy("pretoken").agg(F.sum("n").alias("n")))


def with_pieces(totals: DataFrame, model: str) -> DataFrame:
    """Adds ``pieces``, counted by the library once per distinct pre-token."""
    def run(batches):
        sp = processor(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(count_pieces(sp, b.column(0).to_pylist()), pa.int64())],
                names=["pretoken", "n", "pieces"])

    return totals.mapInArrow(run, "pretoken binary, n long, pieces long")


def token_counts(docs: DataFrame, model: str, limit: int = 4096, text: str = "text", key: str = "doc_id",
                 head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""
    spark = docs.sparkSession
    counted = written(with_pieces(pretoken_totals(docs, text), model))
    total = counted.agg(F.sum("n")).first()[0] or 0
    common = (F.col("n") * head >= total) & (F.octet_length("pretoken") <= HEAD_BYTES)
    rows = counted.where(common).select("pretoken", "pieces").collect()  # at most `head` rows
    table = spark.sparkContext.broadcast({bytes(r[0]): r[1] for r in rows})

    def run(batches):
        get = table.value.get
        for b in batches:
            uid, nbytes, n_head = b.column(0).to_pylist(), [], []
            r_uid, r_key, r_n = [], [], []
            for u, t in zip(uid, b.column(1).to_pylist(), strict=True):
                words = pretokens(t)
                pieces = list(map(get, words))
                if None in pieces:
                    rare = Counter(w for w, p in zip(words, pieces, strict=True) if p is None)
                    r_uid.extend([u] * len(rare))
                    r_key.extend(rare.keys())
                    r_n.extend(rare.values())
                    n_head.append(sum(p for p in pieces if p is not None))
                else:
                    n_head.append(sum(pieces))
                nbytes.append(len(t))
            n, m = len(uid), len(r_uid)
            # the row of the document itself: a key no pre-token can have
            own = [b"\x02" + u.to_bytes(8, "big") for u in uid]
            yield pa.RecordBatch.from_pydict({
                "uid": pa.array(uid + r_uid, pa.int64()), "pretoken": pa.array(own + r_key, pa.binary()),
                "n": pa.array([0] * n + r_n, pa.int64()),
                "doc_id": pa.array(b.column(2).to_pylist() + [None] * m, pa.int64()),
                "n_bytes": pa.array(nbytes + [None] * m, pa.int64()),
                "n_head": pa.array(n_head + [None] * m, pa.int64())})

    src = docs.select(F.monotonically_increasing_id().alias("uid"), raw_text(text), F.col(key).cast("long").alias("doc_id"))
    rare = counted.where(~common).select("pretoken", "pieces")
    parts = bounded_batches(src).mapInArrow(run, "uid long, pretoken binary, n long, doc_id long, n_bytes long, n_head long")
    n_tokens = F.sum(F.coalesce("n_head", F.lit(0)) + F.col("n") * F.coalesce("pieces", F.lit(0)))
    return (parts.join(rare, "pretoken", "left").groupBy("uid")
            .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), n_tokens.cast("bigint").alias("n_tokens"))
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
