"""What the Python workers hold: the words of one text, and batches of bounded bytes."""

import tracemalloc

import pyarrow as pa
import pytest

from rationflow.llm import ngram_join, sp_codec, util
from rationflow.llm.queries import model_path

TEXTS = [b" ".join(b"word%d" % ((i * 7 + j) % 50) for j in range(1000)) for i in range(400)]


def peak(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_words_are_held_for_one_text_at_a_time():
    assert peak(lambda: util.flat_hashes(util.words_of(TEXTS), util.WordHashes())) < 12  # hashes, twice: 6.4 MB


def test_the_encoder_holds_the_pretokens_of_one_text_at_a_time():
    coder = sp_codec.Encoder(sp_codec.vocabulary(model_path()))
    coder.encode(TEXTS[:1])
    looked_up = peak(lambda: util.looked_up(map(sp_codec.pretokens, TEXTS), coder.index, int))
    assert looked_up < 12
    ids, total = coder.encode(TEXTS)
    assert peak(lambda: sp_codec.decode_flat(ids, total, coder.v)) < 3 * sum(map(len, TEXTS)) / 1e6
    assert sp_codec.decode_flat(ids, total, coder.v) == [t.decode() for t in TEXTS]


def test_empty_inputs():
    flat, lens = util.flat_hashes(util.words_of([]), util.WordHashes())
    assert len(flat) == len(lens) == 0
    flat, lens = util.flat_hashes(util.words_of([b"", b"a b", b" "]), util.WordHashes())
    assert len(flat) == 2 and lens.tolist() == [0, 2, 0]
    assert ngram_join.shingle_sets([b"", b" "], 5, util.WordHashes())[1] == [ngram_join.NO_SET] * 2


def test_a_worker_gives_memory_back_after_each_task_and_group(monkeypatch):
    given = []
    monkeypatch.setattr(util, "give_back", lambda: given.append(1))
    assert list(util.tidy(lambda batches: (x + 1 for x in batches))([1, 2])) == [2, 3] and len(given) == 1
    table = pa.table({"a": [1]})
    assert util.tidy_group(lambda t: t)(table) is table and len(given) == 2


@pytest.mark.parametrize("rows", [50, 2000])
def test_batches_are_bounded_in_rows_and_bytes(spark, rows):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": pa.array([b.num_rows], pa.int64()), "bytes": pa.array([b.nbytes], pa.int64())})

    docs = spark.range(0, 400, 1, 1).selectExpr("repeat('0123456789', 10000) AS text")
    found = util.bounded_batches(docs, rows).mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in found) == 400
    assert max(r["rows"] for r in found) <= rows and max(r["bytes"] for r in found) < 1.25 * util.BATCH_BYTES
