"""Each operator against its brute-force version, on edge cases and groups of
copies, with clashing column names; then nulls, repeated rows, empty tables."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rationflow.llm import line_dedup, ngram_join, ppm, quality, secret_scan, sharding, sp_codec, token_counts
from rationflow.llm.queries import model_path

from . import brute


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.select("doc_id", *cols).collect()}


@pytest.fixture(scope="module")
def repeated(docs):
    """Null ids and repeated rows on top."""
    more = docs.where("doc_id in (3, 100, 300)")
    return docs.unionByName(more).unionByName(more.where("doc_id = 300").withColumn("doc_id", F.lit(None).cast("long")))


@pytest.mark.parametrize("n,num,den", [(4, 85, 100), (5, 80, 100), (2, 50, 100)])
def test_ngram_join(docs, rows, n, num, den):
    want = brute.components({k: t for k, t, *_ in rows}, n, num, den)
    assert by_id(ngram_join.ngram_join(docs, n, num, den), "n_shingles", "component_id") == want
    assert len({c for _, c in want.values()}) < len(want) - 50


def test_ngram_join_edges(repeated, none):
    got = ngram_join.ngram_join(repeated, 4, 85, 100).collect()
    assert len(got) == repeated.count()
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [300]
    assert ngram_join.ngram_join(none).count() == 0
    alone = repeated.where("doc_id is null")
    assert [tuple(r)[::2] for r in ngram_join.ngram_join(alone, 4, 85, 100).collect()] == [(None, None)]


def test_secret_scan(docs, rows):
    got = by_id(secret_scan.secret_scan(docs), "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    for k, t, *_ in rows:
        counts, digest = brute.secrets(t)
        assert (list(got[k][:3]), got[k][3]) == (counts, digest), k
    assert got[10][0] == 4 and got[11][4] == "access:2:20,assign:21:44"


def test_secret_scan_ledger(spark, repeated, none, tmp_path):
    assert secret_scan.secret_scan(none).count() == 0
    path = str(tmp_path / "ledger")
    old = repeated.where("doc_id < 150")
    found = secret_scan.scan_blobs(old, secret_scan.RULES[:2])
    assert found.count() == 2 * old.select("text").na.fill("").distinct().count()  # each blob once
    secret_scan.append_ledger(found, path)
    ledger = spark.read.parquet(path)
    again = secret_scan.scan_blobs(repeated, ledger=ledger)
    pairs = again.select("blob", "rule").join(ledger.select("blob", "rule"), ["blob", "rule"], "left_semi")
    assert pairs.count() == 0  # nothing is scanned twice, new rules reach old blobs
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(secret_scan.secret_scan(repeated, ledger=ledger)) == key(secret_scan.secret_scan(repeated))
    assert secret_scan.secret_scan(repeated).count() == repeated.count()


def test_loads_share_a_ledger(spark, docs, rows, tmp_path):
    """Each pair is scanned in the first load that has it, and a run that is
    done again scans nothing."""
    path, half = str(tmp_path / "ledger"), F.col("doc_id") % 2 == 0
    loads = [docs.where(half), docs.where(~half)]
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = key(secret_scan.secret_scan(docs))
    assert key(secret_scan.scan_loads(loads, path)) == want
    pairs = len({t or "" for _, t, *_ in rows}) * len(secret_scan.RULES)
    assert spark.read.parquet(path).count() == pairs
    assert key(secret_scan.scan_loads(loads, path)) == want and spark.read.parquet(path).count() == pairs


@pytest.mark.parametrize("order,head", [(5, ppm.HEAD), (3, 64)])
def test_ppm(docs, rows, order, head):
    train = [(k, t) for k, t, *_ in rows if brute.crc(k) % 7 != 2]
    model = brute.Ppm([t for _, t in train], order)
    count = {}
    for _, t in train:
        for w in [*brute.words(t), None]:
            count[w] = count.get(w, 0) + 1
    total = sum(count.values())
    got = by_id(ppm.ppm_score(docs, order=order, head=head), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    for k, t, *_ in rows:
        w = [*brute.words(t), None]
        base = sum(np.log10((count.get(x, 0) + 1) / (total + len(count) + 1)) for x in w)
        assert got[k][:4] == (brute.crc(k) % 7 == 2, len(w), sum(x in count for x in w), total)
        assert got[k][4] == pytest.approx(base, rel=1e-9)
        if len(t or "") < 3000:
            assert got[k][5] == pytest.approx(model.score(t), rel=1e-9), k


def test_ppm_edges(repeated, none):
    got = ppm.ppm_score(repeated, order=2).collect()
    assert len(got) == repeated.count() and all(r["score"] < 0 for r in got)
    assert ppm.ppm_score(none).count() == 0
    only_held_out = ppm.ppm_score(repeated.where("doc_id is not null").where(ppm.held_out()), order=2)
    r = only_held_out.where("n_tokens > 1").first()
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0.0 and r["score"] < 0


def test_quality(docs, rows):
    got = by_id(quality.quality(docs, min_docs=20, share=0.05), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                "base_failed", "kept")
    want = brute.quality_kept([(t, s) for _, t, _, s in rows], 20, 0.05, 10, 0.2)
    for (k, t, *_), kept in zip(rows, want, strict=True):
        assert got[k] == (*brute.quality_counts(t), kept), k
    bad = {r["host"] for r in quality.frequent_lines(docs, 20, 0.05).collect()}
    assert len(bad) == 3  # the common line, at each host


def test_lines_above_the_limit_are_removed(spark, docs, rows):
    """The pipeline's stage returns the texts without them, in order."""
    import corpus_pipeline as P
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(15))
    texts = [(i, f"{own(i)}\n\nAll  RIGHTS reserved.\nend é {i}\nall rights reserved. ", "a") for i in range(25)]
    texts += [(100 + i, f"{own(100 + i)}\nAll rights reserved.", "b") for i in range(5)]  # not above the limit there
    texts += [(200, "All rights reserved.\n" * 12, "a"), (201, texts[0][1], "a"), (202, None, "a"), (203, own(203), None)]
    df = spark.createDataFrame([(k, t, s, len(t or "")) for k, t, s in texts], "doc_id long, text string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in P.quality_rules(spark, df, "").collect()}
    want = {k: f"{own(k)}\n\nend é {k}" if k < 25 else t for k, t, _ in texts if k not in (200, 202)}
    want[201] = want[0]
    assert got == {k: (t, len(t)) for k, t in want.items()}
    out = by_id(quality.clean(docs, min_docs=20, share=0.05), "text")
    verdict = by_id(quality.quality(docs, min_docs=20, share=0.05), "kept", "words_left")
    assert {k: len(brute.words(t)) for k, (t,) in out.items()} == {k: n for k, (kept, n) in verdict.items() if kept}


def test_near_copies_and_small_hosts(spark):
    """Near copies of one clean document are not boilerplate; a line in all
    documents of a small host is, and so are header and footer together."""
    import random
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklmno") for _ in range(6))
    page = lambda k: [" ".join(word() for _ in range(9)) for _ in range(k)]
    base = page(12)
    near = []
    for i in range(60):
        copy = list(base)
        for j in r.sample(range(12), 1 + i % 2):
            copy[j] = copy[j].rsplit(" ", 1)[0] + " " + word()
        near.append(copy)
    rows = [(i, "\n".join(x), "big") for i, x in enumerate(near + [page(8) for _ in range(200)])]
    rows += [(1000 + i, "\n".join(["All rights reserved", *page(4)]), "small") for i in range(15)]
    rows += [(2000 + i, "\n".join(["Menu home about", *page(5), "Imprint of the house"]), "framed") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x["doc_id"]: (x["kept"], x["n_words"] - x["words_left"]) for x in quality.quality(df).collect()}
    want = brute.quality_kept([(t, s) for _, t, s in rows], 20, 0.002, 10, 0.2)
    assert [got[k][0] for k, *_ in rows] == want
    assert all(got[i] == (True, 0) for i in range(260))
    assert all(got[1000 + i] == (True, 3) for i in range(15)) and all(got[2000 + i] == (True, 7) for i in range(80))


def test_quality_edges(repeated, none):
    assert quality.quality(repeated).count() == repeated.count()
    assert quality.quality(none).count() == 0


@pytest.mark.parametrize("head", [token_counts.HEAD, 100])
def test_token_counts(docs, rows, head):
    from rationflow.llm.sp_model import processor
    lib = processor(model_path())
    got = by_id(token_counts.token_counts(docs, model_path(), limit=200, head=head), "n_bytes", "n_tokens", "over_limit")
    for k, t, *_ in rows:
        n = len(lib.encode(t or ""))
        assert got[k] == (len((t or "").encode()), n, n > 200), k


def test_token_counts_edges(repeated, none):
    assert token_counts.token_counts(repeated, model_path()).count() == repeated.count()
    assert token_counts.token_counts(none, model_path()).count() == 0


def test_codec(docs, rows):
    from rationflow.llm.sp_model import processor
    lib = processor(model_path())
    got = by_id(sp_codec.encode_decode(docs, model_path()), "ids", "decoded", "lang")
    for k, t, lang, _ in rows:
        ids = [1, *lib.encode(t or ""), 2]
        assert np.frombuffer(got[k][0], "<u4").tolist() == ids, k
        assert got[k][1:] == (lib.decode(ids), lang)


def test_codec_random_strings():
    import random
    from rationflow.llm.sp_model import processor
    r = random.Random(4)
    lib, coder = processor(model_path()), sp_codec.Encoder(sp_codec.vocabulary(model_path()))
    texts = ["".join(r.choice("ab eoilst\n\t  ▁é\r{}();中文字😀\x00\x01\x02\x03aaabbb<s>") for _ in range(r.randint(0, 60)))
             for _ in range(2000)] + [" " * n for n in range(40)] + ["a" * n for n in range(70)] + ["ab" * 2000, "=" * 300]
    ids, total = coder.encode([t.encode() for t in texts])
    ends = np.cumsum(total)
    for t, n, e, back in zip(texts, total, ends, sp_codec.decode_flat(ids, total, coder.v), strict=True):
        want = [1, *lib.encode(t), 2]
        assert ids[e - n:e].tolist() == want and back == lib.decode(want), t


def test_codec_very_long_words():
    """Blocks and seams give what the library gives, in time that grows with the length."""
    import random
    import time
    from rationflow.llm.sp_model import processor
    r = random.Random(5)
    lib, v = processor(model_path()), sp_codec.vocabulary(model_path())
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["".join(r.choices(some, k=n)) for some in (letters, "ab", "0123456789", letters + "+/=ABC", "aab😀é漢z0")
             for n in (128, 129, 160, 161, 2000, 5001)]
    texts += [w * n for w, n in (("a", 131), ("a", 3001), ("ab", 2500), ("=", 999), ("the", 1000), ("internationalization", 300))]
    texts.append(" ".join("".join(r.choices("abcd", k=r.randint(1, 400))) for _ in range(100)))
    ids, total = sp_codec.Encoder(v).encode([t.encode() for t in texts])
    ends = np.cumsum(total)
    for t, n, e in zip(texts, total, ends, strict=True):
        assert ids[e - n:e].tolist() == [1, *lib.encode(t), 2], t[:40]
    long = "".join(r.choices(letters, k=300_000))
    begin = time.time()
    ids, _ = sp_codec.Encoder(v).encode([long.encode()])
    assert time.time() - begin < 60
    assert ids.tolist() == [1, *lib.encode(long), 2]


def test_codec_edges(repeated, none):
    assert sp_codec.encode_decode(repeated, model_path()).count() == repeated.count()
    assert sp_codec.encode_decode(none, model_path()).count() == 0


def test_sharding(docs, rows):
    got = by_id(sharding.shard_by_bytes(docs, 8), "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    sizes = {k: len((t or "").encode()) + 1 for k, t, *_ in rows}
    total, at, slots = sum(sizes.values()), 0, {}
    for k, t, *_ in sorted(rows):
        s = at * 8 // total
        assert got[k] == (sizes[k], zlib.crc32((t or "").encode()), "bytes", s, slots.get(s, 0), None)
        slots[s], at = slots.get(s, 0) + 1, at + sizes[k]


def test_sharding_edges(repeated, none):
    got = sharding.shard_by_bytes(repeated, 3).collect()
    assert len(got) == repeated.count()
    for s in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert [r["slot"] for r in got if r["doc_id"] is None] == [0]
    assert sharding.shard_by_bytes(none).count() == 0


@pytest.mark.parametrize("tau", [1, 2])
def test_line_dedup(docs, rows, tau):
    quick = lambda a, b: bool(line_dedup.within([(a, b)], tau)[0])
    want = brute.removed_lines(sorted((k, t) for k, t, *_ in rows if t), tau, 32, quick)
    got = by_id(line_dedup.line_report(docs, tau, 32), "n_removed", "removed_lines")
    for k, *_ in rows:
        assert got[k] == (len(want[k]), ",".join(map(str, want[k]))), k
    assert sum(len(want[400 + i]) > 0 for i in range(30)) == 29
    texts = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, tau, 32).select("doc_id", "text").collect()}
    for k, t, *_ in rows:
        left = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[k])
        assert texts.get(k) == left or (k not in texts and not left.split()), k


@pytest.mark.parametrize("k", [1, 2, 4])
def test_edit_distance_and_segments(k):
    import random
    r = random.Random(k)
    pairs = []
    for _ in range(2500):
        al = r.choice(["ab", "abcdé", "abcdefgh"])
        a = "".join(r.choice(al) for _ in range(r.randint(0, 25)))
        b = list(a)
        for _ in range(r.randint(0, k + 2)):
            at = r.randrange(len(b) + 1)
            b[at:at + r.randint(0, 1)] = r.choice(al) * r.randint(0, 1)
        pairs.append((a, "".join(b)))
    want = [brute.edit_distance(a, b) <= k for a, b in pairs]
    assert line_dedup.within(pairs, k).tolist() == want
    for (a, b), near in zip(pairs, want, strict=True):
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        if near and a != b and len(b) > k:  # found by a segment, let through by the signature
            index = {(len(b), i, b[s:s + n]) for i, (s, n) in enumerate(line_dedup.segments(len(b), k))}
            assert any((m, i, a[p:p + n]) in index for m, i, p, n in line_dedup.probes(len(a), k))
            x, y = line_dedup.signatures([a, b]).view(np.uint64)
            assert bin(int(x) ^ int(y)).count("1") <= 4 * k


def test_common_segments_are_dealt(docs, monkeypatch):
    """With every segment held common the result is the same."""
    want = by_id(line_dedup.line_report(docs), "removed_lines")
    monkeypatch.setattr(line_dedup, "PART_LINES", 1)
    monkeypatch.setattr(line_dedup, "MOST_PARTS", 3)
    assert len(line_dedup.common_segments(line_dedup.line_rows(docs))) > 3
    assert by_id(line_dedup.line_report(docs), "removed_lines") == want


def test_folding_of_whole_batches():
    import random
    r = random.Random(8)
    signs = [b" ", b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c", b"a", b"b", b"\xc3", b"\xa9", b"\xe2", b"\x82", b"\xff", b"\x1c", b"\x85", b"\xc2\xa0"]
    for _ in range(4000):
        texts = [b"".join(r.choices(signs, k=r.randrange(14) * r.randrange(2))) for _ in range(r.randrange(6))]
        want = [[b" ".join(x.split()).decode("utf-8", "replace") for x in t.split(b"\n")] for t in texts]
        assert list(line_dedup.folded(texts)) == want == list(map(line_dedup._fold, texts))


@pytest.mark.parametrize("probing", [True, False])
def test_segment_ids_name_the_segments(probing, monkeypatch):
    """Ids agree exactly where indexed length, segment number and content do,
    whatever lines are in front and wherever blocks of running sums end."""
    import random
    r = random.Random(9)
    lines = ["".join(r.choice("abé𝄞 ") for _ in range(r.choice([0, 5, 12, 21, 24, 90]))) for _ in range(150)]
    lines += [x[:-1] + "z" for x in lines] + lines[:20]
    for chunk in (line_dedup.CHUNK, 64):
        monkeypatch.setattr(line_dedup, "CHUNK", chunk)
        plans, found = line_dedup.Plans(2, probing), {}
        for c in [slice(0, 1), *line_dedup._chunks(lines), slice(0, len(lines))]:
            ids, times = line_dedup.segment_ids(lines[c], plans)
            pieces = [(n, i, x[at:at + m]) for x in lines[c] for n, i, at, m in line_dedup.plan_of(len(x), 2, probing)]
            assert times.sum() == len(ids) == len(pieces)
            for p, g in zip(pieces, ids.tolist(), strict=True):
                assert found.setdefault(p, g) == g
        assert len(set(found.values())) == len(found) > 300


def test_ids_of_segments_are_cheaper_than_hashing_each():
    import random
    import time

    import xxhash
    r = random.Random(10)
    lines = ["".join(r.choices("abcdefgh ", k=r.randint(300, 400))) for _ in range(2000)]
    plans = line_dedup.Plans(2, True)

    def one_by_one():
        for x in lines:
            for at, end, seed in plans[len(x)].tolist():
                xxhash.xxh3_64_intdigest(x[at:end], seed=seed)

    def at_once():
        for c in line_dedup._chunks(lines):
            line_dedup.segment_ids(lines[c], plans)

    def seconds(f):
        took = []
        for _ in range(4):  # the first fills the plans
            start = time.process_time()
            f()
            took.append(time.process_time() - start)
        return min(took)

    assert seconds(at_once) < 0.7 * seconds(one_by_one)


def test_short_lines(spark, tmp_path):
    """The query removes equal lines of any length, and near ones whose length
    allows an edit."""
    import random
    from rationflow.llm.queries import op10_line_dedup
    r = random.Random(6)
    short = ["All rights reserved.", "All rights reserved", "Al rights reservd.", "Les.", "Lee.", "x", "}", "é", "one two three", "one two thre",
             "a line of twenty-four ch", "a line of twenty-six char", "", "  ", *("".join(r.choice("abc ") for _ in range(r.randint(1, 40))) for _ in range(60))]
    texts = [(i, "\n".join(r.choice(short) for _ in range(8))) for i in range(60)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    close = lambda a, b: brute.edit_distance(a, b) <= min(2, min(len(a), len(b)) // 10)
    want = brute.removed_lines(texts, 2, 1, close)
    got = by_id(op10_line_dedup(spark, str(tmp_path)), "n_removed", "removed_lines")
    assert got == {k: (len(want[k]), ",".join(map(str, want[k]))) for k, _ in texts}
    assert sum(map(len, want.values())) > 200


def test_line_dedup_edges(repeated, none):
    got = line_dedup.line_report(repeated).collect()
    assert len(got) == repeated.count()
    assert len({r["removed_lines"] for r in got if r["doc_id"] == 100}) == 1
    assert line_dedup.line_report(none).count() == 0 and line_dedup.dedup_lines(none).count() == 0


def test_digests_of_the_codec_query(spark):
    from rationflow.llm.queries import op9_sentencepiece
    from rationflow.llm.sp_model import processor
    lib = processor(model_path())
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op9_sentencepiece(spark, sf).collect():
        ids = [1, *lib.encode(texts[r["doc_id"]]), 2]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
