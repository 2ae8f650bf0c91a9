"""Fill-in-middle, WARC archives and vector codes against plain versions."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rationflow.llm import fim, vector_codes, warc

DATE = "2024-01-01T00:00:00Z"


# -- fill-in-middle ------------------------------------------------------------

def units_of(text: str, unit: str) -> list[str]:
    if unit == "char":
        return list(text)
    if unit == "line":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    space = r"[\x20\x09-\x0D]"
    return re.findall(rf"^{space}*[^\x20\x09-\x0D]+{space}*|[^\x20\x09-\x0D]+{space}*|^{space}+$", text)


def plain_fim(doc_id, text, unit="char"):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    u = units_of(t, unit)
    assert "".join(u) == t
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or h3 % 100 >= 90 or any(x in t for x in fim.SENTINELS):
        return len(u), "plain", None, None, t
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return len(u), "spm" if h4 % 100 < 20 else "psm", len(p), len(m), out


@pytest.fixture(scope="module")
def odd(spark, rows, tmp_path_factory):
    """Texts with every edge, null ids and repeated rows, clashing columns."""
    r = random.Random(3)
    signs = "ab é日😀\n\t <P>S"
    more = [(1000 + i, "".join(r.choice(signs) for _ in range(r.choice((1, 2, 5, 255, 256, 257, 512, 1500)))), None, "x") for i in range(300)]
    more += [(2000, "a<P>b", None, "x"), (2001, "<", None, "x"), (2002, "<S", None, "x"), (None, "some text without an id", None, None),
             (2003, None, None, None), (2004, "word  \n next", None, None), (2004, "word  \n next", None, None)]
    path = str(tmp_path_factory.mktemp("odd") / "d")
    df = spark.createDataFrame([*rows, *more], "doc_id long, text string, lang string, source string")
    df.withColumns({c: F.lit("own") for c in (*fim.OUT, "body", "_body", "H1", "own")}).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("unit", fim.UNITS)
def test_fill_in_middle(odd, unit, monkeypatch):
    monkeypatch.setattr(fim, "SLICE", 20_000)
    got = fim.fill_in_middle(odd, unit=unit).withColumn("back", fim.restore())
    assert set(got.columns) == {*odd.columns, "back"}
    rows = got.collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_fim(r["doc_id"], r["text"], unit), r["doc_id"]
        assert r["back"] == (r["text"] or "") and r["own"] == "own"
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_fill_in_middle_edges(spark, none):
    assert fim.fill_in_middle(none).count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(none, unit="page")
    huge = "é" * 3_000_000 + "日" * 1_000_000
    row = fim.fill_in_middle(spark.createDataFrame([(5, huge)], "doc_id long, text string")).first()
    assert (row["n"], row["form"], row["prefix_chars"], row["middle_chars"], row["output"]) == plain_fim(5, huge)


def test_block_tree_finds_every_unit():
    """Each unit of texts around the block size, against a plain scan."""
    texts = [b"", b"x" * 255, "é".encode() * 300, ("a" * 255 + "日" * 3).encode(), b"\n" * 600]
    size = np.array([len(t) for t in texts])
    tree = fim.BlockTree(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size, "char")
    for i, t in enumerate(texts):
        s = t.decode()
        byte, chars = tree.find(np.full(len(s) + 1, i), np.arange(len(s) + 1))
        assert byte.tolist() == [len(s[:k].encode()) for k in range(len(s) + 1)] and chars.tolist() == list(range(len(s) + 1))


# -- WARC ----------------------------------------------------------------------

def plain_archive(rows, least=0):
    groups = collections.defaultdict(list)
    for page, _, html in rows:
        groups[html or ""].append(page)
    out = collections.Counter()
    for html, pages in groups.items():
        raw = html.encode()
        sha = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        pages.sort(key=lambda p: (p is not None, p or 0))
        for i, p in enumerate(pages):
            copy = i < len(pages) - 1 and len(raw) >= least
            out[p, len(raw), sha, "revisit" if copy else "response", pages[-1] if copy else None] += 1
    return out


PAGES = ([(i, f"http://h{i}.example.org/x?{i}", f"<html>page {i} {'é' * (i % 50)}</html>" * (1 + i % 9)) for i in range(500)]
         + [(1000 + i, f"http://copy{i}/", "<p>one body of many</p>") for i in range(300)]
         + [(2000, None, None), (2001, "u", ""), (2002, "bad\r\nurl \x00", "\r\n\r\nWARC/1.1\r\n"), (None, "n", "no id"), (None, None, "<p>one body of many</p>"),
            (2003, "same", "row"), (2003, "same", "row"), (2003, "other", "row"), (2004, "long", "x" * 300_000)])


@pytest.mark.parametrize("least,file_rows,file_bytes", [(0, 4096, 16 << 20), (10, 7, 2000), (0, 50, 500)])
def test_archive(spark, tmp_path, least, file_rows, file_bytes):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns(
        {c: F.lit("own") for c in ("sha", "size", "body", "to", "locator", "value")}).repartition(3)
    path = str(tmp_path / "a")
    warc.write_archive(pages, path, DATE, least=least, file_rows=file_rows, file_bytes=file_bytes)
    got = warc.read_archive(spark, path).collect()
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == plain_archive(PAGES, least)
    ids = {r["record_id"]: r for r in got}
    assert len(ids) == len(PAGES)  # no two records share one
    for r in got:
        if r["record_type"] == "revisit":
            to = ids[r["refers_to_record"]]
            assert to["record_type"] == "response" and (to["page_id"], to["payload_digest"]) == (r["refers_to"], r["payload_digest"])
            assert r["payload"] is None
    bodies = collections.Counter((r["page_id"], bytes(r["payload"]).decode()) for r in got if r["payload"] is not None)
    assert not bodies - collections.Counter((p, h or "") for p, _, h in PAGES)
    assert next(r["url"] for r in got if r["page_id"] == 2002) == "bad%0D%0Aurl%20%00"


def test_files_are_plain_zstandard(spark, tmp_path):
    """Every file begins with the dictionary and holds one frame a record; a
    decoder that knows nothing of the writer reads them."""
    import glob
    import zstandard
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    path = str(tmp_path / "a")
    warc.write_archive(pages, path, DATE, file_rows=100)
    n = 0
    for f in glob.glob(f"{path}/*.txt"):
        data = open(f, "rb").read()
        assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
        words = data[8:8 + int.from_bytes(data[4:8], "little")]
        assert 1000 < len(words) <= warc.DICTIONARY_BYTES
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)).stream_reader(data, read_across_frames=True)
        stream = reader.read()
        assert stream == b"".join(warc.frames(data))
        n += sum(1 for _ in warc.frames(data))
    assert n == len(PAGES)


def test_the_dictionary_pays(spark, tmp_path):
    """Records alike but short are smaller with it than without."""
    import zstandard
    rows = [(i, f"http://site.example.org/list/{i}", f"<html><head><title>Item {i}</title></head><body><p class='price'>{i * 7}</p></body></html>") for i in range(400)]
    path = str(tmp_path / "a")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path, DATE)
    size = sum(r["length"] for r in spark.read.format("binaryFile").load(path).select("length").collect())
    alone = zstandard.ZstdCompressor(level=warc.LEVEL)
    raw = [warc.record(p, u, 0, warc.base32(hashlib.sha1(h.encode()).digest()), len(h), DATE, h.encode()) for p, u, h in rows]
    assert size - warc.DICTIONARY_BYTES < 0.6 * sum(len(alone.compress(r)) for r in raw)


@pytest.mark.parametrize("rows", [[], [(1, "u", "x")], [(1, None, None), (2, None, "")]])
def test_tiny_archives(spark, rows):
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), DATE)
    assert collections.Counter(tuple(r)[:5] for r in got.collect()) == plain_archive(rows)


def test_broken_archives_are_refused():
    import zstandard
    good = zstandard.ZstdCompressor().compress(b"x" * 1000)
    assert list(warc.frames(warc.EMPTY_FRAME + good + good)) == [b"x" * 1000] * 2
    with pytest.raises(ValueError):
        list(warc.frames(good + b"\n"))
    with pytest.raises(ValueError):
        warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n")


# -- vector codes --------------------------------------------------------------

def plain_codes(rows, parts, entries, rounds, scale=4096):
    import math
    good = [(k, lab, [max(-vector_codes.BOUND, min(vector_codes.BOUND, math.floor(x * scale))) for x in v]) for k, v, lab in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not good:
        return [], None
    dim = len(good[0][2])
    good = [r for r in good if len(r[2]) == dim]
    cuts = [len(x) for x in np.array_split(np.arange(dim), parts)]
    ends = np.cumsum(cuts)
    books = [[r[2][e - n:e] for r in good[:entries]] for n, e in zip(cuts, ends)]
    near = lambda p, book: min((sum((a - b) ** 2 for a, b in zip(p, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for b, (n, e) in enumerate(zip(cuts, ends)):
            at = collections.defaultdict(list)
            for r in good:
                at[near(r[2][e - n:e], books[b])[1]].append(r[2][e - n:e])
            books[b] = [[sum(c) // len(at[i]) for c in zip(*at[i])] if at[i] else old for i, old in enumerate(books[b])]
    out, total = [], collections.Counter()
    for k, lab, v in good:
        found = [near(v[e - n:e], books[b]) for b, (n, e) in enumerate(zip(cuts, ends))]
        out.append((k, lab, "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found)))
        total[lab] += out[-1][3]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(k), c, e, total[lab], sha) for k, lab, c, e in out), books


def vectors(n, dim, seed=5):
    r = random.Random(seed)
    centers = [[r.gauss(0, 0.3) for _ in range(dim)] for _ in range(6)]
    rows = [(i, [float(np.float32(c + r.gauss(0, 0.05))) for c in centers[i % 6]], None if i % 7 == 0 else i % 3) for i in range(n)]
    same = rows[3][1]
    rows += [(n + i, same, 1) for i in range(n // 2)]  # a third of all rows are one vector
    inf, nan = float("inf"), float("nan")
    rows += [(5000, None, 1), (5001, [], 1), (5002, [nan] * dim, 1), (-3, [0.1] * (dim - 1) + [inf], 2), (5003, [0.1] * (dim - 1) + [None], 2),
             (5004, [0.0] * (dim + 1), 2), (None, [0.25] * dim, None), (7, rows[8][1], 0), (7, rows[8][1], 0), (5005, [1e30] + [-1e30] * (dim - 1), 9)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("dim,parts,entries,rounds", [(16, 8, 16, 6), (10, 4, 3, 2), (5, 8, 4, 1), (8, 1, 256, 1)])
def test_vector_codes(spark, dim, parts, entries, rounds, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 37)
    rows = vectors(300, dim)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns(
        {c: F.lit("own") for c in ("code", "error", "pos", "part", "v", "weight", "_label")}).repartition(3)
    want, _ = plain_codes([(k, v and [None if x is None else float(np.float32(x)) for x in v], lab) for k, v, lab in rows], parts, entries, rounds)
    got = sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"])
                 for r in vector_codes.compress(df, parts, entries, rounds).collect())
    assert got == want


def test_walk_shares_prefixes_and_equals_brute_force():
    r = np.random.default_rng(1)
    book = r.integers(-9, 9, (16, 6))
    parts = np.unique(r.integers(-3, 4, (3000, 6)), axis=0)
    for size in (1, 10, 999, 5000):
        walk = vector_codes.Walk(book)
        found = [walk.block(parts[i:i + size]) for i in range(0, len(parts), size)]
        dist = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
        assert (np.concatenate([b for b, _ in found]) == dist.argmin(axis=1)).all()
        assert (np.concatenate([e for _, e in found]) == dist.min(axis=1)).all()


def test_vector_codes_edges(spark):
    shape = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compress(spark.createDataFrame([], shape)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1), (2, [float("nan")], 1)], shape)).count() == 0
    one = vector_codes.compress(spark.createDataFrame([(1, [0.5] * 8, None)], shape)).collect()
    assert [tuple(r)[:4] for r in one] == [(1, "00" * 8, 0, 0)]
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([], shape), entries=300)
