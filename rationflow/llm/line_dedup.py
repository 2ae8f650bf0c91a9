"""Operator 10: line dedup by a segment-partition edit join.

Lines (ASCII white space folded to one space) within ``tau`` edits of each
other are one class, classes being the connected components of that relation;
of each class the first occurrence by (doc_id, text checksum, line number)
stays.  Equal lines are one line whatever their length; of lines too short for
``tau`` edits to be a small part, a tenth of the shorter line may be edited
(``edits``), under ten code points none.  ``min_chars`` is the caller's option
never to remove shorter lines; it is 1, which spares only lines without a word.

Equal lines are one line from the start.  Each distinct line of length l is cut
into tau + 1 segments, so a line within tau edits holds at least one of them
unchanged; the segments go into an index by (length, segment number, content),
and each line looks up the substrings of itself that can be a segment of a line
of length l - tau .. l, at the few starts that leave enough edits on both
sides.  A look-up that hits is a candidate if the parity bits of the two lines'
bigrams differ in no more places than tau edits can change (four each); this is
tested inside the join, so lists of a very common segment give no rows for
lines that are far apart.  Such a segment, found on a sample of the lines, is
dealt over several tasks: its index entries by line, its look-ups to all of
them.  Candidates are verified with the banded bit-parallel edit distance.

Defined cases: null text has no lines; an empty table gives no rows; repeated
rows (same doc_id and text) count as one document and lose the same lines;
null ``doc_id`` sorts first; the input's columns are kept by ``dedup_lines``.
A line is known by a 64-bit digest of its folded content.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .util import BATCH_BYTES, bounded_batches, fresh, in_bitmap, key_bitmap, mix, named, raw_text, shuffle_partitions, tidy, written

TAU, MIN_CHARS = 2, 1
#: One line in SAMPLE is counted for common_segments.  A segment is common with
#: PART_LINES entries and a COMMON-th of all; each part gets about PART_LINES.
SAMPLE, COMMON, PART_LINES, MOST_PARTS = 64, 4096, 20_000, 256
FLIPS = 4  # parity bits of the bigram signature one edit can change
CHUNK = 1 << 18  # code points whose ids are made at once, about; one line is never cut
BASE, SEED = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd
SPACES = bytes.maketrans(b"\t\v\f\r", b"    ")


def _fold(text: bytes) -> list[str]:
    """The folded lines, in a few passes over the whole text."""
    text = text.translate(SPACES)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text.replace(b" \n", b"\n").replace(b"\n ", b"\n").strip(b" ").decode("utf-8", "replace").split("\n")


def folded(texts: list[bytes]) -> Iterable[list[str]]:
    """The folded lines of each text; which texts have white space to fold is
    found for all of them at once."""
    if sum(map(len, texts)) > 2 * BATCH_BYTES:
        return map(_fold, texts)
    sign = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
    space = sign == 32
    white = space | (sign - np.uint8(9) < 5)
    fold = (space[:-1] & white[1:]) | (white[:-1] & space[1:]) | (white & ~space & (sign != 10))[1:]
    start = np.cumsum([1, *(len(t) + 1 for t in texts)])
    todo = set((np.searchsorted(start, np.flatnonzero(fold) + 1, "right") - 1).tolist())
    return (_fold(t) if i in todo else t.decode("utf-8", "replace").split("\n") for i, t in enumerate(texts))


def line_id(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def segments(length: int, tau: int) -> list[tuple[int, int]]:
    """(start, length) of the tau + 1 segments; the later ones are the longer."""
    base, more = divmod(length, tau + 1)
    out, at = [], 0
    for i in range(tau + 1):
        n = base + (i >= tau + 1 - more)
        out.append((at, n))
        at += n
    return out


def edits(length: int, tau: int) -> int:
    """Edits allowed between a line of ``length`` and a longer one."""
    return min(tau, length // 10)


def plan_of(length: int, tau: int, probing: bool) -> list[tuple[int, int, int, int]]:
    """What a line of ``length`` looks up, or its index entries, as (indexed
    length, segment number, start in the line, segment length)."""
    if probing:
        return [p for t in range(1, edits(length, tau) + 1) for p in probes(length, t) if edits(p[0], tau) == t]
    t = edits(length, tau)
    return [(length, i, at, n) for i, (at, n) in enumerate(segments(length, t))] if t else []


def probes(length: int, tau: int) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment number, start in the probing line, segment
    length) of every substring a line of ``length`` looks up."""
    out = []
    for shorter in range(max(length - tau, tau + 1), length + 1):
        delta = length - shorter
        for i, (at, n) in enumerate(segments(shorter, tau)):
            # i edits at most before the segment, tau - i at most after it
            lo = max(at - i, at + delta - (tau - i), 0)
            hi = min(at + i, at + delta + (tau - i), length - n)
            out.extend((shorter, i, p, n) for p in range(lo, hi + 1))
    return out


def _points(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all lines, number of each line's)."""
    return (np.frombuffer("".join(lines).encode("utf-32-le", "replace"), np.uint32),
            np.fromiter(map(len, lines), np.int64, count=len(lines)))


def signatures(lines: list[str]) -> np.ndarray:
    """64 parity bits of the hashed bigrams of each line."""
    return _signatures(*_points(lines))


def _signatures(points: np.ndarray, lens: np.ndarray) -> np.ndarray:
    ends, bits = np.cumsum(lens), np.zeros(len(points) + 1, np.uint64)
    bucket = (points[:-1] * np.uint32(0x9E3779B1) + points[1:] * np.uint32(0x85EBCA77)) >> np.uint32(26)
    np.left_shift(np.uint64(1), bucket, out=bits[:len(bucket)], dtype=np.uint64)
    bits[ends[lens > 0] - 1] = 0  # no bigram goes over the end of a line
    return np.where(lens > 0, np.bitwise_xor.reduceat(bits, ends - lens), 0).astype(np.uint64).view(np.int64)


def _powers(x: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(CHUNK - 1, x, np.uint64)]))


POWERS, INVERSE = _powers(BASE), _powers(pow(BASE, -1, 1 << 64))  # modulo 2**64


def piece_ids(points: np.ndarray, at: np.ndarray, end: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """64-bit ids of the pieces points[at:end], by content and seed.  They are
    read off running sums of the code points times powers of BASE, so a piece
    costs the same however long it is.  Different pieces of one id would only
    be one candidate more to verify."""
    sums, scale = np.zeros(len(points) + 1, np.uint64), []
    for k in range(0, len(points) + 1, CHUNK):
        block, step = points[k:k + CHUNK], pow(BASE, k, 1 << 64)
        np.cumsum(block * POWERS[:len(block)], out=sums[k + 1:k + 1 + len(block)])
        if k:
            sums[k + 1:k + 1 + len(block)] *= np.uint64(step)
            sums[k + 1:k + 1 + len(block)] += sums[k]
        scale.append(pow(step, -1, 1 << 64))
    value = (sums[end] - sums[at]) * INVERSE[at % CHUNK]
    if len(scale) > 1:
        value *= np.array(scale, np.uint64)[at // CHUNK]
    return mix(value + seed.astype(np.uint64) * np.uint64(SEED))


class Plans(dict):
    """length -> rows (start, end, seed) of what a line of that length looks
    up, or of its index entries, filled on demand."""

    def __init__(self, tau: int, probing: bool):
        super().__init__()
        self.tau, self.probing = tau, probing

    def __missing__(self, n: int) -> np.ndarray:
        rows = [(at, at + m, length * 64 + i) for length, i, at, m in plan_of(n, self.tau, self.probing)]
        plan = self[n] = np.array(rows, np.int64).reshape(-1, 3)
        return plan


def _segment_ids(points: np.ndarray, lens: np.ndarray, plans: Plans) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the planned segments of all lines, number of each line's)."""
    plan = [plans[n] for n in lens.tolist()]
    times = np.fromiter(map(len, plan), np.int64, count=len(plan))
    at, end, seed = np.concatenate([np.zeros((0, 3), np.int64), *plan]).T
    start = np.repeat(np.cumsum(lens) - lens, times)
    return piece_ids(points, start + at, start + end, seed), times


def segment_ids(lines: list[str], plans: Plans) -> tuple[np.ndarray, np.ndarray]:
    return _segment_ids(*_points(lines), plans)


def _chunks(lines: list[str]) -> Iterator[slice]:
    """Runs of lines with CHUNK code points in all, about."""
    first = held = 0
    for i, x in enumerate(lines):
        if held and held + len(x) > CHUNK:
            yield slice(first, i)
            first, held = i, 0
        held += len(x)
    if first < len(lines):
        yield slice(first, len(lines))


def dealt(seg: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Ids of parts of very common segments."""
    return mix(seg + (part + 1).astype(np.uint64) * np.uint64(BASE))


def deal(segs: np.ndarray, lids: np.ndarray, keys: np.ndarray, parts: np.ndarray, probing: bool) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of them for each segment): an index entry of a common
    segment (keys, ascending) goes to the part of its line, a look-up to all."""
    times = np.ones(len(segs), np.int64)
    if not len(keys):
        return segs, times
    place = np.minimum(np.searchsorted(keys, segs), len(keys) - 1)
    hit = keys[place] == segs
    n = parts[place[hit]]
    if not probing:
        out = segs.copy()
        out[hit] = dealt(segs[hit], lids[hit] % n)
        return out, times
    times[hit] = n
    out, of = np.repeat(segs, times), np.repeat(hit, times)
    part = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[of] = dealt(out[of], part)
    return out, times


def common_segments(rows: DataFrame) -> dict[int, int]:
    """segment id -> number of parts, for segments with an uncommon share of
    the index.  Counted on the lines that line_rows marks, one in SAMPLE;
    it decides where work is done, not what.  At most SAMPLE * COMMON of them,
    as each has a COMMON-th of the entries."""
    segs = rows.where("segs is not null").select(F.explode("segs").alias("seg"))
    total = segs.count()
    many = segs.groupBy("seg").agg(F.count("*").alias("n")).where(
        (F.col("n") * SAMPLE >= PART_LINES) & (F.col("n") * COMMON >= total))
    return {int(r["seg"]) & 0xFFFFFFFFFFFFFFFF: min(MOST_PARTS, r["n"] * SAMPLE // PART_LINES + 1) for r in many.collect()}


def _entries(docs: DataFrame, tau: int, min_chars: int, text: str, probing: bool, common) -> DataFrame:
    """(seg, lid, sig): index entries, or look-ups, of the lines of each task."""
    def run(batches):
        seen, plans = set(), Plans(tau, probing)
        keys = np.array(sorted(common.value), np.uint64)
        parts = np.array([common.value[k] for k in keys.tolist()], np.int64)
        for b in batches:
            lines, lids = [], []
            for text_lines in folded(b.column(0).to_pylist()):
                for x in text_lines:
                    if len(x) >= min_chars and (h := line_id(x)) not in seen:
                        seen.add(h)
                        lines.append(x)
                        lids.append(h)
            for c in _chunks(lines):
                points, lens = _points(lines[c])
                lid, sig = np.array(lids[c], np.int64), _signatures(points, lens)
                segs, times = _segment_ids(points, lens, plans)
                lid, sig = np.repeat(lid, times), np.repeat(sig, times)
                segs, times = deal(segs, lid, keys, parts, probing)
                if len(segs) > len(lid):
                    lid, sig = np.repeat(lid, times), np.repeat(sig, times)
                yield pa.RecordBatch.from_arrays([pa.array(segs.view(np.int64)), pa.array(lid), pa.array(sig)], names=["seg", "lid", "sig"])

    return bounded_batches(docs.select(raw_text(text)), 500).mapInArrow(tidy(run), "seg long, lid long, sig long")


def within(pairs: list[tuple[str, str]], k: int) -> np.ndarray:
    """Which pairs are within k edits (code points): common ends are cut off,
    then a band of 2k + 1 diagonals runs as bit vectors, all pairs at once."""
    out = np.zeros(len(pairs), bool)
    long_, short, where = [], [], []
    for i, (a, b) in enumerate(pairs):
        if len(a) < len(b):
            a, b = b, a
        if len(a) - len(b) > k:
            continue
        x, y = (np.frombuffer(s.encode("utf-32-le", "replace"), np.uint32) for s in (a, b))
        m = len(y)
        diff = np.flatnonzero(x[:m] != y)
        head = int(diff[0]) if len(diff) else m
        tail_diff = np.flatnonzero(x[len(x) - (m - head):][::-1] != y[head:][::-1])
        tail = int(tail_diff[0]) if len(tail_diff) else m - head
        x, y = x[head:len(x) - tail], y[head:m - tail]
        if len(x) <= k:
            out[i] = True
        else:
            long_.append(x), short.append(y), where.append(i)
    order = sorted(range(len(where)), key=lambda j: len(short[j]))
    at = 0
    while at < len(order):  # groups of like lengths, some million cells each
        end = at + 1
        while end < len(order) and (end - at) * len(short[order[end]]) < 2_000_000:
            end += 1
        group = order[at:end]
        ok = _banded([long_[j] for j in group], [short[j] for j in group], k)
        out[np.array([where[j] for j in group])[ok]] = True
        at = end
    return out


def _banded(long_: list[np.ndarray], short: list[np.ndarray], k: int) -> np.ndarray:
    """Bit b of a vector stands for row column + b - k of the band."""
    n1, n2 = (np.array([len(x) for x in s], np.int64) for s in (long_, short))
    width = int(n2.max(initial=0))
    # rows k..: the long side, k signs in front that equal nothing; 0xFFFFFFFF never is a code point
    x = np.full((len(long_), width + 3 * k + 2), 0xFFFFFFFF, np.uint32)
    y = np.full((len(short), width + 1), 0xFFFFFFFE, np.uint32)
    for i, (a, b) in enumerate(zip(long_, short, strict=True)):
        x[i, k:k + len(a)] = a[: width + 2 * k + 2]
        y[i, :len(b)] = b
    full, one = np.uint64((1 << (2 * k + 1)) - 1), np.uint64(1)
    top = np.uint64(1 << (2 * k))
    live = np.arange(len(long_))
    score = np.full(len(long_), k, np.int64)
    vp = np.full(len(long_), ((1 << (k + 1)) - 1) << k, np.uint64)
    vn = np.zeros(len(long_), np.uint64)
    row_bit = np.full(len(long_), top >> one, np.uint64)  # of the long side's last row, once the band ends there
    good = np.zeros(len(long_), bool)
    for c in range(width + 1):
        ended = n2[live] == c
        if ended.any():
            good[live[ended]] = score[ended] <= k
            rest = ~ended
            live, score, vp, vn, row_bit = live[rest], score[rest], vp[rest], vn[rest], row_bit[rest]
        if not len(live):
            break
        eq = np.zeros(len(live), np.uint64)
        ch = y[live, c]
        for b in range(2 * k + 1):
            eq |= (x[live, c + b] == ch).astype(np.uint64) << np.uint64(b)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp = vn | (~(d0 | vp) & full)
        hn = d0 & vp
        slant = c < n1[live] - k  # the band's last row is still in the long side
        up = np.where(slant, (d0 & top) == 0, (hp & row_bit) != 0)
        down = ~slant & ((hn & row_bit) != 0)
        score = score + up - down
        vp = hn | (~((d0 >> one) | hp) & full)
        vn = (d0 >> one) & hp
        row_bit = np.where(c >= n1[live] - k, row_bit >> one, row_bit)
        far = score > 2 * k + n2[live] - n1[live] + k  # out of reach of k
        if far.any():
            rest = ~far
            live, score, vp, vn, row_bit = live[rest], score[rest], vp[rest], vn[rest], row_bit[rest]
    return good


def line_links(docs: DataFrame, rows: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, text: str = "text") -> DataFrame:
    """(a, b): ids of different lines within the edits their length allows;
    rows: line_rows."""
    spark = docs.sparkSession
    common, n = spark.sparkContext.broadcast(common_segments(rows)), shuffle_partitions(spark)
    # dealt by segment once: the lines that several tasks hold become one
    # there, and the join finds both sides in place
    probe, index = (_entries(docs, tau, min_chars, text, p, common).repartition(n, "seg").distinct() for p in (True, False))
    p, x = probe.alias("p"), index.alias("x")
    cand = written(p.join(x, (F.col("p.seg") == F.col("x.seg")) & (F.col("p.lid") != F.col("x.lid"))
                          & (F.bit_count(F.col("p.sig").bitwiseXOR(F.col("x.sig"))) <= FLIPS * tau))
                   .select(F.least("p.lid", "x.lid").alias("a"), F.greatest("p.lid", "x.lid").alias("b")).distinct())
    wanted = spark.sparkContext.broadcast(key_bitmap(
        cand.select(F.explode(F.array("a", "b")).alias("lid")).distinct(), "lid"))  # 1 MB whatever the input

    def fetch(batches):
        bits, seen = np.frombuffer(wanted.value, np.int64), set()
        for b in batches:
            lines = [x for text_lines in folded(b.column(0).to_pylist()) for x in text_lines if len(x) >= min_chars]
            lids = np.fromiter(map(line_id, lines), np.int64, count=len(lines))
            new = []
            for i in np.flatnonzero(in_bitmap(bits, lids.view(np.uint64))).tolist():
                if (h := int(lids[i])) not in seen:
                    seen.add(h)
                    new.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(lids[new]), pa.array([lines[i] for i in new], pa.string())], names=["lid", "line"])

    lines = (bounded_batches(docs.select(raw_text(text)), 500).mapInArrow(tidy(fetch), "lid long, line string")
             .groupBy("lid").agg(F.min("line").alias("line")))

    def verify(batches):
        for b in batches:
            pairs = list(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
            least = np.fromiter((edits(min(len(x), len(y)), tau) for x, y in pairs), np.int64, count=len(pairs))
            ok = np.zeros(len(pairs), bool)
            for t in range(1, tau + 1):
                at = np.flatnonzero(least == t)
                ok[at] = within([pairs[i] for i in at], t)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok))

    side = lambda c, t: lines.select(F.col("lid").alias(c), F.col("line").alias(t))
    return (cand.join(side("a", "ta"), "a").join(side("b", "tb"), "b").select("a", "b", "ta", "tb")
            .mapInArrow(tidy(verify), "a long, b long"))


def line_rows(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a document (n_lines set) and one a line of at least min_chars;
    ``segs`` has the index entries of one line in SAMPLE."""
    def run(batches):
        plans = Plans(tau, False)
        for b in batches:
            n_lines, times, numbers, lids, at, marked = [], [], [], [], [], []
            texts = b.column(0).to_pylist()
            for t, lines in zip(texts, folded(texts), strict=True):
                lines = lines if t else []
                n_lines.append(len(lines)), numbers.append(0), lids.append(0)  # the document's own row
                before = len(lids)
                for no, x in enumerate(lines):
                    if len(x) >= min_chars:
                        h = line_id(x)
                        if not h % SAMPLE:
                            at.append(len(lids)), marked.append(x)
                        numbers.append(no), lids.append(h)
                times.append(len(lids) - before + 1)
            own = np.cumsum(times) - times
            of = np.repeat(np.arange(len(times)), times)
            is_own, no_segs = np.zeros(len(of), bool), np.ones(len(of), bool)
            is_own[own], no_segs[at] = True, False
            found = [segment_ids(marked[c], plans) for c in _chunks(marked)]
            ends = np.zeros(len(of) + 1, np.int32)
            ends[np.array(at, np.int64) + 1] = np.concatenate([np.zeros(0, np.int64), *(k for _, k in found)])
            segs = np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in found)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i).take(pa.array(of)) for i in (1, 2, 3)),
                 pa.array(np.array(n_lines, np.int64)[of], mask=~is_own), pa.array(np.array(numbers, np.int64), mask=is_own),
                 pa.array(np.array(lids, np.int64), mask=is_own),
                 pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(segs), mask=pa.array(no_segs))],
                names=["d1", "d2", "doc_id", "n_lines", "line_no", "lid", "segs"])

    src = docs.select(raw_text(text), *_doc_key(text, key), F.col(key).cast("long").alias("doc_id"))
    return bounded_batches(src, 500).mapInArrow(tidy(run), "d1 long, d2 long, doc_id long, n_lines long, line_no long, lid long, segs array<long>")


def _doc_key(text: str, key: str):
    """Two hashes that name a document: of its id and text, and of its text."""
    return F.xxhash64(F.col(key), F.col(text)).alias("d1"), F.hash(F.col(text), F.col(key)).cast("long").alias("d2")


def removed_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, text: str = "text",
                  key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(line_rows of the table, written; (d1, d2, removed) with the numbers of
    the lines each document loses)."""
    rows = written(line_rows(docs, tau, min_chars, text, key))
    part = components(line_links(docs, rows, tau, min_chars, text))
    place = F.struct("doc_id", "d1", "d2", "line_no")
    occ = (rows.where("lid is not null").join(part.withColumnRenamed("node", "lid"), "lid", "left")
           .select(F.coalesce("component", "lid").alias("line_class"), place.alias("place")))
    first = occ.groupBy("line_class").agg(F.min("place").alias("first"), F.count("*").alias("k")).where("k > 1")
    again = occ.join(first, "line_class").where(~F.col("place").eqNullSafe(F.col("first")))
    return rows, (again.groupBy("place.d1", "place.d2")
                  .agg(F.sort_array(F.collect_set("place.line_no")).alias("removed")))  # lines of one document


def line_report(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_lines, n_removed, removed_lines (numbers from 0, comma-joined) of every row."""
    rows, removed = removed_lines(docs, tau, min_chars, text, key)
    return (rows.where("n_lines is not null").join(removed, ["d1", "d2"], "left")
            .select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"),
                    F.coalesce(F.array_join(F.col("removed").cast("array<string>"), ","), F.lit("")).alias("removed_lines")))


def dedup_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without the repeated lines; a document all of whose words went
    with them is dropped, one that had none before stays."""
    _, removed = removed_lines(docs, tau, min_chars, text, key)
    h1, h2, cut = fresh(docs, "d1", "d2", "cut")
    d1, d2 = _doc_key(text, key)
    gone = removed.select(F.col("d1").alias("gone_1"), F.col("d2").alias("gone_2"), F.col("removed").alias("gone"))
    gone = gone.withColumnsRenamed(dict(zip(gone.columns, names := fresh(docs, *gone.columns), strict=True)))
    g1, g2, lines = (F.col(c) for c in names)
    number = F.map_from_entries(F.transform(lines, lambda x: F.struct(x, F.lit(True))))  # one look-up a line
    left = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda x, i: F.element_at(number, i.cast("long")).isNull()), "\n")
    joined = docs.withColumn(h1, d1).withColumn(h2, d2).join(gone, (F.col(h1) == g1) & (F.col(h2) == g2), "left")
    out = joined.select(*[F.when(lines.isNull(), F.col(text)).otherwise(left).alias(c) if c == text else named(c) for c in docs.columns],
                        lines.isNotNull().alias(cut))
    return out.where(~F.col(cut) | F.rlike(F.col(text), F.lit(r"[^\x20\x09-\x0D]"))).drop(cut)
