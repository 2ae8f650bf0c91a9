"""Plain single-process versions of the operators, for comparison."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, lower=True):
    t = (text or "").encode()
    return [w.lower() if lower else w for w in WORD.findall(t)]


class Forest:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, n):
        while self.up[n] != n:
            n = self.up[n]
        return n

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def shingles(text, n):
    w = words(text)
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def components(texts: dict, n, num, den):
    """doc_id -> (set size, least doc_id reachable)."""
    sets = {k: shingles(t, n) for k, t in texts.items()}
    has = collections.defaultdict(list)
    for k, s in sets.items():
        for x in s:
            has[x].append(k)
    both = collections.Counter((a, b) for v in has.values() for a in v for b in v if a < b)
    f = Forest(sets)
    for (a, b), c in both.items():
        if den * c >= num * (len(sets[a]) + len(sets[b]) - c):
            f.join(a, b)
    return {k: (len(sets[k]), f.find(k)) for k in sets}


BASE = (("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16))


def secrets(text):
    """(counts by kind, digest)."""
    found = sorted((m.start(), i, m.end(), kind) for i, (kind, rx, g, least) in enumerate(BASE)
                   for m in re.finditer(rx, text or "") if len(m.group(g)) >= least)
    counts = [sum(f[3] == kind for f in found) for kind, *_ in BASE]
    return counts, hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, _, e, k in found).encode()).hexdigest()


def crc(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


class Ppm:
    def __init__(self, training, order):
        self.k = order
        self.c = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
        for t in training:
            s = self.seq(t)
            for i in range(order, len(s)):
                for k in range(order + 1):
                    self.c[k][s[i - k:i]][s[i]] += 1

    def seq(self, text):
        return b"\xff" * self.k + (text or "").encode().lower() + b"\xfe"

    def cost(self, ctx, x):
        p, out = 0.0, set()
        for k in range(self.k, -1, -1):
            m = self.c[k].get(ctx[self.k - k:])
            if not m:
                continue
            left = {y: n for y, n in m.items() if y not in out}
            q, t = len(left), sum(left.values())
            if x in left:
                return p + math.log10(left[x] / (t + q))
            if q:
                p += math.log10(q / (t + q))
            out |= set(m)
        return p - math.log10(256 - len(self.c[0][b""]))

    def score(self, text):
        s = self.seq(text)
        return sum(self.cost(s[i - self.k:i], s[i]) for i in range(self.k, len(s)))


def quality_counts(text):
    t = (text or "").encode()
    w = WORD.findall(t)
    c = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    mark = [False] * len(w)
    for i in range(len(w) - 4):
        if c[tuple(w[i:i + 5])] > 1:
            mark[i:i + 5] = [True] * 5
    seen, dup = set(), 0
    for line in t.split(b"\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = sum(mark)
    return (len(w), sum(len(x.decode()) for x in w), sum(t.decode().count(x) for x in "#*$%&|<>"), dup, n,
            len(w) < 10 or 100 * n > 20 * len(w))


def quality_kept(rows, min_docs, share, least_words, least_part):
    """rows: (text, host); verdicts in order."""
    def lines(t):
        return [b" ".join(x.lower().split()) for x in (t or "").encode().split(b"\n") if WORD.search(x)]

    texts = collections.defaultdict(set)
    for t, h in rows:
        texts[h].add(t or "")
    count = collections.Counter((h, x) for h, ts in texts.items() for t in ts for x in set(lines(t)))
    groups = collections.defaultdict(set)
    rank = lambda x: hashlib.md5(x).hexdigest()[:15]
    for h, ts in texts.items():
        for t in ts:
            own = set(lines(t))
            shared = sorted((rank(x), x) for x in own if count[h, x] > 1)
            for _, x in shared:
                other = [k for k, y in shared if y != x]
                groups[h, x].add(other[0] if 2 * len(other) > len(own) - 1 else (t,))
    bad = {(h, x) for (h, x), g in groups.items()
           if len(g) > max(share * len(texts[h]), min(min_docs, max(5, len(texts[h]) / 2)))}
    out = []
    for t, h in rows:
        n, *_, failed = quality_counts(t)
        left = n - sum(len(x.split()) for x in lines(t) if (h, x) in bad)
        out.append(not failed and left >= least_words and left >= least_part * n)
    return out


def edit_distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def removed_lines(docs, tau, min_chars, close):
    """docs: (doc_id, text) in order; close(a, b) tells whether two lines are
    within tau edits.  doc_id -> line numbers removed."""
    occ = []
    for k, t in docs:
        for i, x in enumerate((t or "").encode().split(b"\n") if t else []):
            x = b" ".join(x.split()).decode()
            if len(x) >= min_chars:
                occ.append((k, i, x))
    lines = list(dict.fromkeys(o[2] for o in occ))
    by = collections.defaultdict(list)
    for n, x in enumerate(lines):
        by[len(x)].append(n)
    f = Forest(range(len(lines)))
    for length in by:
        for d in range(tau + 1):
            for a in by[length]:
                for b in by.get(length - d, ()):
                    if a != b and f.find(a) != f.find(b) and close(lines[a], lines[b]):
                        f.join(a, b)
    number = {x: n for n, x in enumerate(lines)}
    seen, out = set(), collections.defaultdict(list)
    for k, i, x in occ:
        c = f.find(number[x])
        if c in seen:
            out[k].append(i)
        seen.add(c)
    return out


def smith_waterman(item, text):
    best = 0
    prev = [0] * (len(text) + 1)
    for x in item:
        cur = [0]
        for j, y in enumerate(text, 1):
            cur.append(max(0, prev[j] - 1, cur[-1] - 1, prev[j - 1] + (2 if x == y else -1)))
            best = max(best, cur[-1])
        prev = cur
    return best


def judge_list(url, rules):
    """(host, path, rule, verdict) by the list alone."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, None)))
