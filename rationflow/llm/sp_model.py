"""Vocabulary of a sentencepiece BPE model as numpy tables, and its pre-tokens.

In such a vocabulary the space sign stands only at the front of a piece, and
line feeds and tabs are in no merged piece, so no merge crosses the place
before a run of spaces or around a line feed or tab: a text falls into
pre-tokens that are encoded each on its own.
"""

from __future__ import annotations

import re

import numpy as np

SPACE = "▁"
_SPACE8 = SPACE.encode()
_SLOW = re.compile(rb" *[^ \n\t]+| +|[\n\t]")
_MODELS: dict[str, "Vocabulary"] = {}


def processor(path: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


def pretokens(text: bytes) -> list[bytes]:
    """Keys of the pre-tokens of a text, in order; ``raw`` gives their bytes.

    A key is the word after one space, 0x01 and the word after a line feed, or
    0x03 and the very bytes (texts with runs of spaces, tabs or 0x01..0x03)."""
    if not text:
        return []
    if _SPACE8 in text:
        text = text.replace(_SPACE8, b" ")
    if b"  " in text or b"\t" in text or text[0] == 32 or b"\x01" in text or b"\x03" in text:
        return [b"\x03" + x for x in _SLOW.findall(b" " + text)]
    return text.replace(b"\n", b" \x01").split(b" ")


def raw(key: bytes) -> bytes:
    if key[:1] == b"\x03":
        return key[1:]
    if key[:1] == b"\x01":
        return b"\n" + key[1:]
    return b" " + key


def count_pieces(sp, keys: list[bytes]) -> np.ndarray:
    """Number of pieces of each pre-token, by the library.  It puts a space
    sign before any text, so a pre-token that starts with a space goes without
    it and any other goes behind a line feed (two pieces more)."""
    texts, less = [], []
    for r in map(raw, keys):
        spaced = r[:1] == b" "
        texts.append((r[1:] if spaced else b"\n" + r).decode("utf-8", "replace"))
        less.append(0 if spaced else 2)
    n = np.fromiter(map(len, sp.encode(texts, num_threads=1)), np.int64, count=len(texts)) if texts else np.zeros(0, np.int64)
    n = n - np.array(less, np.int64)
    n[[i for i, t in enumerate(texts) if t == ""]] = 1  # the space sign alone
    return n


class Vocabulary:
    """Merge table, ranks and piece bytes of a model file."""

    NONE = np.int32(1 << 30)

    def __init__(self, path: str):
        sp = processor(path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        self.size, self.bos, self.eos = n, sp.bos_id(), sp.eos_id()
        ids = {p: i for i, p in enumerate(pieces) if plain[i]}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p or "\t" in p for p in ids if len(p) > 1):
            raise ValueError("the vocabulary has pieces that cross pre-tokens")
        scores = np.array([sp.get_score(i) for i in range(n)])
        order, rank, times = np.unique(-scores, return_inverse=True, return_counts=True)
        self.rank = rank.astype(np.int32)
        left, right, made = [], [], []
        for p, i in ids.items():
            for cut in range(1, len(p)):
                a, b = ids.get(p[:cut]), ids.get(p[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(i)
        left, right, made = (np.array(x, np.int64) for x in (left, right, made))
        keys = left * n + right
        order = np.argsort(keys)
        self.keys, self.made = keys[order], made[order].astype(np.int32)
        # one piece at a time where a merge can open a better or an equal pair
        self.single = (times > 1)[rank]
        for part in (left, right):
            self.single[part[rank[made] <= rank[part]]] = True
        self.chars = {ord(p): i for p, i in ids.items() if len(p) == 1}
        self.points = np.array([len(p) for p in pieces], np.int64)
        self.byte_id = np.zeros(256, np.int32)
        blobs = []
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                blobs.append(bytes([int(p[3:5], 16)]))
            else:
                blobs.append(p.replace(SPACE, " ").encode() if plain[i] else b"")
        self.blobs = np.array(blobs, object)

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(merged id, its rank) of adjacent symbols; rank NONE if none.
        Negative symbols (code points outside the vocabulary) never merge."""
        want = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        ok = (self.keys[at] == want) & (a >= 0) & (b >= 0)
        made = self.made[at]
        return made, np.where(ok, self.rank[made], self.NONE)


def vocabulary(path: str) -> Vocabulary:
    if path not in _MODELS:
        _MODELS[path] = Vocabulary(path)
    return _MODELS[path]


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start..start+len of each pair, one after the other."""
    total = int(lens.sum())
    return np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(total)
