"""Lines of texts as flat arrays: normal forms, word hashes, numbers of words. Numpy works on the bytes of many texts at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash

#: Thai, Lao, Burmese, Khmer, kana and Han have no spaces between words: each of their characters counts as one.
SIGNS = "ก-໿က-၉ၐ-႟ក-៓ぁ-ヺー-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff"
_SIGN = re.compile(f"[{SIGNS}]")
_OTHER = re.compile(f"[^\\w\x00-\x7f{SIGNS}]")  # beyond ASCII, part of no word
_LETTER = bytes(x in b"abcdefghijklmnopqrstuvwxyz0123456789_" or x >= 128 for x in range(256))
SPAN = 1 << 16  # bytes of words that are hashed at once
SOME = 1 << 20  # bytes of texts that become arrays at once, about


def powers(base: int) -> np.ndarray:
    out = np.ones(SPAN, dtype=np.uint64)
    for k in range(16):
        out[1 << k : 2 << k] = out[: 1 << k] * np.uint64(pow(base, 1 << k, 1 << 64))
    return out


_BASE = 0x9E3779B97F4A7C15
_UP, _DOWN = powers(_BASE), powers(pow(_BASE, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def plain(text: str) -> bytes:
    """Lower case; characters beyond ASCII that are part of no word become spaces, unspaced scripts get spaces. Line feeds stay."""
    low = text.lower()
    if low.isascii():
        return low.encode()
    low = _OTHER.sub(" ", low)
    data = low.encode("utf-8", "replace")
    if np.frombuffer(data, dtype=np.uint8).max() >= 0xE0 and _SIGN.search(low):  # none lies before U+0800
        data = _SIGN.sub(r" \g<0> ", low).encode("utf-8", "replace")
    return data


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words data[start:end], by differences of a running polynomial over spans that stay in the cache."""
    out, at = np.empty(len(start), dtype=np.uint64), 0
    while at < len(start):
        base = start[at]
        to = int(np.searchsorted(end, base + SPAN, side="right"))
        if to <= at:  # one word longer than a span
            out[at] = xxhash.xxh64_intdigest(data[base : end[at]].tobytes(), 7)
            at += 1
            continue
        part = data[base : end[to - 1]]
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part + np.uint64(1)) * _UP[: len(part)], out=total[1:])
        a, b = start[at:to] - base, end[at:to] - base
        out[at:to] = (total[b] - total[a]) * _DOWN[a]
        at = to
    return mixed(out)


@dataclass
class Lines:
    """The lines of some texts that hold a word, in order."""

    doc: np.ndarray  # number of the text
    line_no: np.ndarray
    normal: list[bytes]  # words, with a space between
    lid: np.ndarray  # 64-bit hash of the normal form
    n: np.ndarray  # words
    words: np.ndarray  # hashes of all words
    first: np.ndarray  # place of a line's first word in them

    def word_places(self, chosen: np.ndarray) -> np.ndarray:
        """Places of the words of the chosen lines, line by line."""
        n = self.n[chosen]
        return np.repeat(self.first[chosen] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def lines_of(texts: list[str]) -> Lines:
    data = [plain(t) for t in texts]
    counts = np.array([d.count(b"\n") + 1 for d in data], dtype=np.int64)
    whole = b"\n".join(data)
    flat = np.frombuffer(whole, dtype=np.uint8)
    word = np.zeros(len(flat) + 2, dtype=bool)
    word[1:-1] = np.frombuffer(whole.translate(_LETTER), dtype=bool)
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end, word = edge[::2].copy(), edge[1::2].copy(), word[1:-1]
    feed = flat == 10
    n = np.diff(np.searchsorted(start, np.flatnonzero(feed)), prepend=0, append=len(start)) if texts else np.zeros(0, dtype=np.int64)
    out, keep = flat.copy(), word | feed
    gap = start[start > 0] - 1
    gap = gap[out[gap] != 10]
    out[gap], keep[gap] = 32, True
    normal = out[keep].tobytes().split(b"\n")
    full = np.flatnonzero(n)
    normal = [normal[k].lstrip() for k in full.tolist()]
    lid = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in normal), dtype=np.uint64, count=len(normal))
    doc = np.repeat(np.arange(len(texts)), counts)[full]
    n = n[full]
    return Lines(doc, full - (np.cumsum(counts) - counts)[doc], normal, lid, n, hash_words(flat, start, end), np.cumsum(n) - n)


def some(texts: list[str]) -> Iterator[slice]:
    """Slices of the texts of about SOME characters each; a longer text is one of its own."""
    at = held = 0
    for k, t in enumerate(texts):
        if held and held + len(t) > SOME:
            yield slice(at, k)
            at, held = k, 0
        held += len(t)
    if at < len(texts):
        yield slice(at, len(texts))
