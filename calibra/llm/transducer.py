"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from the model. The normaliser has one state: an arc for the space, whose output is the space
mark, identity arcs for all else, and the dummy prefix as the output on entering. The piece machine is a trie whose final
arcs write a piece; byte fallback is an arc for each character without a piece, which writes the ids of its UTF-8 bytes.
For a unigram model an arc weighs what its piece's score takes away, and the fallback ten more than the worst piece. For a
byte-pair model, scores as weights don't give the library's segmentation, as merging is greedy. But a segmentation is the
greedy one exactly if each pair of neighbours is what merging makes of the two together. So piece arcs weigh 0, and a third
machine accepts neighbours: a pair weighs 0 if merging its text gives the pair back, and infinity if not; it is compiled
lazily and remembered. Each input is composed with the machines on the fly, and the shortest path in the tropical semiring
is the encoding. Decoding runs the piece machine backwards. States of a part that no piece boundary cuts are held in
memory, so a text without any boundary takes memory in proportion to its length.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache
from heapq import heappop, heappush
from math import inf

import numpy as np
from pyspark.sql import DataFrame

from calibra.llm.common import BoundedCache, documents, map_arrow, slices, vocabulary

MARK = "▁"
SCHEMA = "doc_id long, n_bytes long, n_ids long, ids_crc32 long, round_trip boolean"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes):
    """(field number, value) of a protocol buffer message: integers, or bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = varint() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, data[at : at + n]
        at += n


class Model:
    """Pieces, scores, kinds and normaliser settings of a SentencePiece model file."""

    def __init__(self, path: str):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.dummy_prefix, self.trim, self.escape, self.charsmap = 1, True, True, True, b""
        with open(path, "rb") as f:
            data = f.read()
        for number, value in fields(data):
            if number == 1:
                x = dict(fields(value))
                self.pieces.append((x[1].decode(), float(np.frombuffer(x.get(2, b"\0\0\0\0"), "<f4")[0]), x.get(3, NORMAL)))
            elif number == 2:
                self.kind = dict(fields(value)).get(3, 1)
            elif number == 3:
                x = dict(fields(value))
                self.charsmap, self.dummy_prefix, self.trim, self.escape = x.get(2, b""), bool(x.get(3, 1)), bool(x.get(4, 1)), bool(x.get(5, 1))
        kinds = {kind for _, _, kind in self.pieces}
        if self.kind not in (1, 2) or self.charsmap or self.trim or not self.escape or BYTE not in kinds or USER in kinds:
            raise ValueError("made for unigram and byte-pair models with byte fallback, without own symbols, that keep white space and have no table of characters")
        if self.kind == 1 and any(score > 0 for _, score, kind in self.pieces if kind == NORMAL):
            raise ValueError("scores of a unigram model are logarithms of probabilities")


class Transducer:
    """encode() and decode() of one model; ``text -> ids`` equal to the library's."""

    def __init__(self, path: str):
        model = Model(path)
        pairs = model.kind == 2
        self.ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind == NORMAL}
        self.scores = {p: s for p, s, kind in model.pieces if kind == NORMAL}
        self.texts = {i: p for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = next(i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN)
        self.dummy_prefix = model.dummy_prefix
        self.normaliser = {" ": MARK}
        self.fallback = 0.0 if pairs else 10.0 - min(self.scores.values())
        self.trie: dict = {}
        for piece, score in self.scores.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = (0.0 if pairs else -score, piece)
        # No piece crosses these places, so what lies between them can be composed, and remembered, on its own.
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            self.units = None
        else:
            self.units = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if not any("\n" in p for p in self.ids) else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.follows = BoundedCache(self.pair_weight, 2_000_000) if pairs else None
        self.inside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.written = BoundedCache(self.output)
        self.of_atom = BoundedCache(self.encode_atom, 500_000)
        self.of_unit = BoundedCache(self.encode_unit, 500_000)
        self.of_ids = BoundedCache(self.decode_ids, 500_000)

    def normalise(self, text: str) -> str:
        for read, written in self.normaliser.items():
            text = text.replace(read, written)
        return MARK + text if text and self.dummy_prefix else text

    def output(self, label: str) -> bytes:
        """What the arc of a piece, or of a character without one, writes."""
        numbers = [self.ids[label]] if label in self.ids else [self.bytes[b] for b in label.encode()]
        return struct.pack(f"<{len(numbers)}I", *numbers)

    def merged(self, text: str) -> list[str]:
        """What greedy merging makes of a short text; used to compile the acceptor."""
        out, score = list(text), self.scores.get
        best = [score(a + b, -inf) for a, b in zip(out, out[1:], strict=False)]
        while best and (top := max(best)) > -inf:
            i = best.index(top)
            out[i : i + 2] = [out[i] + out[i + 1]]
            del best[i]
            if i:
                best[i - 1] = score(out[i - 1] + out[i], -inf)
            if i < len(best):
                best[i] = score(out[i] + out[i + 1], -inf)
        return out

    def pair_weight(self, pair: tuple[str, str]) -> float:
        """Weight of a piece after another ('' is the start)."""
        return 0.0 if self.merged(pair[0] + pair[1]) == [p for p in pair if p] else inf

    def shortest_path(self, text: str) -> list[str]:
        """Uniform-cost search of the composition, whose states are (place, last piece), or places without an acceptor.

        The state of least weight is relaxed next, and of equal ones that which is farthest. A pair's weight, 0 or
        infinity, is looked up only when its state is taken from the heap, so most pairs are never compiled.
        """
        n, root, pieces, follows = len(text), self.trie, self.ids, self.follows
        heap, seen = [(0.0, 0, "", None)], set()
        while heap:
            state = heappop(heap)
            cost, at, piece, before = state
            at = -at
            if before is not None and follows is not None and follows[before[2], piece]:
                continue
            label = at if follows is None else (at, piece)
            if label in seen:
                continue
            seen.add(label)
            if at == n:
                path = []
                while state[3] is not None:
                    path.append(state[2])
                    state = state[3]
                return path[::-1]
            if text[at] not in pieces:
                heappush(heap, (cost + self.fallback, -at - 1, text[at], state))
            node, k = root, at
            while k < n and (node := node.get(text[k])) is not None:
                k += 1
                if "" in node:
                    weight, piece = node[""]
                    heappush(heap, (cost + weight, -k, piece, state))
        raise ValueError("no path")

    def atoms(self, unit: str) -> list[str]:
        """The unit cut wherever no piece holds the two characters side by side."""
        out, start, inside = [], 0, self.inside
        for k, (a, b) in enumerate(zip(unit, unit[1:], strict=False), 1):
            if a + b not in inside:
                out.append(unit[start:k])
                start = k
        out.append(unit[start:])
        return out

    def encode_unit(self, unit: str) -> bytes:
        return b"".join(map(self.of_atom.__getitem__, self.atoms(unit)))

    def encode_atom(self, atom: str) -> bytes:
        return b"".join(map(self.written.__getitem__, self.shortest_path(atom)))

    def split(self, text: str) -> list[str]:
        normal = self.normalise(text)
        return self.units.findall(normal) if self.units else [normal] if normal else []

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        return b"".join(map(self.of_unit.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode_ids(self, ids: bytes) -> str:
        """The output side run backwards: pieces to text, runs of byte ids to characters; the marks stay."""
        numbers = struct.unpack(f"<{len(ids) // 4}I", ids)
        try:
            return "".join([self.texts[i] for i in numbers])
        except KeyError:
            out, run = [], bytearray()
        for i in numbers:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(self.texts.get(i, " ⁇ " if i == self.unknown else ""))
        return "".join(out) + run.decode("utf-8", "replace")

    def surface(self, marked: str) -> str:
        text = marked.replace(MARK, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    def decode(self, ids: list[int]) -> str:
        return self.surface(self.decode_ids(np.array(ids, dtype="<u4").tobytes()))


@lru_cache(1)
def transducer_of(path: str) -> Transducer:
    """One transducer for the life of a Python worker, so that what it has composed outlives a task."""
    return Transducer(path)


def transducer_encoding(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_ids, ids_crc32, round_trip) of every whole text.

    round_trip: decoding the ids gives the text back (false only where the text holds the space mark itself). Null and
    empty texts have no ids; repeated rows give a row each; an empty table gives none; extra columns are left behind.
    """
    path = path or vocabulary("piece_bpe_32k.model")

    def work(batches):
        machine = transducer_of(path)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            parts = [[machine.of_unit[u] for u in machine.split(t)] for t in texts]
            ids = [b"".join(p) for p in parts]
            back = [machine.surface("".join(map(machine.of_ids.__getitem__, p))) for p in parts]
            yield {"doc_id": batch.column("doc_id"), "n_bytes": [len(t.encode()) for t in texts], "n_ids": [len(x) // 4 for x in ids], "ids_crc32": [zlib.crc32(x) for x in ids], "round_trip": [a == b for a, b in zip(back, texts, strict=True)]}

    return map_arrow(documents(docs), work, SCHEMA)
