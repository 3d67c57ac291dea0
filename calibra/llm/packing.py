"""Best-fit packing by minimum bin slack.

Tokenising writes one row per piece: its length, its scan partition and its rank among that partition's pieces of the
same length. Only the histogram of lengths (at most ``capacity`` numbers) reaches the driver. There each bin starts
with the longest length left; dynamic programming over a bitset of reachable sums finds the fullest feasible rest;
that combination is taken as often as the counts allow, and removed. The plan says which ranks of each length go to
which sequences, so the pieces find their places by a search in the plan, without a sort or a hot group.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calibra.llm.common import BoundedCache, documents, map_arrow, materialise, slices, vocabulary
from calibra.llm.words import PreTokens, chunks

CAPACITY = 4096
END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class ChunkEncoder:
    """Ids of whole texts as little-endian 32-bit numbers; the library's model encodes each distinct pre-token once."""

    def __init__(self, path: str):
        self.words = PreTokens(path)
        self.model = self.words.library.model
        self.of_word = BoundedCache(self.encode_word, 600_000)
        self.of_chunk = BoundedCache(self.encode_chunk, 600_000)

    def encode_word(self, word: str) -> bytes:
        return pack_ids([t.id for t in self.model.tokenize(word)])

    def encode_chunk(self, chunk: str) -> bytes:
        parts = self.words.parts(chunk)
        if len(parts) == 1:
            return b"".join([self.of_word[w] for w in self.words.of(chunk)])
        return b"".join([pack_ids([self.words.specials[part]]) if k % 2 else self.encode_chunk(part) if part else b"" for k, part in enumerate(parts)])

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.of_chunk.__getitem__, chunks(text)))


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(1)
def encoder_of(path: str) -> ChunkEncoder:
    """One encoder for the life of a Python worker, so that its memory of chunks outlives a task."""
    return ChunkEncoder(path)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The documents' pieces, each with its partition and its rank there among pieces of its length."""
    path = path or vocabulary("word_bpe_49k.json")
    end = pack_ids([END_ID])

    def work(batches):
        encoder, seen, part = encoder_of(path), np.zeros(capacity + 1, dtype=np.int64), TaskContext.get().partitionId()
        names = [c.split()[0] for c in PIECES.split(", ")]
        for batch in slices(batches):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), map(encoder.encode, batch.column("text").to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    body = ids[at : at + 4 * capacity]
                    n = len(body) // 4
                    rows.append((doc_id, k, at // 4, n, zlib.crc32(body), part, int(seen[n])))
                    seen[n] += 1
            yield {name: [r[i] for r in rows] for i, name in enumerate(names)}

    return map_arrow(documents(docs), work, PIECES)


def fullest(counts: dict[int, int], space: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum within ``space``.

    A bitset holds the reachable sums. Each length enters in chunks of 1, 2, 4, ... copies; a sum remembers the chunk
    that first reached it, so the choice is read back from the top. It stops once ``space`` itself is reachable.
    """
    if space <= 0:
        return {}
    reach, mask = 1, (1 << space + 1) - 1
    steps: list[tuple[int, int, int]] = []  # newly reached sums, length, copies
    for length in sorted(counts, reverse=True):
        left, size = min(counts[length], space // length), 1
        while left > 0 and not reach >> space & 1:
            size = min(size, left)
            new = (reach << length * size) & mask & ~reach
            if new:
                steps.append((new, length, size))
                reach |= new
            left, size = left - size, size * 2
        if reach >> space & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for new, length, size in reversed(steps):
        if at and new >> at & 1:
            chosen[length] = chosen.get(length, 0) + size
            at -= length * size
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> Iterator[tuple[list[tuple[int, int]], int]]:
    """(combination [(length, copies)], times) until nothing is left; every combination is the fullest around its longest piece."""
    counts = {length: n for length, n in histogram.items() if n > 0}
    while counts:
        first = max(counts)
        counts[first] -= 1
        chosen = fullest({k: n for k, n in counts.items() if n > 0 and k <= capacity - first}, capacity - first)
        counts[first] += 1
        chosen[first] = chosen.get(first, 0) + 1
        times = min(counts[k] // n for k, n in chosen.items())
        for k, n in chosen.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        yield sorted(chosen.items(), reverse=True), times


def plan_table(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, copies a bin, first sequence, offset). Its size follows from the number of distinct
    lengths (at most ``capacity``; under 91 distinct ones fit a bin of 4096), not from the number of pieces."""
    found: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for chosen, times in plan_bins(histogram, capacity):
        offset = 0
        for length, copies in chosen:
            found.setdefault(length, []).append((used.get(length, 0), copies, sequence, offset))
            used[length] = used.get(length, 0) + copies * times
            offset += copies * length
        sequence += times
    return {k: np.array(v, dtype=np.int64) for k, v in found.items()}


def place(lengths: np.ndarray, ranks: np.ndarray, plan: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of the piece with each rank among the pieces of its length."""
    sequence, offset = np.empty_like(ranks), np.empty_like(ranks)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        table = plan[int(length)]
        row = table[np.searchsorted(table[:, 0], ranks[at], side="right") - 1]
        within = ranks[at] - row[:, 0]
        sequence[at] = row[:, 2] + within // row[:, 1]
        offset[at] = row[:, 3] + within % row[:, 1] * length
    return sequence, offset


def best_fit_packing(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every document's pieces in as few sequences as found.

    A null or empty text is a piece of one token, the end id. Only documents of more than ``capacity`` tokens are cut.
    Repeated rows are packed once each; null doc_ids stay null; an empty table gives none; extra columns are left behind.
    """
    spark = docs.sparkSession
    made = materialise(pieces(docs, path, capacity))
    by_part = made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(plan_table(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_rank"))
    ranked = made.join(starts, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_rank") + F.col("local_rank")).alias("rank"))

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                lengths, ranks = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
                sequence, offset = place(lengths, ranks, plan.value)
                yield {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": sequence, "offset": offset}

    return map_arrow(ranked, work, PLACED)
