"""Fuzzy line dedup.

Lines are normalised to words; two are similar if the edit similarity of their words reaches 0.8. The edits that this
allows, a fifth of the words, can't touch all of a line's words: put the words of all lines in one order, rare words
first, and of the first fifth and one more of each of two similar lines, one is aligned with itself. So lines meet by
these pigeonholes, and no similar pair is missed; a SimHash of 64 bits would have to bear some 13 differing bits, which
no number of blocks makes selective. A pair that meets is told apart by its lengths, by the places of the shared word,
and by the exclusive-or of two sketches of 192 bits (parities of the hashes of its words, repeats told apart), of which an edit changes two bits at
most. Groups of lines so linked are verified by edit distance. Of each connected group of lines the first occurrence
stays (smallest doc_id, then place), all others go.

Meeting is by packed exchange: a task sorts its records into buckets of the keys' hashes and sends one row of bytes to
each, so neither the JVM nor Python handles a record by itself.
"""

from __future__ import annotations

import re
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm import line_words as lw
from calibra.llm.common import map_arrow, materialise, release, slices
from calibra.llm.components import connected_components, forest, stars

SIMILARITY = 0.8
#: Shorter lines, headings and list items, say too little to be similar: of these only exact repeats go, once they are REPEATS.
MIN_WORDS, REPEATS = 5, 5
#: Lines of a key, or of a group, that are compared at once; more are dealt over tiles.
TILE, GROUP = 4096, 512
#: Documents and words of the sample that tells which words are common; it sets the cost only, any order finds every pair.
SAMPLE, COMMON = 4000, 65_536
#: Bytes of records that a task holds before it sends them, and that a bucket has, about.
HELD, BUCKET = 16 << 20, 16 << 20
#: What tells the number of words, and so of buckets, before texts are parsed; it sets the cost only.
BYTES_A_WORD = 6
#: What meets in a bucket: the key's low half, words and the key word's place (both 65535 at most; then the place is unknown), the line, its parities.
RECORD = np.dtype([("key", "<u4"), ("n", "<u2"), ("place", "<u2"), ("lid", "<u8"), ("odd", "<u8", 3)])
LONG_RECORD = np.dtype([("key", "<u4"), ("n", "<u2"), ("place", "<u2"), ("lid", "<u8")])
#: A line's first place in what a task sends at once, with how often it is there; the other places go apart, as 0 times. ``known``: doc isn't null.
PLACE = np.dtype([("lid", "<u8"), ("doc", "<i8"), ("th", "<i8"), ("line", "<i4"), ("n", "<i4"), ("times", "<i4"), ("known", "?")])
MOST = 65_535
#: Words of the longer line beyond which a pair meets by word pairs (192 parities tell up to 140 apart); lines of a word pair of which every two are taken down.
LONG, FEW = 60, 32
LINES = "doc_id long, th long, line_no int, lid long, n int, parity binary"
ID, HASH, DROPPED = "__calibra_id", "__calibra_hash", "__calibra_dropped"
_WORD_OR_SIGN = re.compile(f"[{lw.SIGNS}]|[^\\W{lw.SIGNS}]+")


def line_words(line: str) -> list[str]:
    """The normal form: lower-case words, without punctuation and spacing; a character of an unspaced script is a word."""
    return _WORD_OR_SIGN.findall(line.lower())


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of two sequences, a bit column at a time (Myers 1999, Hyyro 2003) on integers of any length."""
    k, most = 0, min(len(a), len(b))
    while k < most and a[k] == b[k]:
        k += 1
    end, most = 0, most - k
    while end < most and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[k : len(a) - end], b[k : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, score = full, 0, len(a)
    for x in b:
        eq = where.get(x, 0)
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (~(zero | plus) & full), plus & zero
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1 | 1) & full
        plus, minus = ((down << 1) & full) | (~(zero | up) & full), up & zero
    return score


def allowed(n: np.ndarray, similarity: float) -> np.ndarray:
    """Edits that leave lines similar of which the longer has ``n`` words."""
    return np.floor((1 - similarity) * n + 1e-9).astype(np.int64)


def similar(a: list, b: list, least: float = SIMILARITY) -> bool:
    """Edit similarity: 1 - distance / longer length."""
    most = max(len(a), len(b))
    return min(len(a), len(b)) >= least * most and edit_distance(a, b) <= (1 - least) * most + 1e-9


def keyed(docs: DataFrame) -> DataFrame:
    """docs plus ID and HASH (of the whole text), under names that don't clash; rows alike in both count as one document."""
    return docs.withColumns({ID: F.col("doc_id").cast("long"), HASH: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})


def texts_of(docs: DataFrame) -> DataFrame:
    return keyed(docs).select(F.col(ID), F.col(HASH), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def line_rows(found: lw.Lines, batch: pa.RecordBatch, s: slice, similarity: float) -> dict:
    """The columns of ``lines`` for the texts ``s`` of a batch (id, hash, text)."""
    at = pa.array(found.doc + s.start)
    wide = found.n >= similarity * LONG
    parity = sparse(parities(found.words[found.word_places(np.flatnonzero(wide))], found.n[wide]), wide)
    return {"doc_id": batch.column(0).take(at), "th": batch.column(1).take(at), "line_no": found.line_no, "lid": found.lid.view(np.int64), "n": found.n, "parity": parity}


def lines(docs: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, th, line_no, lid, n, parity): every line with a word; lid hashes its normal form, n is its number of words.
    Lines that may be similar to one of more than LONG words have parities."""

    def work(batches):
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            for s in lw.some(texts):
                yield line_rows(lw.lines_of(texts[s]), batch, s, similarity)

    return map_arrow(texts_of(docs), work, LINES)


def common_words(docs: DataFrame, n_docs: int, most: int = COMMON) -> np.ndarray:
    """How common words are in a sample of about SAMPLE documents: eight steps to a doubling, by the top 18 bits of a word's hash."""
    sample = docs.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 1) / F.lit(float(1 << 63)) <= min(1.0, SAMPLE / max(1, n_docs)))

    def work(batches):
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            for s in lw.some(texts):
                word, n = np.unique(lw.lines_of(texts[s]).words, return_counts=True)
                yield {"word": word.view(np.int64), "n": n}

    found = map_arrow(texts_of(sample), work, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    top = found.orderBy(F.desc("n"), "word").limit(most).collect()
    table = np.zeros(1 << 18, dtype=np.uint8)
    slot = np.array([r.word for r in top], dtype=np.int64).view(np.uint64) >> np.uint64(46)
    np.maximum.at(table, slot, np.minimum(255, 8 * np.log2(np.array([r.n for r in top], dtype=np.float64))).astype(np.uint8))
    return table


def counted(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hashes of the words with how often they came before in their line, line by line. An edit changes two of a line's set of them."""
    order = np.repeat(np.arange(len(n), dtype=np.uint64) << np.uint64(32), n) | words >> np.uint64(32)
    order.sort()
    new = np.ones(len(order), dtype=bool)
    new[1:] = order[1:] != order[:-1]
    copy = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return lw.mixed((order & np.uint64(0xFFFFFFFF)) + (copy.astype(np.uint64) << np.uint64(32)))


def ranked(words: np.ndarray, n: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Places of the words (or word pairs), line by line, the rarest of each line first: one order of all, by commonness and hash."""
    line = np.repeat(np.arange(len(n)), n)
    if len(n) > MOST or not len(n) or n.max() > MOST:
        return np.lexsort((words, kind, line))
    first = np.cumsum(n) - n
    place = np.arange(len(words)) - np.repeat(first, n)
    # one number a word: line, kind, 24 bits of the hash, place
    order = line.astype(np.uint64) << np.uint64(48) | kind.astype(np.uint64) << np.uint64(40) | (words >> np.uint64(6) & np.uint64(0xFFFFFF)) << np.uint64(16) | place.astype(np.uint64)
    order.sort()
    at = first[(order >> np.uint64(48)).astype(np.int64)] + (order & np.uint64(0xFFFF)).astype(np.int64)
    order >>= np.uint64(16)
    tie = np.flatnonzero((order[1:] == order[:-1]) & (words[at[1:]] != words[at[:-1]]))
    for k in tie.tolist():  # few: unlike words that agree in the 24 bits
        a, b = np.searchsorted(order, order[k], "left"), np.searchsorted(order, order[k], "right")
        at[a:b] = at[a:b][np.lexsort((at[a:b], words[at[a:b]]))]
    return at


def rarest(words: np.ndarray, n: np.ndarray, kind: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, their lines, their places): of each line the rarest ``wanted``, repeats counted but taken once. Repeated ones have place MOST."""
    first = np.cumsum(n) - n
    at, line = ranked(words, n, kind), np.repeat(np.arange(len(n)), n)
    rank, word = np.arange(len(words)) - np.repeat(first, n), words[at]
    again = np.zeros(len(word), dtype=bool)
    again[1:] = (word[1:] == word[:-1]) & (line[1:] == line[:-1])
    repeated = again.copy()
    repeated[:-1] |= again[1:]
    take = (rank < np.repeat(wanted, n)) & ~again
    return word[take], line[take], np.where(repeated[take], MOST, np.minimum(at[take] - first[line[take]], MOST))


def records(found: lw.Lines, chosen: np.ndarray, common: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(whole keys, RECORDs) of the chosen lines: of each line its rarest words, one more than edits can touch."""
    n = found.n[chosen]
    words, first = found.words[found.word_places(chosen)], np.cumsum(n) - n
    key, of, place = rarest(words, n, common[words >> np.uint64(46)], allowed(n, similarity) + 1)
    # a line's parities: bit hash * 192 >> 32, of three 64-bit numbers
    bit = ((counted(words, n) & np.uint64(0xFFFFFFFF)) * np.uint64(192)) >> np.uint64(32)
    odd = np.empty((len(n), 3), dtype=np.uint64)
    for k in range(3):
        odd[:, k] = np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == k, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0)), first) if len(first) else 0
    out = np.empty(len(key), dtype=RECORD)
    out["key"], out["n"], out["place"], out["lid"], out["odd"] = key & np.uint64(0xFFFFFFFF), np.minimum(n, MOST)[of], place, found.lid[chosen][of], odd[of]
    return key, out


def long_records(found: lw.Lines, chosen: np.ndarray, common: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(whole keys, LONG_RECORDs) of the chosen lines: their rarest pairs of neighbouring words, more than edits can touch.

    A pair of lines keeps n - 1 - 2 d of the longer one's n - 1 word pairs, so the shorter loses 2 d at most, less the
    difference of length; as d is the longer one's, one more is taken.
    """
    n = found.n[chosen]
    words = found.words[found.word_places(chosen)]
    kind = common[words >> np.uint64(46)].astype(np.int64)
    last = np.zeros(len(words), dtype=bool)
    last[np.cumsum(n) - 1] = True
    pair, both = lw.mixed(words * np.uint64(3) + np.roll(words, -1))[~last], ((kind + np.roll(kind, -1)) // 2)[~last]
    key, of, place = rarest(pair, n - 1, both, np.minimum(n - 1, 2 * allowed(n, similarity) + 2))
    out = np.empty(len(key), dtype=LONG_RECORD)
    out["key"], out["n"], out["place"], out["lid"] = key & np.uint64(0xFFFFFFFF), np.minimum(n, MOST)[of], place, found.lid[chosen][of]
    return key, out


def sparse(values: pa.Array, there: np.ndarray) -> pa.Array:
    """``values`` in the places that are ``there``, in order, null elsewhere."""
    return values.take(pa.array(np.cumsum(there) - 1, mask=~there))


def by_line(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether a line is new) of PLACEs: line by line, each line's first place (a null document, the smallest doc_id) first."""
    order = np.argsort(rows["lid"], kind="stable")
    lid = rows["lid"][order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = lid[1:] != lid[:-1]
    many = ~new
    many[:-1] |= ~new[1:]
    at = order[many]
    order[many] = at[np.lexsort([rows[c][at] for c in ("line", "th", "doc", "known", "lid")])]
    return order, new


def places_of(found: lw.Lines, batch: pa.RecordBatch, s: slice) -> np.ndarray:
    """The PLACEs of all lines of the texts ``s`` of a batch (id, hash, text), each one time."""
    doc, out = found.doc + s.start, np.empty(len(found.n), dtype=PLACE)
    out["doc"], out["known"] = batch.column(0).fill_null(0).to_numpy()[doc], batch.column(0).is_valid().to_numpy(zero_copy_only=False)[doc]
    out["lid"], out["th"], out["line"], out["n"], out["times"] = found.lid, batch.column(1).to_numpy()[doc], found.line_no, found.n, 1
    return out


def packed(docs: DataFrame, common: np.ndarray, buckets: int, min_words: int, similarity: float, whole: bool = False) -> DataFrame:
    """(bucket, long, data, odd): the records of all lines of ``min_words`` or more, by the upper half of their keys. With ``whole``
    also PLACEs of all lines, so that texts are parsed once for both. Their ``long`` is null, ``odd`` has the parities of wide ones.
    First places go by the line's hash; what is beyond them, and so a line that is in every document, goes to any bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def work(batches):
        held, own, size, seen = ([], []), ([], []), 0, set()
        spots = count(TaskContext.get().partitionId() * 1_000_003)

        def send():
            if own[0]:
                rows, parity = np.concatenate(own[0]), pa.concat_arrays(own[1])
                order, new = by_line(rows)
                at, more = order[new], rows[order[~new]]
                more["times"], times = 0, np.diff(np.append(np.flatnonzero(new), len(order)))
                rows, parity = rows[at], parity.take(pa.array(at))
                rows["times"] = times
                found, start = np.unique((rows["lid"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), return_index=True)  # in order, as lines are
                cuts = list(zip(start.tolist(), np.append(start[1:], len(rows)).tolist(), strict=True))
                yield {"bucket": found.astype(np.int64), "long": [None] * len(found), "data": [rows[a:b].tobytes() for a, b in cuts], "odd": [bytes_of(parity.slice(a, b - a)) for a, b in cuts]}
                if len(more):
                    yield {"bucket": [next(spots) % buckets], "long": [None], "data": [more.tobytes()], "odd": [b""]}
                for parts in own:
                    parts.clear()
            for kind, parts in enumerate(held):
                if parts:
                    keys, rows = (np.concatenate([h[k] for h in parts]) for k in (0, 1))
                    bucket = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                    order = np.argsort(bucket, kind="stable")
                    rows, (found, at) = rows[order], np.unique(bucket[order], return_index=True)
                    ends = np.append(at[1:], len(rows))
                    yield {"bucket": found.astype(np.int64), "long": np.full(len(found), bool(kind)), "data": [rows[a:b].tobytes() for a, b in zip(at.tolist(), ends.tolist(), strict=True)], "odd": [None] * len(found)}
                    parts.clear()

        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            for s in lw.some(texts):
                found = lw.lines_of(texts[s])
                if whole and len(found.n):
                    wide = found.n >= similarity * LONG
                    own[0].append(places_of(found, batch, s))
                    own[1].append(sparse(parities(found.words[found.word_places(np.flatnonzero(wide))], found.n[wide]), wide))
                    size += own[0][-1].nbytes + own[1][-1].nbytes
                lid, at = np.unique(found.lid, return_index=True)
                new = [k for k, x in zip(at.tolist(), lid.tolist(), strict=True) if x not in seen]
                seen.update(lid.tolist())
                if len(seen) > 300_000:  # what is sent twice costs, and is no fault
                    seen.clear()
                chosen = np.sort(np.array(new, dtype=np.int64))
                n = found.n[chosen]
                for parts, make, some in ((held[0], records, chosen[(n >= min_words) & (n <= LONG)]), (held[1], long_records, chosen[n >= max(min_words, similarity * LONG)])):
                    if len(some):
                        parts.append(make(found, some, shared.value, similarity))
                        size += parts[-1][1].nbytes
                if size > HELD:
                    yield from send()
                    size = 0
        yield from send()

    return map_arrow(texts_of(docs), work, "bucket long, long boolean, data binary, odd binary")


def bytes_of(values: pa.Array) -> bytes:
    """The bytes of binary values, one after another."""
    a, b = np.frombuffer(values.buffers()[1], dtype=np.int32)[[values.offset, values.offset + len(values)]].tolist()
    return values.buffers()[2][a:b].to_pybytes() if b > a else b""


def whole_buckets(batches):
    """(bucket, long, its records or PLACEs, parities) of rows sorted by bucket and kind."""
    last, held, odd = None, [], []
    for batch in batches:
        for bucket, kind, data, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if held and (bucket, kind) != last:
                yield *last, np.concatenate(held), odd
                held, odd = [], []
            last = bucket, kind
            held.append(np.frombuffer(data.as_buffer(), dtype=PLACE if kind is None else LONG_RECORD if kind else RECORD))
            if kind is None:
                odd.append(bits.as_buffer())
    if held:
        yield *last, np.concatenate(held), odd


def first_places(rows: np.ndarray, odd: list, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(first place, times, its parities) of each line of a bucket's PLACEs, and before these all other places."""
    main = rows["times"] > 0
    more, rows = rows[~main], rows[main]
    wide = rows["n"] >= similarity * LONG
    data = np.concatenate([np.frombuffer(x, dtype=np.uint8) for x in odd])
    parity = sparse(binaries(data, parity_bits(rows["n"][wide]) // 8), wide)
    order, new = by_line(rows)
    at = order[new]
    times = np.add.reduceat(rows["times"][order].astype(np.int64), np.flatnonzero(new)) if len(at) else np.zeros(0, dtype=np.int64)
    return np.concatenate([more, rows[order[~new]]]), rows[at], times, parity.take(pa.array(at))


class Places:
    """Where the shared word of RECORDs or LONG_RECORDs stands, and the edits that are allowed."""

    def __init__(self, rows: np.ndarray, similarity: float):
        self.before = rows["place"].astype(np.int32)
        self.after = rows["n"].astype(np.int32) - self.before
        self.edits = allowed(rows["n"].astype(np.int64), similarity).astype(np.int32)
        self.unknown = (rows["place"] == MOST) | (rows["n"] == MOST)

    def fit(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the words of i and j, j no shorter, may be aligned with each other."""
        return (np.abs(self.before[i] - self.before[j]) + np.abs(self.after[i] - self.after[j]) <= self.edits[j]) | self.unknown[i] | self.unknown[j]


def neighbours(group: np.ndarray, rows: np.ndarray, similarity: float):
    """(i, j), j no shorter, step by step: all rows of one group whose lengths may be similar. Rows are sorted by group and length."""
    n = rows["n"].astype(np.int32)
    shortest = np.ceil(similarity * n - 1e-9).astype(np.int32)
    at, d = np.arange(len(rows)), 1
    while True:
        at = at[at + d < len(rows)]
        at = at[(group[at] == group[at + d]) & (n[at] >= shortest[at + d])]
        if not len(at):
            return
        yield at, at + d
        d += 1


def links_of(group: np.ndarray, rows: np.ndarray, similarity: float) -> dict:
    """Links of RECORDs that may be similar, down to a forest."""
    _, node = np.unique(rows["lid"], return_inverse=True)
    label, places = np.arange(len(rows)), Places(rows, similarity)
    odd = [np.ascontiguousarray(rows["odd"][:, k]) for k in range(3)]
    for i, j in neighbours(group, rows, similarity):
        near = places.fit(i, j)
        i, j = i[near], j[near]
        open_ = label[node[i]] != label[node[j]]
        i, j = i[open_], j[open_]
        far = np.zeros(len(i), dtype=np.int32)
        for part in odd:
            far += np.bitwise_count(part[i] ^ part[j])
        alike = far <= 2 * places.edits[j]
        label = forest(node[i[alike]], node[j[alike]], len(rows), label)
    lid = np.zeros(len(rows), dtype=np.uint64)
    lid[node] = rows["lid"]
    leaf = np.flatnonzero(label != np.arange(len(rows)))
    return {"a": lid[leaf].view(np.int64), "b": lid[label[leaf]].view(np.int64)}


def pairs_of(rows: np.ndarray, similarity: float) -> dict:
    """The pairs of LONG_RECORDs that may be similar, each once. Their groups have FEW lines."""
    one, other = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.uint64)]
    places, lid, long = Places(rows, similarity), np.ascontiguousarray(rows["lid"]), rows["n"] > LONG
    for i, j in neighbours(np.ascontiguousarray(rows["key"]), rows, similarity):
        near = places.fit(i, j) & long[j] & (lid[i] != lid[j])
        x, y = lid[i[near]], lid[j[near]]
        one.append(np.minimum(x, y))
        other.append(np.maximum(x, y))
    a, b = np.concatenate(one), np.concatenate(other)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return {"a": a[new].view(np.int64), "b": b[new].view(np.int64)}


def by_key_and_size(rows: np.ndarray) -> np.ndarray:
    return rows[np.argsort(rows["key"].astype(np.uint64) << np.uint64(16) | rows["n"], kind="stable")]


def prefix_links(docs: DataFrame, distinct: DataFrame, words: int, n_docs: int, similarity: float = SIMILARITY, min_words: int = MIN_WORDS, tile: int = TILE, few: int = FEW, bucket_bytes: int = BUCKET) -> DataFrame:
    """(a, b): lines that share a key and may be similar, down to a spanning forest of each bucket. ``words``: of all lines, about.

    distinct: (lid, n, parity).
    """
    return met_links(meetings(docs, words, n_docs, similarity, min_words, tile, few, bucket_bytes), distinct, similarity, tile)


LINK, PAIR, HOT, HOT_LONG, LINE, MORE = range(6)


def meetings(docs: DataFrame, words: int, n_docs: int, similarity: float, min_words: int, tile: int = TILE, few: int = FEW, bucket_bytes: int = BUCKET, whole: bool = False) -> DataFrame:
    """What becomes of the buckets, by kind, as a written table; with ``whole`` also all lines (LINE: each once, a is its first
    doc_id, b th, part line_no, data parity; MORE: its other places).

    A word of more than ``tile`` lines isn't compared in its bucket: its lines are dealt over pairs of tiles. Nor are the
    lines of a word pair that has more than ``few``: they meet again with their wide parities.
    """
    spark = docs.sparkSession
    expected = int(words * (1 - similarity) + 1) * RECORD.itemsize
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), expected // bucket_bytes)
    sent = packed(docs, common_words(docs, n_docs), buckets, min_words, similarity, whole)
    schema = "kind int, a long, b long, part int, data binary, lid long, n int, times long"

    def rows_of(kind, a, b, part=None, data=None):
        none = [None] * len(a)
        return {"kind": [kind] * len(a), "a": a, "b": b, "part": none if part is None else part, "data": data or none, "lid": none, "n": none, "times": none}

    def places(kind, rows, times=None, parity=None):
        own = {c: np.ascontiguousarray(rows[c]) for c in PLACE.names}
        empty = {"data": pa.nulls(len(rows), pa.binary()) if parity is None else parity, "times": pa.nulls(len(rows), pa.int64()) if times is None else times}
        return {"kind": np.full(len(rows), kind), "a": pa.array(own["doc"], mask=~own["known"]), "b": own["th"], "part": own["line"], "lid": own["lid"].view(np.int64), "n": own["n"]} | empty

    def work(batches):
        more: list[dict] = []

        def within(_):
            for bucket, kind, rows, odd in whole_buckets(batches):
                if kind is None:
                    others, *first = first_places(rows, odd, similarity)
                    more.extend([places(LINE, *first), places(MORE, others)])
                    yield {"a": [], "b": []}
                    continue
                rows = by_key_and_size(rows)
                _, start, size = np.unique(rows["key"], return_index=True, return_counts=True)
                most = few if kind else tile
                for a, m in zip(start[size > most].tolist(), size[size > most].tolist(), strict=True):
                    _, own = np.unique(rows["lid"][a : a + m], return_index=True)
                    some, key = rows[a : a + m][own], int(rows["key"][a]) | bucket << 32
                    parts = -(-len(own) // tile)
                    if kind:
                        more.append(rows_of(HOT_LONG, np.full(len(some), key), some["lid"].view(np.int64), np.full(len(some), parts)))
                        continue
                    home = (some["lid"] >> np.uint64(7)) % np.uint64(parts)
                    more.extend(rows_of(HOT, [key], [None], [k], [some[home == k].tobytes()]) for k in range(parts))
                rows = rows[np.repeat(size <= most, size)]
                if len(rows) and kind:
                    more.append(rows_of(PAIR, *pairs_of(rows, similarity).values()))
                yield links_of(np.ascontiguousarray(rows["key"]), rows, similarity) if len(rows) and not kind else {"a": [], "b": []}

        for found in chain(stars(within)(None), [None]):
            while more:
                yield more.pop()
            if found:
                yield rows_of(LINK, found["a"], found["b"])

    met = materialise(map_arrow(sent.repartition("bucket").sortWithinPartitions("bucket", "long"), work, schema))
    del sent
    release(spark)
    return met


def met_links(met: DataFrame, distinct: DataFrame, similarity: float, tile: int = TILE) -> DataFrame:
    """(a, b) of ``meetings``: the links found in buckets, and those of what has to be compared elsewhere."""
    of = lambda kind: met.where(F.col("kind") == kind)
    hot = of(HOT).select(F.col("a").alias("key"), "part", "data")
    # every two parts of a hot word, each with itself among them
    parts = hot.alias("x").join(hot.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.part") <= F.col("y.part"))).select(F.col("x.part").alias("i"), F.col("y.part").alias("j"), F.col("x.data").alias("one"), F.col("y.data").alias("other"))

    def compare(batches):
        for batch in batches:
            for i, j, one, other in zip(*(batch.column(c) for c in range(4)), strict=True):
                rows = np.concatenate([np.frombuffer(x.as_buffer(), dtype=RECORD) for x in ((one,) if i == j else (one, other))])
                rows = rows[np.argsort(rows["n"], kind="stable")]
                yield links_of(np.zeros(len(rows), dtype=np.int8), rows, similarity)

    wide = distinct.where("parity IS NOT NULL").select("lid", "n", "parity")
    pairs = of(PAIR).select("a", "b").distinct()
    one, other = (wide.select(F.col("lid").alias(k), F.col("n").alias(f"n_{k}"), F.col("parity").alias(f"parity_{k}")) for k in ("a", "b"))
    pairs = pairs.join(one, "a").join(other, "b").select("a", "b", "n_a", "n_b", "parity_a", "parity_b")

    def tell(batches):
        for batch in batches:
            if batch.num_rows:
                a, b, n_a, n_b = (batch.column(c).to_numpy() for c in range(4))
                swap = n_a > n_b
                n = np.where(np.stack([swap, ~swap], axis=1), np.stack([n_b, n_b], axis=1), np.stack([n_a, n_a], axis=1))
                parity = [x for s, p, q in zip(swap.tolist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True) for x in ((q, p) if s else (p, q))]
                at = 2 * np.arange(len(a))
                alike = Told(np.repeat(np.arange(len(a)), 2), n.reshape(-1).astype(np.int64), parity, similarity).alike(at, at + 1)
                yield {"a": a[alike], "b": b[alike]}

    again = of(HOT_LONG).select(F.col("a").alias("key"), F.col("b").alias("lid"), F.col("part").alias("tiles")).join(wide, "lid")
    cell = F.when(F.col("j") > 0, F.xxhash64("key", "i", "j")).otherwise(F.col("key")).alias("cell")
    again = spread(again, "lid").select(cell, "n", "lid", "parity").repartition("cell").sortWithinPartitions("cell", "n")

    def meet(batches):
        for part in whole_groups(batches, 1):
            lid = part.column(2).to_numpy()
            label = np.arange(len(lid))
            for i, j in Told(numbered(part, 1), part.column(1).to_numpy().astype(np.int64), part.column(3).to_pylist(), similarity).pairs(lambda x, y: label[x] == label[y]):
                label = forest(i, j, len(lid), label)
            leaf = np.flatnonzero(label != np.arange(len(lid)))
            yield {"a": lid[leaf], "b": lid[label[leaf]]}

    schema = "a long, b long"
    links = of(LINK).select("a", "b")
    for rows, compared in ((parts, compare), (pairs, tell), (again, meet)):
        links = links.unionByName(map_arrow(rows, stars(compared), schema))
    return links


def binaries(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """One binary value per run of ``lengths`` items of ``data``."""
    at = np.concatenate([[0], np.cumsum(lengths)]) * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def parity_bits(n: np.ndarray) -> np.ndarray:
    """Bits of a line's parities: the least power of two from 128 on that is no less than 2.5 a word."""
    return 1 << np.maximum(7, np.ceil(np.log2(np.maximum(1, 2.5 * n))).astype(np.int64))


def parities(words: np.ndarray, n: np.ndarray) -> pa.Array:
    """Of each run of ``n`` word hashes: how often each remainder of their counted() hashes occurs, modulo two. Halves fold by exclusive-or."""
    bits, words = parity_bits(n), counted(words, n)
    place = np.repeat(np.cumsum(bits) - bits, n) + (words & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(place, minlength=int(bits.sum())) & 1
    return binaries(np.packbits(odd.astype(np.uint8), bitorder="little"), bits // 8)


def whole_groups(batches, keys: int):
    """Batches sorted by their first ``keys`` columns, cut so that no group is parted. Groups are bounded by tiling."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        same = np.ones(table.num_rows, dtype=bool)
        for c in range(keys):
            values = table.column(c).to_numpy()
            same &= values == values[-1]
        cut = int(table.num_rows - same.sum())
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks()
    if held is not None:
        yield held


def numbered(table: pa.Table, keys: int) -> np.ndarray:
    """Group numbers of sorted rows."""
    new = np.zeros(table.num_rows, dtype=bool)
    for c in range(keys):
        values = table.column(c).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.cumsum(new)


def dealt(rows: DataFrame, key: str, by: str, tile: int) -> DataFrame:
    """rows plus i, j: the tile pairs of their key that they meet in; one pair (0, 0) for keys of ``tile`` rows or fewer."""
    hot = rows.groupBy(key).count().where(F.col("count") > tile).select(key, F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    # hot keys are one in ``tile`` rows at most
    return spread(rows.join(F.broadcast(hot), key, "left"), by)


def spread(rows: DataFrame, by: str) -> DataFrame:
    """rows (tiles, ...) -> i, j in the place of tiles: the tile pairs that a row meets in; one pair (0, 0) if tiles is null or 1."""
    own = F.pmod(F.xxhash64(by), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda s: F.struct(F.least(s, own).alias("i"), F.greatest(s, own).alias("j")))
    met = rows.withColumn("p", F.explode(F.when(F.col("tiles") > 1, pairs).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))))
    return met.drop("tiles").withColumns({"i": F.col("p.i"), "j": F.col("p.j")}).drop("p")


class Told:
    """Lines of groups, sorted by group and length: pairs that their lengths and parities don't tell apart."""

    def __init__(self, group: np.ndarray, n: np.ndarray, parity: list[bytes], similarity: float):
        self.group, self.n, self.similarity = group, n, similarity
        self.width = parity_bits(n) // 64
        self.power = np.log2(self.width).astype(np.int64)
        self.first = np.cumsum(self.width) - self.width
        self.flat = np.frombuffer(b"".join(parity), dtype="<u8")

    def alike(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether i and j, j no shorter, may be within their limit of edits: each changes two parities at most."""
        out = np.zeros(len(i), dtype=bool)
        most = 2 * np.floor((1 - self.similarity) * self.n[j] + 1e-9)
        both = self.power[i] * 64 + self.power[j]
        for code in np.flatnonzero(np.bincount(both)).tolist():
            at, w, v = np.flatnonzero(both == code), 1 << (code >> 6), 1 << (code & 63)
            a, b, far = self.first[i[at]], self.first[j[at]], np.zeros(len(at), dtype=np.int64)
            for k in range(w):
                part = self.flat[a + k]
                for u in range(k, v, w):  # the wider one's halves fold
                    part ^= self.flat[b + u]
                far += np.bitwise_count(part)
            out[at] = far <= most[at]
        return out

    def pairs(self, linked):
        """(i, j) step by step; pairs that ``linked`` says are in one group already are passed over."""
        at, d = np.arange(len(self.n)), 1
        while True:
            at = at[at + d < len(self.n)]
            at = at[(self.group[at] == self.group[at + d]) & (self.n[at] >= self.similarity * self.n[at + d] - 1e-9)]
            if not len(at):
                return
            open_ = at[~linked(at, at + d)]
            near = open_[self.alike(open_, open_ + d)]
            if len(near):
                yield near, near + d
            d += 1


def verified_links(groups: DataFrame, similarity: float) -> DataFrame:
    """groups (comp, lid, n, parity, words) -> (a, b): spanning links of lines that are similar."""
    sent = dealt(groups, "comp", "lid", GROUP).select("comp", "i", "j", "n", "lid", "parity", "words").repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "n", "lid")

    def work(batches):
        for part in whole_groups(batches, 3):
            lid, texts, split, out = part.column(4).to_numpy(), part.column(6), {}, []
            label = np.arange(len(lid))

            def words(x):
                if x not in split:
                    split[x] = texts[x].as_py().split(" ")
                return split[x]

            for i, j in Told(numbered(part, 3), part.column(3).to_numpy().astype(np.int64), part.column(5).to_pylist(), similarity).pairs(lambda x, y: label[x] == label[y]):
                met = [k for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)) if similar(words(x), words(y), similarity)]
                if met:
                    label = forest(i[met], j[met], len(lid), label)
                if len(split) > 20_000:
                    split.clear()
            leaf = np.flatnonzero(label != np.arange(len(lid)))
            yield {"a": lid[leaf], "b": lid[label[leaf]]}

    return map_arrow(sent, stars(work), "a long, b long")


def fetched(docs: DataFrame, suspects: DataFrame) -> DataFrame:
    """(comp, lid, n, parity, words) of suspects (lid, n, comp, doc_id, th, line_no): words are read from the first document that has the line."""
    wanted = suspects.groupBy(F.col("doc_id").alias("of_id"), F.col("th").alias("of_th")).agg(F.collect_list(F.struct("line_no", "comp")).alias("wanted"))
    texts = texts_of(docs)
    # the texts, the larger side by far, needn't be sorted: no document is wanted twice
    found = texts.join(wanted.hint("shuffle_hash"), texts[ID].eqNullSafe(wanted["of_id"]) & (texts[HASH] == wanted["of_th"])).select("text", "wanted")

    def work(batches):
        for batch in slices(batches):
            texts, wanted = batch.column(0).to_pylist(), batch.column(1)
            for s in lw.some(texts):
                own = lw.lines_of(texts[s])
                asked = wanted.slice(s.start, s.stop - s.start)
                of = np.repeat(np.arange(len(asked)), asked.value_lengths().to_numpy())
                asked = asked.flatten()
                # lines are in the order of text and number
                at = np.searchsorted(own.doc << 32 | own.line_no, of << 32 | asked.field("line_no").to_numpy())
                n = own.n[at]
                yield {"comp": asked.field("comp"), "lid": own.lid[at].view(np.int64), "n": n, "parity": parities(own.words[own.word_places(at)], n), "words": [own.normal[k].decode() for k in at.tolist()]}

    return map_arrow(found, work, "comp long, lid long, n int, parity binary, words string")


def dropped_lines(docs: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, th, dropped): per document the numbers of the lines that go."""
    size = docs.agg(F.count(F.lit(1)).alias("docs"), F.sum(F.octet_length(F.col("text").cast("string"))).alias("bytes")).first()
    met = meetings(docs, (size["bytes"] or 0) // BYTES_A_WORD, size["docs"], similarity, min_words, whole=True)
    place = F.struct("doc_id", "th", "line_no")
    at = [F.col("a").alias("doc_id"), F.col("b").alias("th"), F.col("part").alias("line_no"), "lid"]
    distinct, more = met.where(F.col("kind") == LINE).select(*at, "n", F.col("data").alias("parity"), "times"), met.where(F.col("kind") == MORE).select(*at)
    parts = connected_components(met_links(met, distinct, similarity))
    suspects = materialise(distinct.join(parts, distinct["lid"] == parts["node"]).select("lid", "n", F.col("component").alias("comp"), "doc_id", "th", "line_no"))
    linked = connected_components(verified_links(materialise(fetched(docs, suspects)), similarity))
    joined = suspects.join(linked, suspects["lid"] == linked["node"]).select("lid", "component", place.alias("first"))
    kept = joined.groupBy("component").agg(F.min("first").alias("kept"))
    of_group = joined.join(kept, "component").select("lid", "first", "kept")
    least = F.when(F.col("n") < min_words, repeats).otherwise(2)
    repeated = distinct.where(F.col("times") >= least).select("lid", place.alias("own"))
    rule = materialise(repeated.join(of_group, "lid", "full").select("lid", F.coalesce("first", "own").alias("first"), F.coalesce("kept", "own").alias("kept")))
    gone = more.join(rule.select("lid", "kept"), "lid").where(~place.eqNullSafe(F.col("kept"))).select("doc_id", "th", "line_no")
    gone = gone.union(rule.where(~F.col("first").eqNullSafe(F.col("kept"))).select("first.doc_id", "first.th", "first.line_no"))
    return gone.groupBy("doc_id", "th").agg(F.collect_set("line_no").alias("dropped"))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores behind it as long as it is taken."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def line_dedup(docs: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS, repeats: int = REPEATS) -> DataFrame:
    """docs, with all their columns, the text without its repeated lines; plus n_lines and n_dropped (with underscores
    behind the names if docs has columns so called, which stay as they are).

    Lines end at a line feed. Lines without a word stay. Of a line of fewer than ``min_words`` words the first
    stays, if it occurs ``repeats`` times or more, or else all do. A null text stays
    null and an empty one empty; a document may end up empty but no row goes. Rows with equal doc_id and text count as
    one document, so both keep the same lines; a null doc_id comes first. Long texts become arrays a megabyte at a time, a
    longer one by itself, and a line of any length is one line. An empty table gives none.
    """
    gone = dropped_lines(docs, similarity, min_words, repeats).select(F.col("doc_id").alias("g_id"), F.col("th").alias("g_th"), F.col("dropped").alias(DROPPED))
    full = keyed(docs)
    met = full.join(gone.hint("shuffle_hash"), full[ID].eqNullSafe(gone["g_id"]) & (full[HASH] == gone["g_th"]), "left").select(*[full[c] for c in docs.columns], DROPPED)
    plain = F.split("text", "\n", -1)
    n = F.coalesce(F.size(F.col(DROPPED)), F.lit(0))
    left = F.array_join(F.filter(plain, lambda x, k: ~F.array_contains(F.col(DROPPED), k)), "\n")
    lines_name, dropped_name = (free_name(c, docs.columns) for c in ("n_lines", "n_dropped"))
    out = met.withColumns({lines_name: F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, 0).otherwise(F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1), dropped_name: F.when(F.col(DROPPED).isNull(), 0).otherwise(n)})
    return out.withColumn("text", F.when(F.col(DROPPED).isNull(), F.col("text")).otherwise(left)).drop(DROPPED)


def op4(spark, sf_dir: str) -> DataFrame:
    from calibra.llm.common import table

    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
