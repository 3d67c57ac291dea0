"""Token counting, packing and the transducer against the libraries."""

import random
import zlib

import numpy as np
import pytest

from calibra.llm.common import vocabulary
from calibra.llm.packing import ChunkEncoder, best_fit_packing, fullest, plan_bins
from calibra.llm.token_counts import MergeCounter, token_counts
from calibra.llm.transducer import Transducer, transducer_encoding

WORDS, PIECES = vocabulary("word_bpe_49k.json"), vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    pool = [chr(c) for c in [*range(1, 0x500), *range(0x1E00, 0x2100), *range(0x3040, 0x3100)]]
    out = ["", " ", "a", "<|endoftext|>x <|EndOfText|><|startoftext|>", "ΣΑΣ İstanbul Straße", "x\x1cy\x1fz \x85 b", "don't I'LL 45.6 $$$", "\x00a\x07", "▁▁ ▁a▁b", "   lead   trail   ", "a" * 700, "\n\n\n cc\n", "<s></s><0x0A>", " " * 40 + "the" + " " * 17 + "q", "é Å ﬁ ½ ²", "👩‍👩‍👧"]
    out += ["".join(rng.choice("  aAbthe\n'sdlreΣσéÉñü0129$%&.,-_|<>▁\t　日中x") for _ in range(50)) for _ in range(200)]
    return out + ["".join(rng.choices(pool, k=30)) for _ in range(200)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_counts_and_ids_equal_the_library(texts, library, documents):
    counter, encoder = MergeCounter(WORDS), ChunkEncoder(WORDS)
    for t in texts + [r.text for r in documents.limit(60).collect()]:
        ids = library(t)
        assert counter.count(t) == len(ids), t
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == ids, t


def test_transducer_equals_the_library(texts, documents):
    import sentencepiece

    sp, machine = sentencepiece.SentencePieceProcessor(model_file=PIECES), Transducer(PIECES)
    for t in texts + [r.text for r in documents.limit(60).collect()]:
        ids = machine.encode(t)
        assert ids == sp.encode(t), t
        assert machine.decode(ids) == sp.decode(ids), t


def test_unigram_weights_equal_the_library(tmp_path):
    """A hand-written unigram model: the same machines with scores as weights, and byte fallback."""
    import struct

    import sentencepiece

    def varint(n):
        return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])

    def message(number, data):
        return varint(number << 3 | 2) + varint(len(data)) + data

    def piece(text, score, kind):
        return message(1, message(1, text.encode()) + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind]))

    normal = {"▁": -2.0, "a": -3.5, "b": -4.1, "ab": -5.3, "▁a": -3.9, "▁ab": -7.2, "ba": -6.05, "aba": -9.03, "bb": -8.6, "é": -9.9}
    model = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3) + b"".join(piece(f"<0x{b:02X}>", 0, 6) for b in range(256))
    model += b"".join(piece(*x, 1) for x in normal.items())
    model += message(2, b"\x18\x01" + varint(35 << 3) + b"\x01") + message(3, b"\x18\x01\x20\x00\x28\x01")
    path = tmp_path / "unigram.model"
    path.write_bytes(model)
    sp, machine = sentencepiece.SentencePieceProcessor(model_file=str(path)), Transducer(str(path))
    rng = random.Random(5)
    for t in ["", " ", "ab", "né ☃a", *("".join(rng.choices("aabb  éz☃", k=rng.randint(1, 40))) for _ in range(300))]:
        ids = machine.encode(t)
        assert ids == sp.encode(t), t
        assert machine.decode(ids) == sp.decode(ids), t


def test_text_without_boundaries_equals_the_library():
    import sentencepiece

    sp, machine = sentencepiece.SentencePieceProcessor(model_file=PIECES), Transducer(PIECES)
    for t in ("ab" * 30_000, "a" * 100_001):
        assert machine.encode(t) == sp.encode(t)


def test_encoding_query_equals_the_library(documents):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = {r.doc_id: sp.encode(r.text or "") for r in documents.collect()}
    rows = transducer_encoding(documents).collect()
    assert {r.doc_id: (r.n_ids, r.ids_crc32) for r in rows} == {k: (len(v), zlib.crc32(np.array(v, dtype="<u4").tobytes())) for k, v in ids.items()}


def test_counts_of_odd_rows(odd_docs, no_docs, library):
    rows = token_counts(odd_docs).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(library(r.text or ""))) for r in odd_docs.collect()]
    assert sorted(map(repr, [(r.doc_id, r.n_bytes, r.n_tokens) for r in rows])) == sorted(map(repr, want))
    assert all(r.over_limit == (r.n_tokens > 2048) for r in rows)
    assert token_counts(no_docs).count() == 0


def test_encoding_of_odd_rows(odd_docs, no_docs):
    rows = transducer_encoding(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.round_trip for r in rows)
    assert {r.n_ids for r in rows if r.n_bytes == 0} == {0}
    assert transducer_encoding(no_docs).count() == 0


def test_fullest_is_optimal():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 15): rng.randint(1, 3) for _ in range(4)}
        space = rng.randint(0, 40)
        sums = {0}
        for k, n in counts.items():
            sums |= {s + k * i for s in sums for i in range(n + 1)}
        got = fullest(counts, space)
        assert all(n <= counts[k] for k, n in got.items())
        assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= space)


def test_plan_uses_every_piece_once():
    histogram = {4096: 7, 4000: 3, 96: 5, 50: 11, 1: 40}
    used: dict = {}
    for chosen, times in plan_bins(histogram):
        assert sum(k * n for k, n in chosen) <= 4096
        for k, n in chosen:
            used[k] = used.get(k, 0) + n * times
    assert used == histogram


def packed(docs, library, rows):
    want = []
    for r in docs.collect():
        ids = [*library(r.text or ""), 1]
        want += [(r.doc_id, k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    assert sorted(map(repr, [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows])) == sorted(map(repr, want))
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    return bins


def test_packing(spark, documents, odd_docs, no_docs, library):
    bins = packed(documents, library, rows := best_fit_packing(documents).collect())
    assert len(bins) <= -(-sum(r.length for r in rows) // 4096) + 2
    packed(odd_docs, library, best_fit_packing(odd_docs).collect())
    assert best_fit_packing(no_docs).count() == 0
