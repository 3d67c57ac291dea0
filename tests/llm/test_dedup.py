"""SimHash, line dedup and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from calibra.llm import line_dedup as ld
from calibra.llm import line_words as lw
from calibra.llm import simhash as sh
from calibra.llm.components import connected_components


def groups(n, linked):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return [root(i) for i in range(n)]


def plain_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text).encode().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(docs):
    rows = [(r.doc_id, plain_fingerprint(r.text or "")) for r in docs.collect()]
    label = groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (rows[i][1] ^ rows[j][1]).bit_count() <= 3])
    least: dict = {}
    for (d, _), g in zip(rows, label, strict=True):
        least[g] = min((x for x in (least.get(g), d) if x is not None), default=None)
    return sorted(repr((d, fp, least[g])) for (d, fp), g in zip(rows, label, strict=True))


def test_near_duplicates(documents, odd_docs, no_docs):
    for docs in (documents, odd_docs):
        got = [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in sh.near_duplicates(docs).collect()]
        assert sorted(map(repr, got)) == brute(docs)
    assert sh.near_duplicates(no_docs).count() == 0


def test_links_find_every_pair_within_the_radius(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = sorted({b ^ sum(1 << k for k in set(rng.choices(range(64), k=rng.randint(0, 5)))) for b in base for _ in range(6)})
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    want = groups(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    at = {x: i for i, x in enumerate(signed)}
    assert groups(len(fps), [(at[r.a], at[r.b]) for r in sh.fingerprint_links(df, tile=7).collect()]) == want


@pytest.mark.parametrize("local", [0, 30, 1 << 20])
def test_components(spark, local):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, rng.randint(8, 60)) for _ in range(50)] + [(3, 3), (200, 201), (200, 201)]
    df = spark.createDataFrame([*links, (None, 4), (5, None)], "x long, y long")
    got = {r.node: r.component for r in connected_components(df, local=local).collect()}
    label = groups(300, [x for x in links if x[0] != x[1]])
    touched = {v for x in links if x[0] != x[1] for v in x}
    assert got == {v: label[v] for v in touched}
    assert connected_components(df.where("false"), local=local).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    assert ld.edit_distance(a, b) == row[-1]


def similar_lines(rows):
    """rows (doc_id, text) -> text without repeated lines, by edit similarity alone, every pair compared."""
    seen = [(d, k, w) for d, text in sorted(rows) for k, line in enumerate(text.split("\n")) if len(w := ld.line_words(line)) >= ld.MIN_WORDS]
    label = groups(len(seen), [(i, j) for i in range(len(seen)) for j in range(i) if ld.similar(seen[i][2], seen[j][2])])
    gone = {(d, k) for i, (d, k, _) in enumerate(seen) if label[i] != i}
    short: dict = {}
    for d, text in sorted(rows):
        for k, line in enumerate(text.split("\n")):
            if 0 < len(w := ld.line_words(line)) < ld.MIN_WORDS:
                short.setdefault(tuple(w), []).append((d, k))
    gone |= {x for places in short.values() if len(places) >= ld.REPEATS for x in places[1:]}
    return {d: "\n".join(x for k, x in enumerate(text.split("\n")) if (d, k) not in gone) for d, text in rows}


def test_line_dedup(spark, documents, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in documents.where("length(text) < 6000").limit(150).collect()]
    long = " ".join(f"word{i}" for i in range(90))
    rows += [(90_000 + i, f"intro {i} of this very page\n{long.replace(f'word{i}', 'other')}") for i in range(6)]
    got = ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = similar_lines(rows)
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(rows)
    assert sum(r.n_dropped for r in got) > 10
    odd = ld.line_dedup(odd_docs)
    assert odd.columns[: len(odd_docs.columns)] == odd_docs.columns and odd.count() == odd_docs.count()
    assert {(r.doc_id, r.text) for r in odd.collect() if r.doc_id in (4, 5)} == {(4, None), (5, "")}
    clash = ld.line_dedup(odd_docs.selectExpr("doc_id", "text", "77 AS n_lines", "'x' AS N_Dropped"))
    assert clash.columns == ["doc_id", "text", "n_lines", "N_Dropped", "n_lines_", "n_dropped_"]
    assert {(r["n_lines"], r["N_Dropped"]) for r in clash.collect()} == {(77, "x")} and clash.agg({"n_dropped_": "sum"}).first()[0] > 0
    assert ld.line_dedup(no_docs).count() == 0


def test_short_lines_and_unspaced_scripts(spark):
    chinese, thai = "今天天气很好，我们去公园玩，然后回家吃饭。", "วันนี้อากาศดีมากเราไปเที่ยวสวนสาธารณะกัน"
    assert len(ld.line_words(chinese)) == 18 and ld.line_words("C'est 12 ans, ÉTÉ_x 東京abc") == ["c", "est", "12", "ans", "été_x", "東", "京", "abc"]
    rows = [(1, f"{chinese}\n{thai}\nAll rights reserved.\nContents\n\n--")]
    rows += [(k, f"own{k} words of page{k} stay{k}\nall rights, reserved\n\n--" + "\nContents" * (k < 5)) for k in range(2, 6)]
    rows += [(6, f"{chinese.replace('公园', '海边')}\n{thai}"), (7, "Contents")]
    got = {r.doc_id: r.text for r in ld.line_dedup(spark.createDataFrame(rows[:-1], "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1]} | {k: f"own{k} words of page{k} stay{k}\n\n--" + "\nContents" * (k < 5) for k in range(2, 6)} | {6: ""}
    assert got == similar_lines(rows[:-1])
    got = {r.doc_id: r.text for r in ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[7] == "" and got[2].count("Contents") == 0 and got[1].count("Contents") == 1


def test_every_similar_line_is_found(spark, documents):
    rng = random.Random(9)
    rows = [(r.doc_id, r.text) for r in documents.where("length(text) < 4000").limit(120).collect()]
    for at, n in enumerate((5, 6, 9, 10, 11, 20, 50, 51, 52, 103, 300) * 4):
        line = [rng.choice(("the", "of", "and", f"w{rng.randrange(10_000)}")) for _ in range(n)]
        for copy in range(2):
            for _ in range(copy * rng.randint(1, max(1, n // 5))):
                k = rng.randrange(len(line))
                line[k : k + rng.randint(0, 1)] = [f"x{rng.randrange(10_000)}"] * rng.randint(0, 1)
            rows.append((80_000 + 2 * at + copy, " ".join(line)))
    got = {r.doc_id: r.text for r in ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == similar_lines(rows) and sum(not t for t in got.values()) > 15


def test_hot_keys_and_small_tiles_lose_no_link(spark):
    rng = random.Random(3)
    texts = []
    for size, count in ((40, 90), (62, 60), (150, 30)):  # groups that drift: their ends are unlike; the second is about as long as LONG
        base = [f"b{size}_{k}" for k in range(size)]
        for _ in range(count):
            for _ in range(rng.randint(1, size // 12)):
                k = rng.randrange(size - 12)
                base[k : k + rng.randint(0, 1)] = [f"n{rng.randrange(10**6)}"] * rng.randint(0, 2)
            base += [f"t{rng.randrange(10**6)}" for _ in range(size - len(base))]
            texts.append(" ".join(base[: size + 10]))
    texts += [" ".join(["zz"] * rng.randint(5, 60)) for _ in range(30)] + ["", "word", "a b c d e"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links = {}
    distinct = ld.lines(df, 0.8).dropDuplicates(["lid"])
    for tile, few in ((4, 3), (4096, 10**6), (4096, 3)):
        found = ld.prefix_links(df, distinct, 40 * len(texts), len(texts), tile=tile, few=few, bucket_bytes=1 << 12)
        links[tile, few] = sorted((r.node, r.component) for r in connected_components(found).collect())
    assert links[4, 3] == links[4096, 10**6] == links[4096, 3]
    lid = {x: xxhash.xxh3_64_intdigest(x.encode()) - (1 << 64) * (xxhash.xxh3_64_intdigest(x.encode()) >> 63) for x in texts}
    group = dict(links[4, 3])
    words = [t.split(" ") for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] != texts[j] and min(len(words[i]), len(words[j])) >= ld.MIN_WORDS and ld.similar(words[i], words[j]):
                assert group[lid[texts[i]]] == group[lid[texts[j]]]


def test_lines_as_arrays(documents):
    odd = ["今天天气很好，我们去公园玩，\n\n然后回家吃饭。x", "วันนี้อากาศดีมาก\n(Hello) world-wide  É“q”\n\n", "İstanbul C'est 12 ans, ÉTÉ_x 東京abc\n--", "", "\n", "a" * 200_000 + " b", "x" * 70_000 + " " + "y z " * 70_000]
    for texts in (odd, [r.text or "" for r in documents.collect()]):
        seen = 0
        for s in lw.some(texts):
            found = lw.lines_of(texts[s])
            want = [(d, k, " ".join(w).encode()) for d, x in enumerate(texts[s]) for k, line in enumerate(x.split("\n")) if (w := ld.line_words(line))]
            assert list(zip(found.doc.tolist(), found.line_no.tolist(), found.normal, strict=True)) == want
            assert found.n.tolist() == [len(x.split(b" ")) for x in found.normal]
            words = b" ".join(found.normal).split(b" ") if found.normal else []
            assert len(set(zip(words, found.words.tolist(), strict=True))) == len(set(words)) == len(set(found.words.tolist()))
            seen += s.stop - s.start
        assert seen == len(texts)


def test_long_lines_take_the_general_order():
    words = np.random.default_rng(1).integers(0, 1 << 63, 70_010).astype(np.uint64)
    n, common = np.array([70_000, 10]), np.zeros(1 << 18, dtype=np.uint8)
    at = ld.ranked(words, n, common[words >> np.uint64(46)])
    assert (np.diff(words[at][:70_000].astype(object)) >= 0).all() and sorted(at[70_000:]) == list(range(70_000, 70_010))


def test_texts_are_parsed_once_for_lines_and_records(spark, monkeypatch):
    def apart(*_):
        raise AssertionError("a pass of its own over all texts")

    monkeypatch.setattr(ld, "lines", apart)
    rows = [(k, f"one line that all of them have in common\nown{k} words of page{k} stay{k} here{k} too{k}\n\n--") for k in range(40)]
    got = ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: r.text for r in got} == similar_lines(rows) and {r.n_lines for r in got} == {4} and sum(r.n_dropped for r in got) == 39


def test_buckets_give_each_line_once_with_its_first_place(spark):
    wide = " ".join(f"word{k}" for k in range(70))
    rows = [(k % 7 if k else None, f"all the same in here\nown{k}\n{wide}\nshort" + "\nall the same, in here" * (k % 3)) for k in range(40)] + [(3, "all the same in here")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    met = ld.meetings(docs, 5_000, len(rows), 0.8, ld.MIN_WORDS, whole=True).collect()
    want: dict = {}
    for r in ld.lines(docs, 0.8).collect():
        want.setdefault(r.lid, []).append((r.doc_id is not None, r.doc_id, r.th, r.line_no, r.n, r.parity))
    firsts = [r for r in met if r.kind == ld.LINE]
    assert len(firsts) == len(want) == 43 and sum(r.times for r in firsts) == sum(map(len, want.values()))
    assert {r.lid: (r.a is not None, r.a, r.b, r.part, r.n, r.data) for r in firsts} == {k: min(v, key=lambda x: (x[0], x[1] or 0, *x[2:4])) for k, v in want.items()}
    got = sorted(repr((r.lid, r.a, r.b, r.part)) for r in met if r.kind in (ld.LINE, ld.MORE))
    assert got == sorted(repr((k, *x[1:4])) for k, v in want.items() for x in v)
