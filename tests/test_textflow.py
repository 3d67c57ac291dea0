"""Attributes, TF-IDF, singular vectors, linkage and assignment against plain Python and numpy."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.operators import text
from calibra.operators.attributes import attributes
from calibra.operators.sampling import sample_each, stable_sample
from calibra.operators.stage import staged
from calibra.plans import textflow

SF = "/root/testdata/sf0.001"


def seeded(k, seed=42):
    return hashlib.sha256(f"{seed}:{k}".encode()).hexdigest()


def test_attributes_of_titles(spark):
    cases = [
        ("Will Bitcoin be above $90,000?", "$90,000 or above", "KXBTCD-25", "crypto", "BTC", "above", 90000.0, None),
        ("Highest temperature in NYC?", "80° to 81°", "KXHIGHNY-25", "weather", "HIGHNY", "interval", 80.0, 81.0),
        ("S&P 500 close", "Below 5,000.5", "INX-1", "equities", "SP500", "below", None, 5000.5),
        ("Lakers at Celtics winner?", "", "KXNBAGAME-1", "sports", "NBA", "winner", None, None),
        ("LeBron points", "25+", "KXNBAPTS-1", "sports", "NBAPTS", "above", 25.0, None),
        ("Chiefs wins by over 3.5?", None, "NFLSPREAD-1", "sports", "NFL", "spread", None, None),
        ("What will Powell say?", "Inflation", "KXFEDMENTION-2", "mentions", "FEDMENTION", "unknown", None, None),
        ("Something else", None, None, "unknown", "unknown", "unknown", None, None),
        (None, None, "", "unknown", "unknown", "unknown", None, None),
    ]
    df = spark.createDataFrame([(k, *c[:3], "x") for k, c in enumerate(cases)], "k int, title string, yes_sub_title string, event_ticker string, domain string").drop("domain")
    got = {r.k: r for r in attributes(df).collect()}
    for k, c in enumerate(cases):
        r = got[k]
        assert (r.domain, r.underlying, r.structure, r.low, r.high) == c[3:], c
        assert r.family == "/".join(c[3:6])


def test_stable_samples(spark):
    df = spark.range(3000).withColumn("g", F.col("id") % 3)
    want = sorted(range(3000), key=seeded)[:50]
    assert sorted(r.id for r in stable_sample(df.repartition(7), "id", 50).collect()) == sorted(want)
    assert stable_sample(df, "id", 10_000).count() == 3000 and stable_sample(df.where("false"), "id", 5).count() == 0
    each = defaultdict(list)
    for r in sample_each(df, "g", "id", 4).collect():
        each[r.g].append(r.id)
    assert {g: sorted(v) for g, v in each.items()} == {g: sorted(sorted(range(g, 3000, 3), key=seeded)[:4]) for g in range(3)}


def plain_terms(t):
    words = re.findall(r"\b\w\w+\b", (t or "").lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def plain_tfidf(texts, terms=20_000, fit=None):
    fit = texts if fit is None else fit
    tf, df = Counter(), Counter()
    for t in fit:
        c = Counter(plain_terms(t))
        tf.update(c)
        df.update(c.keys())
    kept = sorted(sorted((t for t in df if df[t] >= 2), key=lambda t: (-tf[t], t))[:terms])
    place = {t: k for k, t in enumerate(kept)}
    out = np.zeros((len(texts), len(kept)))
    for r, t in enumerate(texts):
        for term, n in Counter(plain_terms(t)).items():
            if term in place:
                out[r, place[term]] = (1 + math.log(n)) * (math.log((1 + len(fit)) / (1 + df[term])) + 1)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return kept, out / np.where(norm == 0, 1, norm)


TITLES = ["red apple pie", "Red apple tart, red", "blue ocean wave", "blue ocean tide", "red apple pie crust", "blue ocean", None, "", "a b c", "zzz yyy", "ünï ocean ünï", "red red red apple"]


@pytest.mark.parametrize("terms", [20_000, 4])
def test_vectors_equal_numpy(spark, terms):
    df = spark.createDataFrame([(k, t, "v") for k, t in enumerate(TITLES)], "id long, text string, vector string")
    kept, a = plain_tfidf(TITLES, terms)
    fitted = text.fit_vocabulary(df, terms=terms)
    assert fitted.terms == kept
    fitted = text.fit_svd(fitted, df.repartition(3))
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    k = min(64, len(kept) - 1, len(TITLES) - 1)
    assert fitted.basis.shape == (len(kept), k) and np.allclose(fitted.singular, s[:k], atol=1e-7)
    got = {r.id: np.array(r.vector) for r in fitted.encode(df).collect()}
    x = a @ vt[:k].T
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(norm < 1e-9, 1, norm)
    mine = np.stack([got[i] for i in range(len(TITLES))])
    solid = [i for i in range(len(TITLES)) if norm[i] > 1e-6 or not a[i].any()]
    assert len(solid) >= 10 and np.allclose(mine[solid] @ mine[solid].T, x[solid] @ x[solid].T, atol=1e-6)
    assert not mine[6].any() and not mine[7].any()


def test_too_few_texts(spark):
    df = spark.createDataFrame([("only one",)], "text string")
    with pytest.raises(ValueError):
        text.fit_svd(text.fit_vocabulary(df, min_docs=1), df)


def plain_linkage(x, distance):
    groups = [[i] for i in range(len(x))]
    d = 1 - x @ x.T
    while len(groups) > 1:
        best = min(((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        if best[0] >= distance:
            break
        groups[best[1]] += groups.pop(best[2])
    label = np.zeros(len(x), dtype=int)
    for k, g in enumerate(sorted(groups, key=min)):
        label[g] = k
    return label


@pytest.mark.parametrize("n,dims,distance", [(1, 3, 0.35), (2, 2, 0.35), (60, 4, 0.35), (60, 4, 0.1), (80, 8, 0.7), (50, 3, 2.5)])
def test_linkage_equals_plain(n, dims, distance):
    x = np.random.default_rng(n + dims).standard_normal((n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert text.average_linkage(x, distance).tolist() == plain_linkage(x, distance).tolist()
    assert text.average_linkage(np.repeat(x, 2, axis=0), 1e-9).max() == n - 1


@pytest.mark.parametrize("n,dims,distance", [(1, 3, 0.35), (25, 4, 0.35), (30, 8, 0.7)])
def test_linkage_of_rows_that_count_for_several(n, dims, distance):
    rng = np.random.default_rng(n)
    x, own = rng.standard_normal((n, dims)), rng.integers(1, 4, n)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.repeat(text.average_linkage(x, distance, own), own).tolist() == plain_linkage(np.repeat(x, own, axis=0), distance).tolist()


def test_centres_are_made_of_all_rows(spark):
    rng = np.random.default_rng(8)
    x = np.eye(6)[rng.integers(4, size=1200)] + 0.02 * rng.standard_normal((1200, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[600:1000] = x[:400]  # rows with equal vectors count each
    df = spark.createDataFrame([(k, "f", v.tolist()) for k, v in enumerate(x)], "id long, family string, vector array<double>")
    got = {r.cluster: r for r in text.family_centres(df).collect()}
    kind = x.argmax(axis=1)
    assert sum(r.members for r in got.values()) == 1200 and len(got) == 4
    for c, k in enumerate(dict.fromkeys(kind.tolist())):  # clusters are numbered by their first row
        mean = x[kind == k].mean(axis=0)
        assert got[c].members == (kind == k).sum() and np.allclose(got[c].centre, mean / np.linalg.norm(mean), atol=1e-12)


def test_centres_of_bags_are_those_of_vectors(spark):
    rows = [(k, f"f{k % 2}", t) for k, t in enumerate(TITLES * 4)]
    df = spark.createDataFrame(rows, "id long, family string, text string")
    encoder = text.fit_svd(text.fit_vocabulary(df), df)
    bags = encoder.bags(df, "text", "id", ("family",))
    assert bags.count() < len(rows) and bags.agg(F.sum("n")).first()[0] == len(rows)
    one, other = ({(r.family, r.cluster): (r.members, r.centre) for r in c.collect()} for c in (text.family_centres(bags, encoder=encoder), text.family_centres(encoder.encode(df))))
    assert {k: v[0] for k, v in one.items()} == {k: v[0] for k, v in other.items()} and all(np.allclose(one[k][1], other[k][1], atol=1e-9) for k in one)


def test_names_of_clusters_beyond_999(spark):
    near = spark.createDataFrame([(k, k, "train", "f", 1234 + k % 2, 1.0) for k in range(8)], "ticker long, event_id long, split string, family string, cluster int, similarity double")
    assert {r.cluster for r in text.assignments(near, contracts=2, events=2).collect()} == {"f/1234", "f/1235"}


def test_assignment_equals_plain(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(700):
        family, split = f"f{k % 5}", "test" if k % 5 == 4 else ("train", "train", "validation", "test")[int(rng.integers(4))]
        centre = np.eye(6)[int(rng.integers(4))]
        v = centre + 0.35 * rng.standard_normal(6)
        v = v / np.linalg.norm(v) if k % 41 else np.zeros(6)
        rows.append((k, int(rng.integers(60)), split, family, v.tolist()))
    rows += [(1000, 1, "train", "lone", [1.0] + [0.0] * 5), (1001, 1, "test", "lone", [0.0, 1.0] + [0.0] * 4), (1002, 1, "train", "blank", [0.0] * 6)]
    df = spark.createDataFrame(rows, "ticker long, event_id long, split string, family string, vector array<double>").withColumn("cluster", F.lit("old"))
    centres = text.family_centres(df.where("split = 'train'"), "ticker", most=40).persist()
    near = text.nearest_centres(df, centres, "ticker", rows=30)
    got = {r.ticker: r for r in text.assignments(near, contracts=6, events=4).collect()}
    assert len(got) == len(rows)
    statuses = Counter()
    for family in {r[3] for r in rows}:
        own = [r for r in rows if r[3] == family]
        train = [r for r in own if r[2] == "train"]
        fit = sorted(sorted(train, key=lambda r: seeded(r[0]))[:40], key=lambda r: r[0])
        fit = [r for r in fit if any(r[4])]
        c = None
        if len(fit) > 1:
            x = np.array([r[4] for r in fit])
            label = plain_linkage(x, 0.35)
            c = np.stack([x[label == k].mean(axis=0) for k in range(label.max() + 1)])
            c /= np.linalg.norm(c, axis=1, keepdims=True)
            peers = defaultdict(list)
            for r in train:
                s = c @ np.array(r[4])
                if s.max() >= 0.75:
                    peers[int(s.argmax())].append(r[1])
        for r in own:
            g = got[r[0]]
            statuses[g.status] += 1
            if not train:
                want = ("unseen_family", None)
            elif c is None:
                want = ("insufficient_training_support", None)
            else:
                s = c @ np.array(r[4])
                k = int(s.argmax())
                assert abs(g.similarity - s.max()) < 1e-9
                if s.max() < 0.75:
                    want = ("distant", None)
                elif len(peers[k]) >= 6 and len(set(peers[k])) >= 4:
                    want = ("assigned", f"{family}/{k:03d}")
                else:
                    want = ("insufficient_training_support", None)
            assert (g.status, g.cluster) == want
    assert set(statuses) == {"assigned", "distant", "insufficient_training_support", "unseen_family"}


def test_no_contract_is_lost(spark):
    rows = textflow.families(spark, SF).select("ticker", "family", "split", "text").collect()
    got = {r.ticker: r for r in textflow.text_assignments(spark, SF).collect()}
    assert set(got) == {r.ticker for r in rows} and len(rows) == 1500
    assert all((got[r.ticker].status == "unseen_family") == (not any(o.family == r.family and o.split == "train" for o in rows)) for r in rows[:200])
    _, a = plain_tfidf([r.text for r in rows], fit=[r.text for r in rows if r.split == "train"])
    s = np.linalg.svd(a[[k for k, r in enumerate(rows) if r.split == "train"]], compute_uv=False)
    assert np.allclose(textflow.fitted(spark, SF).singular[:40], s[:40], rtol=0.01)


def test_queries_of_the_flow_agree(spark):
    rows = textflow.text_assignments(spark, SF).collect()
    count = Counter((r.split, r.status) for r in rows)
    for r in textflow.assignment_coverage(spark, SF).collect():
        assert [r[c] for c in ("assigned", "distant", "insufficient_training_support", "unseen_family")] == [count[r.split, c] for c in ("assigned", "distant", "insufficient_training_support", "unseen_family")]
        assert r.contracts == sum(n for (s, _), n in count.items() if s == r.split) and r.assigned_share == r.assigned / r.contracts
    held = defaultdict(list)
    for r in rows:
        if r.cluster:
            held[r.cluster, r.split].append(r.event_id)
    assert {(r.cluster, r.split): (r.contracts, r.events) for r in textflow.cluster_support(spark, SF).collect()} == {k: (len(v), len(set(v))) for k, v in held.items()}
    centres = textflow.text_centres(spark, SF).collect()
    assert all(abs(np.linalg.norm(c.centre) - 1) < 1e-9 for c in centres) and sum(c.members for c in centres) <= sum(n for (s, _), n in count.items() if s == "train")
    vectors = [np.linalg.norm(r.vector) for r in textflow.text_vectors(spark, SF).collect()]
    assert len(vectors) == len(rows) and all(abs(v - 1) < 1e-9 for v in vectors)


@pytest.mark.parametrize("query", ["text_assignments", "cluster_support", "assignment_coverage"])
def test_no_table_of_vectors_is_written(spark, monkeypatch, query):
    written = []

    def watched(df, *args):
        out = staged(df, *args)
        written.append(out)
        return out

    monkeypatch.setattr(text, "staged", watched)
    monkeypatch.setattr(textflow, "staged", watched)
    getattr(textflow, query)(spark, SF).collect()
    wide = [out.columns for out in written if {"vector", "text"} & set(out.columns)]
    assert wide == [["ticker", "event_id", "split", "family", "text"]]
    titles = next(out for out in written if "text" in out.columns)
    assert not list(Path(titles.staged_at.removeprefix("file:")).glob("*.parquet"))  # gone once the assignment is written


def test_texts_meet_centres_as_vectors_do(spark):
    rows = [(k, f"f{k % 3}", t) for k, t in enumerate(TITLES * 3)] + [(900, None, "red apple"), (901, "alone", "blue ocean")]
    df = spark.createDataFrame(rows, "id long, family string, text string")
    encoder = text.fit_svd(text.fit_vocabulary(df), df)
    vectors = encoder.encode(df)
    centres = text.family_centres(vectors.where("family in ('f0', 'f1')"), most=20).persist()
    own = {r.id: np.array(r.vector) for r in vectors.collect()}
    of = {f: sorted((r.cluster, np.array(r.centre)) for r in centres.collect() if r.family == f) for f in ("f0", "f1")}
    for limit in (4, 50_000):
        by_text = {r.id: r for r in text.nearest_centres(df, centres, rows=limit, encoder=encoder).collect()}
        by_vector = {r.id: r for r in text.nearest_centres(vectors.drop("text"), centres, rows=limit).collect()}
        assert set(by_text) == set(by_vector) == set(own)
        for k, family, _ in rows:
            for r in (by_text[k], by_vector[k]):
                assert r.family == family and "vector" not in r and "text" not in r
                if family not in of:
                    assert r.cluster is None and r.similarity is None
                    continue
                near = [float(own[k] @ c) for _, c in of[family]]
                assert abs(r.similarity - max(near)) < 1e-9 and near[r.cluster] > max(near) - 1e-9
