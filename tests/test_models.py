"""Ridge against dense numpy, predictions, histograms and comparisons by event."""

import numpy as np
import pytest

from calibra.operators import resample, ridge, text
from calibra.operators.stage import staged
from calibra.plans import models, textflow


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(11)
    rows = []
    for k in range(900):
        split = ("train", "train", "train", "validation", "test")[int(rng.integers(5))]
        family = f"f{int(rng.integers(6))}" if split == "train" else f"f{int(rng.integers(8))}"  # f6 and f7 are never seen in training
        cluster = f"{family}/{int(rng.integers(3))}" if rng.random() < 0.6 else ""
        price = int(rng.integers(1, 100)) / 100
        rows.append((k, k % 90, split, family, cluster, price, float(rng.random() < min(0.97, price + 0.1 * (family == "f1"))), float(rng.integers(1, 40))))
    return spark.createDataFrame(rows, "ticker long, event_id long, split string, family string, cluster string, price double, outcome double, n double")


def plain_fit(rows, categories, alpha):
    """Coefficients and intercept by the textbook: a design matrix, centred with the weights, and a dense solve."""
    train = [r for r in rows if r["split"] == "train"]
    p, y, w = (np.array([r[c] for r in train]) for c in ("price", "outcome", "n"))
    powers = np.stack([p, p**2, p**3], axis=1)
    mean = np.average(powers, axis=0, weights=w)
    spread = np.sqrt(np.average((powers - mean) ** 2, axis=0, weights=w))
    values = {c: sorted({r[c] for r in train}) for c in categories}

    def design(of):
        x = (np.stack([np.array([r["price"] for r in of]) ** k for k in (1, 2, 3)], axis=1) - mean) / spread
        return np.column_stack([x, *[np.array([r[c] == v for r in of], dtype=float) for c in categories for v in values[c]]])

    x, e = design(train), y - p
    w = w / w.mean()
    mx, me = np.average(x, axis=0, weights=w), np.average(e, weights=w)
    beta = np.linalg.solve((x - mx).T @ ((x - mx) * w[:, None]) + alpha * np.eye(x.shape[1]), (x - mx).T @ (w * (e - me)))
    return beta / np.r_[spread, np.ones(x.shape[1] - 3)], values, lambda of: np.clip(np.array([r["price"] for r in of]) + me + (design(of) - mx) @ beta, 0, 1)


@pytest.mark.parametrize("name,categories", models.SETS.items())
def test_ridge_equals_numpy(spark, cells, name, categories):
    rows = [r.asDict() for r in cells.collect()]
    fits = ridge.fit(cells, {name: categories})
    assert [m.alpha for m in fits] == list(ridge.ALPHAS)
    held = [r for r in rows if r["split"] == "validation"]
    scores = {}
    for m in fits:
        beta, values, predict = plain_fit(rows, categories, m.alpha)
        mine = [*m.powers, *[m.offsets[c][v] for c in categories for v in values[c]]]
        assert np.allclose(mine, beta, rtol=1e-6, atol=1e-9) and m.features == len(beta)
        got = {r.ticker: r.x for r in ridge.predictions(cells, {"x": m}).select("ticker", "x").collect()}
        assert np.allclose([got[r["ticker"]] for r in rows], predict(rows), atol=1e-9)
        scores[m.alpha] = np.average((predict(held) - [r["outcome"] for r in held]) ** 2, weights=[r["n"] for r in held])
    best, error = ridge.choose(cells, fits)[name]
    assert best.alpha == min(scores, key=scores.get) and abs(error - scores[best.alpha]) < 1e-12


def test_unknown_categories_add_nothing(cells):
    m = ridge.fit(cells, {"s": ("family",)}, (1.0,))[0]
    rows = ridge.predictions(cells.where("family = 'f7'"), {"x": m}).collect()
    assert "f7" not in m.offsets["family"] and rows
    for r in rows:
        want = r.price + m.intercept + sum(b * r.price**k for k, b in enumerate(m.powers, 1))
        assert abs(r.x - min(1, max(0, want))) < 1e-12


def test_the_first_of_equal_alphas_is_taken(cells):
    fits = ridge.fit(cells, {"s": ()}, (1.0, 1.0))
    assert ridge.choose(cells, fits)["s"][0] is fits[0]


def test_fits_that_cannot_be(cells):
    with pytest.raises(ValueError, match="training"):
        ridge.fit(cells.where("split = 'test'"), {"s": ()})
    with pytest.raises(ValueError, match="combinations"):
        ridge.fit(cells, {"s": ("family", "cluster")}, most=3)
    with pytest.raises(ValueError, match="validation"):
        ridge.choose(cells.where("split = 'train'"), ridge.fit(cells, {"s": ()}, (1.0,)))


def test_draws_are_poisson_and_stable():
    h = np.arange(4000, dtype=np.int64) * 7919 - 12345
    c = resample.poisson_counts(h, 200, 1)
    assert abs(c.mean() - 1) < 0.01 and abs(c.var() - 1) < 0.02 and abs((c == 0).mean() - np.exp(-1)) < 0.005
    assert abs(np.corrcoef(c[:, 0], c[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(c[0], c[1])[0, 1]) < 0.25
    assert (resample.poisson_counts(h[100:110], 200, 1) == c[100:110]).all() and (resample.poisson_counts(h[:50], 200, 2) != c[:50]).any()


def test_comparison_by_event(spark, cells):
    best = {k: m for k, (m, _) in ridge.choose(cells, ridge.fit(cells, models.SETS)).items()}
    rows = ridge.predictions(cells.where("split = 'test'"), best)
    got = {(r.candidate, r.baseline): r for r in models.compared(rows).collect()}
    assert set(got) == set(models.PAIRS)
    local = [r.asDict() for r in rows.collect()]
    w = sum(r["n"] for r in local)
    for (cand, base), r in got.items():
        gain = {}
        for x in local:
            g = gain.setdefault(x["event_id"], [0.0, 0.0])
            g[0] += x["n"] * ((x["outcome"] - x[base]) ** 2 - (x["outcome"] - x[cand]) ** 2)
            g[1] += x["n"]
        total = sum(g[0] for g in gain.values()) / w
        se = sum((g[0] - g[1] * total) ** 2 for g in gain.values()) ** 0.5 / w
        assert abs(r.improvement - total) < 1e-12 and r.events == len(gain)
        assert r.ci_low <= total <= r.ci_high and abs((r.ci_high - r.ci_low) / (3.92 * se) - 1) < 0.15
        assert r.sign == ("better" if r.ci_low > 0 else "worse" if r.ci_high < 0 else "unclear")


def test_histogram_equals_numpy(spark):
    sf = "/root/testdata/sf0.001"
    rows = models.heldout_predictions(spark, sf).where("split = 'validation'").collect()
    w = np.array([r.n for r in rows])
    x = {k: np.array([100 * (r[k] - r.price) for r in rows]) for k in models.SETS}
    edges = np.linspace(min(map(np.min, x.values())), max(map(np.max, x.values())), models.BINS + 1)
    got = models.correction_histogram(spark, sf).collect()
    assert len(got) == 3 * models.BINS
    for k, v in x.items():
        mine = sorted((r.bin, r.share, r.from_pp) for r in got if r.approach == k)
        want = np.histogram(v, edges, weights=w / w.sum())[0]
        assert np.allclose([a for _, _, a in mine], edges[:-1], atol=1e-9) and abs(sum(s for _, s, _ in mine) - 1) < 1e-9
        assert np.abs(np.cumsum([s for _, s, _ in mine]) - np.cumsum(want)).max() < 0.01


def test_ridge_scores_equal_numpy(spark):
    from calibra.plans.market import customers, splits

    sf = "/root/testdata/sf0.001"
    segment = {r.event_id: r.segment for r in customers(spark, sf).collect()}
    split = {r.ticker: r.split for r in splits(spark, sf).collect()}
    sums = {}
    for r in models.market_cells(spark, sf).collect():
        key = split[r.ticker], segment[r.event_id], r.price, r.outcome
        sums[key] = sums.get(key, 0) + r.contracts
    rows = [dict(zip(("split", "segment", "price", "outcome"), k, strict=True)) | {"n": float(n)} for k, n in sums.items()]
    loss = lambda of, q: np.average((q - [r["outcome"] for r in of]) ** 2, weights=[r["n"] for r in of])
    by = {s: [r for r in rows if r["split"] == s] for s in ("train", "validation", "test")}
    fits = {a: plain_fit(rows, ("segment",), a)[2] for a in (0.1, 1.0, 10.0, 100.0)}
    best = min(fits, key=lambda a: loss(by["validation"], fits[a](by["validation"])))
    for r in models.ridge_scores(spark, sf).collect():
        assert r.alpha == best and abs(r.model_brier - loss(by[r.split], fits[best](by[r.split]))) < 1e-9
        assert abs(r.market_brier - loss(by[r.split], np.array([x["price"] for x in by[r.split]]))) < 1e-9


def test_sizes_and_comparison_of_the_queries(spark):
    sf = "/root/testdata/sf0.001"
    held = models.heldout_predictions(spark, sf)
    sizes = {r.approach: r for r in models.model_sizes(spark, sf).collect()}
    assert set(sizes) == set(models.SETS) and sizes["pooled"].features == 3 < sizes["structural"].features < sizes["structural_text"].features
    scores = ridge.brier(held.where("split = 'validation'"), list(models.SETS)).first()
    assert all(abs(scores[k] - r.validation_brier) < 1e-9 for k, r in sizes.items())
    test = [r.asDict() for r in held.where("split = 'test'").collect()]
    for r in models.model_comparison(spark, sf).collect():
        gain = sum(x["n"] * ((x["outcome"] - x[r.baseline]) ** 2 - (x["outcome"] - x[r.candidate]) ** 2) for x in test) / sum(x["n"] for x in test)
        assert abs(r.improvement - gain) < 1e-9 and r.ci_low <= r.ci_high and r.events == len({x["event_id"] for x in test})


@pytest.mark.parametrize("query", ["correction_histogram", "model_comparison", "model_sizes", "heldout_predictions"])
def test_predictions_are_not_written_cell_by_cell(spark, monkeypatch, query):
    written = []
    monkeypatch.setattr(models, "staged", lambda df, *args: written.append(df.columns) or staged(df, *args))
    getattr(models, query)(spark, "/root/testdata/sf0.001").collect()
    assert [c for c in written if "ticker" in c] == [["ticker", "event_id", "price", "outcome", "n", "contracts", "split", "family", "cluster"]]
    assert not [c for c in written if "vector" in c or set(models.SETS) & set(c)]


@pytest.mark.parametrize("query", ["heldout_predictions", "model_comparison"])
def test_nothing_is_fitted_on_a_sample(spark, monkeypatch, query):
    def sampled(*args, **kwargs):
        raise AssertionError("a sample was taken")

    made = []
    for module, name in ((textflow, "stable_sample"), (textflow, "sample_each"), (text, "sample_each")):
        monkeypatch.setattr(module, name, sampled, raising=False)
    centres = text.family_centres
    monkeypatch.setattr(text, "family_centres", lambda *args, **kwargs: made.append(centres(*args, **kwargs).persist()) or made[-1])
    assert getattr(models, query)(spark, "/root/testdata/sf0.001").count() > 0
    train = textflow.families(spark, "/root/testdata/sf0.001").where("split = 'train'").groupBy("family").count().where("count > 1").agg({"count": "sum"}).first()[0]
    assert sum(r.members for r in made[0].collect()) == train  # every training contract has known terms
