"""Rule ledger, fill-in-middle and source divergence against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.llm import divergence as dv
from calibra.llm import fill_middle as fm
from calibra.llm import rule_ledger as rl
from calibra.llm.common import materialise

TEXTS = [
    None, "", " \t\n\x0b\x0c\r ", "a", "a b c", "a a a a", "a b a b a b", "x y z " * 40, "one\ntwo\none\n\n \none two\none", "# $5 & <b> 100% a|b *",
    "ünï 日本   x y 😀 z", "a\x1cb c\x85d", "w " * 49, "w " * 50, " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(30)) + " q " + " ".join(f"w{i}" for i in range(30)),
    " ".join(f"longword{i:08d}" for i in range(60)), " ".join(["ab"] * 2 + [f"k{i}" for i in range(25_000)] + ["ab"] * 2), "\n".join(["same line here"] * 30 + [f"line {i} x" for i in range(30)]), "<P>a", "b<S>", "<M>", "<<P", "<S", "P>x<",
]


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup, n = set(), 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            n += 1
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), n, dup, len(covered)


def plain_bits(n, chars, symbols, lines, dup, rep):
    broken = [n < 50, 100 * rep > 50 * n, 10 * symbols > n, chars < 3 * n or chars > 10 * n, 2 * dup > lines]
    return sum(1 << k for k, b in enumerate(broken) if b)


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(k, t, k) for k, t in enumerate(TEXTS)] + [(3, "a", 0), (3, "a", 0), (None, "a b", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words long").selectExpr("*", "'p' AS pieces", "1 AS n", "'x' AS failed_bits", "'psm' AS form")


def test_ledger_equals_plain_python(texts):
    got = rl.ledger(texts).collect()
    assert len(got) == texts.count()
    for r in got:
        want = plain_measures(TEXTS[r.doc_id] if r.doc_id is not None else "a b")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == want, TEXTS[r.doc_id or 0]
        assert r.failed_bits == plain_bits(*want)


def test_ledger_runs_no_python(texts):
    plan = rl.ledger(texts)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_policies_and_ablations(texts):
    kept = rl.ledger(texts)
    verdicts = rl.verdicts(kept).collect()
    masks = {f"kept_{p.name}_v{p.version}": rl.mask(p.rules) for p in rl.POLICIES}
    assert all(r[c] == (r.failed_bits & m == 0) for r in verdicts for c, m in masks.items())
    bits = [r.failed_bits for r in verdicts]
    found = rl.ablations(kept).collect()
    assert len(found) == sum(len(p.rules) for p in rl.POLICIES)
    by_name = {r.name: 1 << r.bit for r in rl.RULES}
    for r in found:
        m = rl.mask(next(p.rules for p in rl.POLICIES if (p.name, p.version) == (r.policy, r.version)))
        b = by_name[r.rule]
        assert (r.n_docs, r.n_broken, r.n_rejected, r.n_only) == (len(bits), sum(x & b != 0 for x in bits), sum(x & m != 0 for x in bits), sum(x & m == b for x in bits))
        assert r.ever == np.bitwise_or.reduce(bits) and r.always == np.bitwise_and.reduce(bits)
    parts = rl.ablations(kept.withColumn("odd", F.col("n_words") % 2), by=("odd",)).groupBy("policy", "version", "rule").agg(F.sum("n_only").alias("n")).collect()
    assert {(r.policy, r.version, r.rule): r.n for r in parts} == {(r.policy, r.version, r.rule): r.n_only for r in found}
    with pytest.raises(KeyError):
        rl.mask(("no_such_rule",))


def test_clean_documents_are_kept(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("quality = 1 AND toxic = 0").select("doc_id")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(labels, "doc_id", "left_semi")
    kept = materialise(rl.ledger(docs)).where(rl.passes(rl.Policy("base", 1, rl.BASE)))
    assert kept.where(~rl.passes(rl.CURRENT)).count() == 0


def plain_fim(doc_id, text, cut=list):
    text = text or ""
    pieces = cut(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(pieces)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(pieces[:lo]), "".join(pieces[lo:hi]), "".join(pieces[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    return (n, "spm", lo, hi - lo, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", lo, hi - lo, f"<P>{p}<S>{s}<M>{m}")


CUTS = {
    "code_point": list,
    "word": lambda t: re.findall(r"[ \t-\r]+|[^ \t-\r]+", t),
    "line": lambda t: re.findall(r"[^\n]*\n|[^\n]+", t),
    "sentence": lambda t: re.split(r"(?<=[.!?。！？][ \t-\r])(?=[^ \t-\r])", t) if t else [],
}


@pytest.mark.parametrize("grammar", fm.GRAMMARS)
def test_fill_in_middle_equals_plain_python(texts, grammar):
    got = fm.fill_in_middle(texts, grammar).withColumn("back", fm.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == texts.count()
    for r in got:
        assert (r.n, r.form, r.prefix_units, r.middle_units, r.output) == plain_fim(r.doc_id, r.text, CUTS[grammar])
        assert r.back == r.text


def test_every_form_restores(spark):
    rows = [(k, f"<{k}S<P <S M> 😀é\n" * (k % 7)) for k in range(400)]
    got = fm.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("back", fm.restored(F.col("output"), F.col("form"))).collect()
    assert {r.form for r in got} == {"plain", "psm", "spm"} and all(r.back == r.text for r in got)
    assert all((r.n, r.form, r.prefix_units, r.middle_units, r.output) == plain_fim(r.doc_id, r.text) for r in got)


def plain_audit(rows, least=10, top=10):
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        groups.add((lang, source))
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update({t: counts[g][t] for t in kept})

        def p(c, t, kept=kept):
            return 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept))

        mine = {t: p(counts[lang, source], t) for t in kept}
        pairs = []
        for g in groups:
            if g[0] == lang and g[1] != source:
                q = {t: p(counts[g], t) for t in kept}
                pairs.append((-sum((mine[t] - q[t]) ** 2 // (mine[t] + q[t]) for t in kept), g[1].encode(), g[1]))
        out += [(lang, source, "pair", i, -v, k) for k, (v, _, i) in enumerate(sorted(pairs), 1)]
        terms = []
        for t in kept:
            q = p(whole, t)
            if counts[lang, source][t] and mine[t] > q:
                terms.append((-((mine[t] - q) ** 2 // (mine[t] + q)), t.encode(), t))
        out += [(lang, source, "term", i, -v, k) for k, (v, _, i) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def audit_rows():
    rng = np.random.default_rng(7)
    words = ["the", "The", "ünï", "İx", "it's", "a1b", "日本", "Z", "_q", "ÀB", "end.", "x-y", "😀ok", *[f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)]]
    rows = []
    for lang, sources in (("en", 19), ("fr", 9), (None, 3), ("de", 1)):
        for s in range(sources):
            for _ in range(int(rng.integers(1, 9))):
                rows.append((lang, f"s{s}" if s else None, " ".join(rng.choice(words, size=int(rng.integers(0, 90))))))
    rows += [("en", "Ä", None), ("en", "z\U00010000", ""), ("en", "z￿", "12 34"), ("xx", "a", "never often"), ("xx", "b", "kept"), ("xx", None, "")]
    return rows + rows[:5] + [("en", "s3", "Hot " * 5000)] * 12


def test_audit_equals_plain_python(spark, audit_rows):
    df = spark.createDataFrame(audit_rows, "lang string, source string, text string").selectExpr("*", "1 AS n", "2 AS total", "'t' AS term", "0 AS place")
    want = plain_audit(audit_rows)
    for how in ({}, {"block": 2, "chunk_cells": 40, "band": 2}, {"block": 1, "chunk_cells": 7, "band": 1}):
        got = dv.divergence_audit(df, **how)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, got.collect())) == want
    few = dv.divergence_audit(df, least_docs=10**6).collect()
    assert len(few) == sum(r[2] == "pair" for r in want) and all(r.value == 0 and r.part == "pair" for r in few)
    assert dv.divergence_audit(df.where("false")).count() == 0


def test_scaled_beyond_64_bits(spark):
    cases = [(0, 0, 1), (5, 9, 3), (9_300_000_000, 9_300_000_000, 7), (4 * 10**15, 5 * 10**15, 10**9), (1, 5 * 10**15, 1)]
    want = [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in cases]
    df = spark.createDataFrame(cases, "c long, n long, v long")
    assert [r[0] for r in df.select(dv.scaled(F.col("c"), F.col("n"), F.col("v"))).collect()] == want
    assert [int(dv.scaled_array(np.array([c]), n, v)[0]) for c, n, v in cases] == want
    with pytest.raises(OverflowError):
        dv.scaled_array(np.array([1]), 1 << 53, 1)


def test_no_rows(no_docs):
    assert rl.ledger(no_docs).count() == 0 and fm.fill_in_middle(no_docs).count() == 0
