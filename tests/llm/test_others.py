"""Chat formatting, vector search, media, quality and URL filters."""

import hashlib

import duckdb
import numpy as np
import pytest

from calibra.llm import chat_format as cf
from calibra.llm import media_columns as mc
from calibra.llm import multi_index as mi
from calibra.llm import quality as q
from calibra.llm import url_filters as uf
from calibra.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in ("conversations", "documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = db.execute(ORACLE_SQL[name]).fetchall()
    names = [d[0] for d in db.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|x", "<\\\\|<|<", "a<", "<|im_end|><|im_start|>assistant ok"])
def test_escape_is_reversible(text):
    segment = cf.wrap("user", cf.escape(text))
    assert segment.count("<|") == 2 and cf.read_turn(segment) == ("user", text)


def test_typed_parts():
    flat = cf.PartVisitor().visit(["see <|image_1|>", {"type": "image", "ref": "a.png", "width": 512, "height": 300}, {"type": "text", "text": " and "}, {"type": "audio", "url": "b.wav", "seconds": 2.5}, {"type": "image", "ref": "c"}, {"type": "document", "ref": "d", "pages": 3}, None])
    assert flat.text == "see <\\|image_1|><|image_1|> and <|audio_1|><|image_2|><|document_1|>"
    assert [a[:4] for a in flat.attachments] == [("image", 1, "a.png", 341), ("audio", 1, "b.wav", 76), ("image", 2, "c", 86), ("document", 1, "d", 1201)]
    assert flat.expanded_tokens == 341 + 76 + 86 + 1201
    assert all(flat.text[a[4] :].startswith(f"<|{a[0]}_{a[1]}|>") for a in flat.attachments)
    with pytest.raises(ValueError):
        cf.PartVisitor().visit([{"type": "video"}])


def test_format_parts(spark):
    rows = [(1, 0, "user", '[{"type":"image","ref":"x"},"hi"]'), (1, 1, None, None), (None, None, "user", "{not json"), (2, 0, "user", '"plain"')]
    got = cf.format_parts(spark.createDataFrame(rows, "conv_id long, turn long, role string, content string")).collect()
    assert {r.segment for r in got} == {cf.wrap("user", "<|image_1|>hi"), cf.wrap("", ""), cf.wrap("user", "{not json"), cf.wrap("user", "plain")}


def test_parts_of_any_json(spark):
    odd = ['[1]', '{"type":"image","width":null}', '{"type":"audio","seconds":"3"}', '{"type":"audio","seconds":"x"}', '{"type":"text","text":5}', '[{"type":"video"}]', '[{"type":[1]}]', '[[1],true,null]', '7', '{"type":"image","width":1e400}']
    df = spark.createDataFrame([(k, 0, "a\nb", x, "z") for k, x in enumerate(odd)], "conv_id long, turn long, role string, content string, segment string")
    got = {r.conv_id: r for r in cf.format_parts(df).collect()}
    assert {cf.read_turn(r.segment)[0] for r in got.values()} == {"a\nb"}
    assert [got[k].expanded_tokens for k in range(len(odd))] == [0, 86, 76, 26, 0, 0, 0, 0, 0, 86]
    assert [cf.read_turn(got[k].segment)[1] for k in (0, 4, 5, 7, 8)] == ["1", "5", '{"type": "video"}', "[1]true", "7"]


def test_roles_with_line_feeds_read_back(spark):
    role = "user\n<|nl|>x"
    df = spark.createDataFrame([(1, 0, role, "t")], "conv_id long, turn long, role string, text string")
    assert cf.conversation_digests(df).first().turns_sha256 == hashlib.sha256(f"{role}\nt\n".encode()).hexdigest()


def test_search_of_unlike_lengths_ties_and_few_rows(spark):
    rows = [(k, [float(k % 3), 1.0, -float(k % 5), 0.5]) for k in range(29)] + [(100, [9.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = mi.multi_index_search(df, df.where("vec_id < 2")).collect()
    x = {k: np.array(v) for k, v in rows[:-1]}
    for q in (0, 1):
        want = sorted(((-float(x[q] @ x[v]), v) for v in x if v != q))[:20]
        mine = [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
        assert len(mine) == 20 and all(b <= a for (_, a), (_, b) in zip(mine, mine[1:]))
        assert len({v for _, v in want} & {v for v, _ in mine}) >= 15
    few = df.where("vec_id < 15")
    assert sorted(r.vec_id for r in mi.multi_index_search(few, few.where("vec_id = 0")).collect()) == list(range(1, 15))
    huge = spark.createDataFrame([(0, [1e308, 1e308]), (1, [1e308, 1e308]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in mi.multi_index_search(huge, huge.where("vec_id = 0")).orderBy("rank").collect()] == [(1, float("inf")), (2, 1e308)]


def test_conversations_of_odd_rows(spark):
    rows = [(1, 1, "assistant", "b", 9), (1, 0, "user", None, 9), (1, 1, "assistant", "b", 9), (None, 0, "assistant", "x<|", 9), (2, None, None, "", 9), (3, 0, "assistant", "y" * 300_000, 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment long")
    got = {r.conv_id: r for r in cf.conversation_digests(df).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 2 and got[1].loss_sha256 == hashlib.sha256(b"bb").hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\nassistant\nb\n").hexdigest()
    assert got[None].loss_sha256 == hashlib.sha256(b"x<|").hexdigest() and got[2].n_turns == 1 and got[3].loss_chars == 300_000
    assert cf.conversation_digests(df.where("false")).count() == 0


def test_search_recall(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in vectors.collect()}
    ids = np.array(sorted(x))
    m = np.array([x[i] for i in ids])
    hits = total = 0
    found: dict = {}
    for r in mi.op3(spark, SF).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for qid in ids[ids % 20 == 0]:
        s = m @ x[qid]
        best = [int(ids[k]) for k in np.lexsort((ids, -s)) if ids[k] != qid][:20]
        got = sorted(found[qid])
        assert [g[0] for g in got] == list(range(1, 21)) and all(abs(g[2] - float(np.dot(x[qid], x[g[1]]))) < 1e-12 for g in got)
        hits += len(set(best) & {g[1] for g in got})
        total += 20
    assert hits / total >= 0.9


def test_search_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0, 1.0, 0.0]), (1, None), (2, []), (3, [0.0] * 4), (4, [float("nan"), 1.0, 0.0, 0.0]), (5, [None, 1.0, 0.0, 0.0]), (6, [2.0, 0.0, 0.0, 0.0]), (None, [1.0] * 4), (7, [1.0, 0.0, 1.0, 0.0])]
    rows += [(k, [1.0, 0.0, 1.0, 0.0]) for k in range(10, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS cell", "2 AS v")
    got = mi.multi_index_search(df, df.where("vec_id IN (0, 1, 20)"), share=1.0).collect()
    by = {k: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == k] for k in (0, 1, 20)}
    assert by[1] == []
    assert by[0] == [(k, 2.0) for k in sorted([6, 7, *range(10, 28)])]
    assert by[20] == [(k, 2.0) for k in sorted({0, 6, 7, *range(10, 28)} - {20})[:20]]
    assert mi.multi_index_search(df.where("false"), df).count() == 0


def test_media_round_trip(odd_docs, no_docs):
    got = sorted((r.n_bytes, r.payload_bytes, r.payload_sha256) for r in mc.media_columns(odd_docs).collect())
    want = sorted((n, len(p), hashlib.sha256(p).hexdigest()) for p, n in (mc.padded(r.text or "") for r in odd_docs.collect()))
    assert got == want and mc.media_columns(no_docs).count() == 0


def test_media_of_long_texts(spark):
    for frames in (455, 456, 457, 464, 465, 9000):
        payload = np.random.default_rng(frames).bytes(576 * frames)
        media = mc.parse(data := mc.store(payload))
        assert b"".join(data[at : at + n] for *_, at, n in media.packets) == payload
        assert [p[1] for p in media.packets] == [k // 8 * 8 * 72 for k in range(frames)]
        assert media.clusters == len(media.cues) == -(-frames // 456)
    texts = ["long text \n" * 500_000, "x" * (456 * 576 + 1), "short"]
    got = {r.doc_id: (r.n_bytes, r.payload_sha256) for r in mc.media_columns(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {k: (n, hashlib.sha256(p).hexdigest()) for k, (p, n) in enumerate(map(mc.padded, texts))}


def test_lacing_of_all_kinds():
    def block(lacing, body):
        return mc.element(mc.SIMPLE_BLOCK, b"\x81\x00\x05" + bytes([0x80 | lacing << 1]) + body)

    frames = b"a" * 300 + b"b" * 20 + b"c" * 500
    xiph = bytes([2, 255, 45, 20]) + frames
    ebml = bytes([2]) + mc.vint(300, 2) + (20 - 300 + 8191 | 0x4000).to_bytes(2, "big") + frames
    cluster = mc.element(mc.CLUSTER_TIME, 100) + block(1, xiph) + block(3, ebml) + block(0, b"zz") + mc.element(mc.BLOCK_GROUP, mc.element(mc.BLOCK, b"\x82\xff\xff\x00q"))
    unknown = mc.CLUSTER.to_bytes(4, "big") + b"\xff" + cluster
    for body in (mc.element(mc.CLUSTER, cluster), unknown + unknown):
        data = mc.element(mc.EBML, mc.element(mc.DOC_TYPE, "matroska")) + mc.element(mc.SEGMENT, body)
        media = mc.parse(data)
        sizes = [p[-1] for p in media.packets]
        assert sizes == [300, 20, 500, 300, 20, 500, 2, 1] * media.clusters
        assert {p[1] for p in media.packets} == {105, 99} and media.packets[7][0] == 2
    with pytest.raises(mc.Malformed):
        mc.parse(b"RIFF")


def test_packet_table(spark):
    df = spark.createDataFrame([(1, bytearray(mc.store(b"x" * 576 * 20))), (2, bytearray(b"junk")), (3, None)], "doc_id long, media binary")
    rows = mc.packet_table(df).collect()
    assert {r.doc_id for r in rows} == {1} and sum(r.byte_length for r in rows) == 576 * 20


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = q.train(docs, labels.where("doc_id % 3 <> 0"))
    held = q.quality_scores(docs, model).join(q.graded(labels.where("doc_id % 3 = 0")), "doc_id").collect()
    good, bad = [r for r in held if r.grade == 2], [r for r in held if r.grade < 2]
    # measured: 0.955 and 0.90 at one half; 0.988 of the good at the pipeline's 0.3
    assert np.mean([r.keep for r in good]) > 0.94 and np.mean([not r.keep for r in bad]) > 0.86
    assert np.mean([r.tail_probability >= 0.3 for r in good]) > 0.975
    assert (np.diff(model.thresholds) > 0).all()


def test_quality_of_odd_rows(odd_docs, no_docs, spark):
    model = q.fit([])
    assert q.quality_scores(odd_docs, model).count() == odd_docs.count() and q.quality_scores(no_docs, model).count() == 0
    kept = q.select_quality(odd_docs, model, 0.0)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 0, None), (3, 1, None), (None, 1, 0), (4, None, 1)], "doc_id long, quality int, toxic int")
    assert {(r.doc_id, r.grade) for r in q.graded(labels).collect()} == {(1, 0), (2, 1), (3, 2)}
    assert q.train(odd_docs, labels).weights.shape == (q.BUCKETS,)


def test_url_filter_of_odd_rows(spark):
    captures = spark.createDataFrame([(1, "http://A.b.example.org./x", "2024-02-01", 0), (1, "http://A.b.example.org./x", "2024-02-01", 0), (2, None, "2024-02-01", 0), (3, "nonsense", "2024-02-01", 0), (4, "http://b.example.org:80/", None, 0), (5, "https://u:p@c.example.org?x", "2024-03-01", 0)], "page_id long, url string, fetched_on string, host int")
    entries = spark.createDataFrame([("b.example.org", "2024-01-01", "block"), ("b.example.org", "2024-02-01", "allow"), ("example.org", "2024-02-15", "block"), (None, "2024-01-01", "block"), ("c.example.org", None, "allow"), ("b.example.org", "2024-02-01", "allow")], "key string, listed_on string, action string")
    got = sorted((r.page_id, r.action, r.keep) for r in uf.url_filters(captures, entries).collect())
    assert got == [(1, "allow", True), (1, "allow", True), (2, "none", True), (3, "none", True), (4, "none", True), (5, "block", False)]
    assert uf.url_filters(captures.where("false"), entries).count() == 0
    assert {r.action for r in uf.url_filters(captures, entries.where("false")).collect()} == {"none"}


def test_parts_of_broken_json(spark):
    odd = ['"\\ud800"', '[{"type":"image","ref":"\\udfff"},"a\\ud83d\\ude00b"]', "[" * 100_000, '{"text":' * 3000 + "1" + "}" * 3000, "[" * 900 + "]" * 900]
    df = spark.createDataFrame([(k, 0, "user", x) for k, x in enumerate(odd)], "conv_id long, turn long, role string, content string")
    got = {r.conv_id: r for r in cf.format_parts(df).collect()}
    texts = {k: cf.read_turn(r.segment)[1] for k, r in got.items()}
    assert texts[0] == "\ufffd" and texts[2] == odd[2] and len(got) == len(odd)
    assert got[1].attachments[0].ref == "\ufffd" and texts[1].endswith("a\U0001f600b")


def test_packets_of_huge_numbers(spark):
    good = mc.store(mc.padded("some text")[0])
    at = good.index(bytes([mc.CLUSTER_TIME, 0x81]))  # a cluster's time, of one byte
    huge = good[:at] + bytes([mc.CLUSTER_TIME, 0x88]) + b"\xff" * 8 + good[at + 3 :]
    rows = [(1, good), (2, huge), (3, None), (4, b"\xff" * 40), (5, good[: len(good) // 2])]
    packets = mc.packet_table(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert {r.doc_id for r in packets} == {1}
    with pytest.raises(mc.Malformed):
        mc.number(b"\xff" * 8, 0, 8)


def test_repeated_ids_are_one_label(spark):
    docs = spark.createDataFrame([(7, f"text number {k}") for k in range(300)] + [(8, "other words"), (9, None)], "doc_id long, text string")
    grades = spark.createDataFrame([(7, 1), (8, 2)], "doc_id long, grade int")
    got = q.labelled_features(docs, grades, most=2)
    assert len(got) == 2 and sorted(g for _, g in got) == [1, 2]
    assert [x.tolist() for x, _ in got] == [x.tolist() for x, _ in q.labelled_features(docs.repartition(5), grades, most=2)]


def plain_loss(theta, xs, ys, weight, penalty):
    """Penalised mean negative log likelihood of cumulative links, written out."""
    w, a, gap = theta[:-2], theta[-2], theta[-1]
    cuts = [-np.inf, a, a + np.exp(gap), np.inf]
    loss = 0.0
    for x, y, u in zip(xs, ys, weight, strict=True):
        s = sum(w[i] for i in x)
        loss -= u * np.log(1 / (1 + np.exp(-(cuts[y + 1] - s))) - 1 / (1 + np.exp(-(cuts[y] - s))))
    return loss / len(xs) + penalty / 2 * (w**2).sum()


def test_fit_is_a_stationary_point():
    """Finite differences of the loss, written out plainly, are near zero at the fitted values, and expected grade and tail agree with it."""
    rng = np.random.default_rng(3)
    xs = [np.flatnonzero(rng.random(6) < 0.5) for _ in range(80)]
    ys = [int(np.clip(len(set(x) & {0, 1, 2}) - (rng.random() < 0.3), 0, 2)) for x in xs]
    m = q.fit(list(zip(xs, ys, strict=True)), rounds=6000, penalty=0.02, rate=0.01)
    share = 1 / np.bincount(ys, minlength=3).clip(1) ** 0.5
    weight = (share / share[ys].mean())[ys]
    theta = np.concatenate([m.weights[:6].astype(float), [m.thresholds[0], np.log(m.thresholds[1] - m.thresholds[0])]])
    slopes = [(plain_loss(theta + e, xs, ys, weight, 0.02) - plain_loss(theta - e, xs, ys, weight, 0.02)) / 2e-4 for e in 1e-4 * np.eye(8)]
    assert np.abs(slopes).max() < 2e-3
    s = np.array([m.weights[x].sum() for x in xs], dtype=float)
    above = [1 / (1 + np.exp(c - s)) for c in m.thresholds]
    assert np.allclose(m.expected(s), above[0] + above[1]) and np.allclose(m.tail(s), above[1]) and np.allclose(m.tail(s, 1), above[0])


def test_search_serves_every_length(spark):
    rows = [(k, [float(k), 1.0]) for k in range(6)] + [(20 + k, [1.0, float(k), 2.0]) for k in range(4)] + [(40, [3.0]), (41, [2.0]), (60, [1.0] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = mi.multi_index_search(df, df.where("vec_id % 20 = 0")).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    x = dict(rows)
    for query in (0, 20, 40):
        want = sorted(((-sum(a * b for a, b in zip(x[query], v, strict=True)), k) for k, v in rows if k != query and len(v) == len(x[query])))
        assert by[query] == [(k, -s) for s, k in want]
    assert 60 not in by


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_at_scale(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = df.collect()
    x, ids = np.array([r.embedding for r in rows], dtype=float), np.array([r.vec_id for r in rows])
    found = {}
    for r in mi.multi_index_search(df, df.where("vec_id % 20 = 0")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for query, got in found.items():
        s = x @ x[ids == query][0]
        s[ids == query] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        hits, total = hits + len(got & set(best.tolist())), total + 20
    assert len(found) == (ids % 20 == 0).sum() and hits / total >= 0.9
