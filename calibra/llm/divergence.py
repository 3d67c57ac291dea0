"""Source divergence audit by two-dimensional group-block tiling.

How far the word use of each source of a language lies from that of every other source, and which words make the difference.
Words are counted batch by batch in Arrow, then by Spark. Counts of the kept words are packed into one vector for each source
and vocabulary chunk. Sources are dealt into blocks; a task has two blocks and a band of chunks, gets their vectors chunk
after chunk, and adds to its submatrix of pairs. All arithmetic is on integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calibra.llm.common import map_arrow, materialise, slices

#: What no term holds: ASCII but for letters.
GAPS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UNIT = 1_000_000_000
LEAST_DOCS = 10
TOP = 10
BLOCK = 8  # sources in a block
CELLS = 1 << 14  # counts in a vocabulary chunk, about
BAND = 64  # chunks that a task goes through


def count_batch(lang: pa.Array, source: pa.Array, text: pa.Array) -> dict:
    """(lang, source, term, n, docs) of a batch of rows: occurrences, and rows with the term, by language and source.

    Terms are told by numbers from here on: each row's terms are sorted once, then those of the rows of a group.
    """
    if pa.types.is_string(text.type):
        text = text.cast(pa.large_string())
    cut = pc.split_pattern_regex(pc.ascii_lower(text), GAPS)
    words, row = pc.list_flatten(cut), pc.list_parent_indices(cut).to_numpy()
    full = pc.not_equal(words, "")
    coded = words.filter(full).dictionary_encode()
    terms, code, row = coded.dictionary, coded.indices.to_numpy().astype(np.int64), row[full.to_numpy(zero_copy_only=False)].astype(np.int64)
    width = max(1, len(terms))
    keys, n = np.unique(row * width + code, return_counts=True)
    names = pa.StructArray.from_arrays([lang, source], ["lang", "source"])
    told = {}
    group = np.array([told.setdefault((x["lang"], x["source"]), len(told)) for x in names.to_pylist()], dtype=np.int64)
    order, place = np.unique(group[keys // width] * width + keys % width, return_inverse=True)
    counts = np.zeros(len(order), dtype=np.int64)
    np.add.at(counts, place, n)
    pairs = list(told)
    of = (order // width).tolist()
    return {
        "lang": pa.array([pairs[g][0] for g in of], pa.string()),
        "source": pa.array([pairs[g][1] for g in of], pa.string()),
        "term": terms.take(pa.array(order % width)).cast(pa.string()),
        "n": counts,
        "docs": np.bincount(place, minlength=len(order)),
    }


def named(docs: DataFrame) -> DataFrame:
    """lang, source and text as text, with nulls empty."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term, and rows that hold it. Only A-Z are lower-cased."""

    def work(batches):
        for batch in slices(batches, most_bytes=8 << 20):
            yield count_batch(*(batch.column(c) for c in ("lang", "source", "text")))

    counted = map_arrow(named(docs), work, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def scaled(count: Column, total: Column, size: Column) -> Column:
    """p = 1 + floor(10^9 (count + 2) / (total + 2 size)), exactly: the product has 31 digits."""
    return F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)"), (total + 2 * size).cast("decimal(20,0)")) + 1


def scaled_array(count: np.ndarray, total: int, size: int) -> np.ndarray:
    """The same for numbers in 64 bits: a long division by three digits of base 1000, exact for totals under 9 * 10^15."""
    whole = total + 2 * size
    if whole >= 1 << 53:
        raise OverflowError("too many words in a source for 64-bit arithmetic")
    digit, rest = np.divmod(count + 2, whole)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, whole)
        digit = digit * 1000 + more
    return digit + 1


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); p and q are 10^9 + 1 at most, so the square fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def kept_cells(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, first) of the terms that at least ``least_docs`` rows of the language hold; lang_n is the
    term's count in the language, first marks one of the term's rows."""
    term = Window.partitionBy("lang", "term")
    known = counts.select("lang", "source", "term", "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("lang_n"), (F.min("source").over(term) == F.col("source")).alias("first"))
    return known.where(F.col("docs") >= least_docs).drop("docs")


def audit_groups(docs: DataFrame, cells: DataFrame, block: int = BLOCK, chunk_cells: int = CELLS) -> DataFrame:
    """A row for every (lang, source) that occurs: total, lang_total and size (N of both, and V), place, blocks and chunks."""
    langs = cells.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("size"), F.ceil(F.count(F.lit(1)) / chunk_cells).cast("int").alias("chunks"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    found = named(docs).select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    own = Window.partitionBy("lang")
    placed = found.withColumns({"place": F.row_number().over(own.orderBy("source")) - 1, "blocks": F.ceil(F.count(F.lit(1)).over(own) / block).cast("int")})
    return placed.fillna(0, ["total", "lang_total", "size"]).fillna(1, ["chunks"])


def packed_vectors(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """A row for every source and chunk of its language: n_terms of the chunk, and the places and counts of the source's terms there.

    Terms are dealt into chunks by hash; a term's place is its rank in the chunk. Sources without a term of a chunk have an
    empty vector there, and languages without kept terms one chunk of none.
    """
    dealt = cells.join(groups.select("lang", "source", "chunks"), ["lang", "source"]).withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
    placed = dealt.withColumn("at", F.dense_rank().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    packed = materialise(placed.groupBy("lang", "chunk", "source").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n")))
    sizes = packed.groupBy("lang", "chunk").agg((F.max(F.array_max("at")) + 1).alias("n_terms"))
    spine = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return spine.join(sizes, ["lang", "chunk"], "left").join(packed, ["lang", "chunk", "source"], "left").fillna(0, ["n_terms"])


class Tile:
    """The pairs of two blocks: vectors of one chunk at a time go in, the submatrix grows."""

    def __init__(self, lang: str, left: int, right: int):
        self.lang, self.left, self.right = lang, left, right
        self.sources: dict[int, str] = {}
        self.sums: dict[tuple[int, int], int] = {}

    def add(self, rows: list[dict], block: int) -> None:
        """``rows``: the vectors of every source of both blocks for one chunk."""
        side: tuple[list, list] = ([], [])
        for x in rows:
            p = np.full(x["n_terms"], 0, dtype=np.int64)
            if x["n_terms"]:
                p[:] = scaled_array(np.zeros(1, dtype=np.int64), x["total"], x["size"])
            if x["at"]:
                p[np.array(x["at"])] = scaled_array(np.array(x["n"], dtype=np.int64), x["total"], x["size"])
            self.sources[x["place"]] = x["source"]
            for own, which in zip(side, (self.left, self.right), strict=True):
                if x["place"] // block == which:
                    own.append((x["place"], p))
        if not side[1]:
            return
        places, q = [i for i, _ in side[1]], np.stack([p for _, p in side[1]])
        for i, p in side[0]:
            value = ((p - q) ** 2 // np.maximum(p + q, 1)).sum(axis=1)
            for j, v in zip(places, value.tolist(), strict=True):
                if i != j and (self.left != self.right or i < j):
                    self.sums[i, j] = self.sums.get((i, j), 0) + v

    def rows(self) -> dict:
        """Every pair in both orders."""
        pairs = [(self.sources[a], self.sources[b], v) for (i, j), v in self.sums.items() for a, b in ((i, j), (j, i))]
        return {"lang": [self.lang] * len(pairs), "source": [x[0] for x in pairs], "item": [x[1] for x in pairs], "value": [x[2] for x in pairs]}


def pair_sums(vectors: DataFrame, block: int = BLOCK, band: int = BAND) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language.

    A vector goes to the tasks of every block that its own meets: as many copies as the language has blocks. A task's rows come
    sorted by tile and chunk, so it holds one chunk of two blocks and one submatrix. The bands of a tile are added up by Spark.
    """
    own = F.floor(F.col("place") / block).cast("int")
    tiled = vectors.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiled = tiled.select("lang", F.least(own, "other").alias("lo"), F.greatest(own, "other").alias("hi"), F.floor(F.col("chunk") / band).alias("band"), "chunk", "place", "source", "total", "size", "n_terms", "at", "n")
    ordered = tiled.repartition("lang", "lo", "hi", "band").sortWithinPartitions("lang", "lo", "hi", "band", "chunk")

    def work(batches):
        tile, key, chunk, held = None, None, None, []
        for batch in batches:
            for k in range(batch.num_rows):
                x = {c: batch.column(c)[k].as_py() for c in ("lang", "lo", "hi", "band", "chunk", "place", "source", "total", "size", "n_terms", "at", "n")}
                mine = (x["lang"], x["lo"], x["hi"], x["band"])
                if held and (mine != key or x["chunk"] != chunk):
                    tile.add(held, block)
                    held = []
                if mine != key:
                    if tile and tile.sums:
                        yield tile.rows()
                    tile, key = Tile(*mine[:3]), mine
                chunk = x["chunk"]
                held.append(x)
        if held:
            tile.add(held, block)
        if tile and tile.sums:
            yield tile.rows()

    parts = map_arrow(ordered, work, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def ranked(rows: DataFrame, part: str) -> DataFrame:
    own = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(own).alias("rank"))


def divergence_audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK, chunk_cells: int = CELLS, band: int = BAND) -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair' has the divergence from every other source of the language, part
    'term' the ``top`` terms that a source uses more than its language does, by their share in the divergence.

    Terms are runs of letters and of characters beyond ASCII; a language keeps those that ``least_docs`` of its rows hold.
    Null text, lang and source count as empty, and an empty name is a name; repeated rows count as often as they occur;
    sources without terms have their pairs; a language without kept terms has value 0 everywhere; a language with one source
    has no pair; an empty table gives no row; ties go by the item's bytes; extra columns stay behind. A row is counted in the
    task that has it, whole, in memory in proportion to its text. A hot source is as many rows of counts as it has terms.
    """
    cells = materialise(kept_cells(term_counts(docs), least_docs))
    groups = materialise(audit_groups(docs, cells, block, chunk_cells))
    pairs = pair_sums(packed_vectors(cells, groups), block, band)
    known = cells.join(groups.select("lang", "source", "total", "lang_total", "size"), ["lang", "source"])
    shares = known.select("lang", "source", "term", scaled(F.col("n"), F.col("total"), F.col("size")).alias("p"), scaled(F.col("lang_n"), F.col("lang_total"), F.col("size")).alias("q"))
    terms = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    return ranked(pairs, "pair").union(ranked(terms, "term").where(F.col("rank") <= top))


def op13(spark, sf_dir: str) -> DataFrame:
    from calibra.llm.common import table

    return divergence_audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT rid, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
perdoc AS (SELECT rid, lang, source, term, count(*) AS n FROM t GROUP BY rid, lang, source, term),
voc AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS lang_n FROM perdoc GROUP BY lang, term HAVING count(*) >= 10),
cells AS (SELECT p.lang, p.source, p.term, CAST(sum(p.n) AS HUGEINT) AS n FROM perdoc p JOIN voc v ON v.lang = p.lang AND v.term = p.term GROUP BY p.lang, p.source, p.term),
lt AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM voc GROUP BY lang),
gt AS (SELECT lang, source, sum(n) AS total FROM cells GROUP BY lang, source),
grp AS (SELECT DISTINCT lang, source FROM d),
g AS (SELECT grp.lang, grp.source, coalesce(gt.total, 0) AS total FROM grp LEFT JOIN gt ON gt.lang = grp.lang AND gt.source = grp.source),
dense AS (
  SELECT g.lang, g.source, voc.term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2)) // (g.total + 2 * lt.v) AS BIGINT) AS p
  FROM g JOIN voc ON voc.lang = g.lang JOIN lt ON lt.lang = g.lang LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = voc.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM dense a JOIN dense b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
shares AS (
  SELECT c.lang, c.source, c.term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (c.n + 2)) // (gt.total + 2 * lt.v) AS BIGINT) AS p,
    CAST(1 + (CAST(1000000000 AS HUGEINT) * (voc.lang_n + 2)) // (lt.lang_total + 2 * lt.v) AS BIGINT) AS q
  FROM cells c JOIN gt ON gt.lang = c.lang AND gt.source = c.source JOIN lt ON lt.lang = c.lang JOIN voc ON voc.lang = c.lang AND voc.term = c.term),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM shares WHERE p > q),
r AS (
  SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""
