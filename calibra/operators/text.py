"""Short texts to clusters: TF-IDF, truncated SVD, average linkage, and assignment to supported centres.

Fits take every row they are given. Rows with the same known terms have the same vector, so a fit works on bags: a row for each
distinct combination of known terms, with the number of rows that have it. Every row is then encoded, in one pass without a
shuffle, and assigned to a centre of its family.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from calibra.operators.sampling import sample_each, salt
from calibra.operators.stage import staged

WORD = r"\b\w\w+\b"
OVERSAMPLE = 10
#: Bags that a step of the singular vectors takes, and products of vectors that a step of linkage or assignment holds: memory, not a cut.
BAGS = 2_000
CELLS = 1 << 22


def terms_of(text: Column) -> Column:
    """Words of two characters or more in lower case, then the pairs of neighbours; a null text has none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("(?U)" + WORD), F.lit(0))
    return F.transform(F.array(words), lambda w: F.concat(w, F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))))[0]


def vocabulary(df: DataFrame, text: str = "text", terms: int = 20_000, min_docs: int = 2) -> DataFrame:
    """(term, tf, df, idf, i): the ``terms`` most frequent terms that ``min_docs`` rows have, ties by term, numbered in the order
    of terms; idf is ln((1 + rows) / (1 + df)) + 1."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    found = df.select(terms_of(F.col(text)).alias("terms"))
    each = found.select(F.explode(F.concat(F.transform("terms", lambda t: F.struct(t.alias("term"), one.alias("tf"), none.alias("df"))), F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), none.alias("tf"), one.alias("df"))))).alias("t"))
    totals = each.groupBy("t.term").agg(F.sum("t.tf").alias("tf"), F.sum("t.df").alias("df"))  # summed by term in each task, no row of a document is shuffled
    kept = totals.where(F.col("df") >= min_docs).orderBy(F.desc("tf"), "term").limit(terms)
    placed = kept.withColumn("i", F.row_number().over(Window.orderBy("term")) - 1)  # ``terms`` rows at most
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    return placed.crossJoin(rows).select("term", "tf", "df", (F.log((1.0 + F.col("rows")) / (1.0 + F.col("df"))) + 1.0).alias("idf"), "i")  # one row on the right


@dataclass
class Encoder:
    """A frozen vocabulary with its weights and, once fitted, a basis: 20,000 terms by 64 columns at the bounds, some 10 MB."""

    terms: list[str]
    idf: np.ndarray
    basis: np.ndarray | None = None
    singular: np.ndarray | None = None

    def places(self, lists: pa.Array) -> np.ndarray:
        """row * terms + term of each known term in lists of terms or of their numbers, in order."""
        code, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
        if not pa.types.is_integer(code.type):
            code = pc.index_in(code, value_set=pa.array(self.terms, pa.string()).cast(code.type)).fill_null(-1)
        code = code.to_numpy(zero_copy_only=False).astype(np.int64)
        return np.sort(row[code >= 0] * max(1, len(self.terms)) + code[code >= 0])

    def sparse(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, weight) of lists of terms or of their numbers, in order of rows; 1 + ln tf, times idf, rows of unit length."""
        width = max(1, len(self.terms))
        keys, tf = np.unique(self.places(lists), return_counts=True)
        row, term = keys // width, keys % width
        w = (1 + np.log(tf)) * self.idf[term]
        norm = np.sqrt(np.bincount(row, weights=w * w, minlength=len(lists)))
        return row, term, w / norm[row]

    def dense(self, lists: pa.Array, onto: np.ndarray) -> np.ndarray:
        """The rows of the sparse matrix times ``onto``, which has a row a term."""
        row, term, w = self.sparse(lists)
        out = np.zeros((len(lists), onto.shape[1]))
        if len(row):
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            out[row[first]] = np.add.reduceat(w[:, None] * onto[term], first)
        return out

    def unit(self, lists: pa.Array) -> np.ndarray:
        """The rows on the basis, of unit length, zero where no term is known."""
        x = self.dense(lists, self.basis)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(norm == 0, 1, norm)

    def bags(self, df: DataFrame, text: str = "text", key: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
        """(by, bag, n, first): the numbers of the known terms, in order and with repeats, of all rows that share them; how many
        rows, and the smallest ``key`` of these. Rows meet in each task before they are shuffled."""
        kept = [f for f in df.schema.fields if f.name in (*by, key)]
        schema = StructType([*kept, StructField("bag", ArrayType(IntegerType()))])
        arrow = to_arrow_schema(schema)
        mine, width = self, max(1, len(self.terms))

        def work(batches):
            for batch in batches:
                lists = batch.column("__terms")
                at = mine.places(lists)
                starts = np.r_[0, np.cumsum(np.bincount(at // width, minlength=len(lists)))]
                bag = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(at % width, pa.int32()))
                columns = [batch.column(f.name).cast(arrow.field(f.name).type) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, bag.cast(arrow.field("bag").type)], schema=arrow)

        each = df.select(*[f.name for f in kept], terms_of(F.col(text)).alias("__terms")).mapInArrow(work, schema)
        return each.groupBy(*by, "bag").agg(F.count(F.lit(1)).alias("n"), *([F.min(key).alias("first")] if key else []))

    def encode(self, df: DataFrame, text: str = "text", name: str = "vector") -> DataFrame:
        """df with a column of unit vectors on the basis, zero where no term is known. No shuffle, batch by batch."""
        kept = [f for f in df.schema.fields if f.name not in ("__terms", name)]
        schema = StructType([*kept, StructField(name, ArrayType(DoubleType()))])
        arrow = to_arrow_schema(schema)
        mine, k = self, self.basis.shape[1]

        def work(batches):
            for batch in batches:
                x = mine.unit(batch.column("__terms"))
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(x) + 1) * k, k), pa.int32()), pa.array(x.ravel()))
                columns = [batch.column(f.name).cast(arrow.field(f.name).type) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, vectors.cast(arrow.field(name).type)], schema=arrow)

        return df.select(*[f.name for f in kept], terms_of(F.col(text)).alias("__terms")).mapInArrow(work, schema)


def fit_vocabulary(sample: DataFrame, text: str = "text", terms: int = 20_000, min_docs: int = 2) -> Encoder:
    rows = vocabulary(sample, text, terms, min_docs).select("term", "idf", "i").toPandas().sort_values("i")  # ``terms`` rows at most
    return Encoder(rows["term"].tolist(), rows["idf"].to_numpy())


def fit_svd(encoder: Encoder, sample: DataFrame, text: str = "text", dims: int = 64, rounds: int = 6, seed: int = 42) -> Encoder:
    """The encoder with the leading right singular vectors of the sample's TF-IDF matrix (uncentred)."""
    return fit_bags(encoder, encoder.bags(sample, text), dims, rounds, seed)


def fit_bags(encoder: Encoder, bags: DataFrame, dims: int = 64, rounds: int = 6, seed: int = 42) -> Encoder:
    """The same from the sample's bags (bag, n), by randomised subspace iteration; a bag counts ``n`` times.

    In a round each task multiplies its rows by the subspace and adds their outer products up; Spark sums the parts by
    term. The driver holds a matrix of terms by dimensions, orthonormalises it and sends it out for the next round. A
    Rayleigh-Ritz step at the end turns the subspace to singular vectors. The dimensions are ``dims`` at most, and fewer than terms and rows.
    """
    n, size = bags.agg(F.sum("n")).first()[0] or 0, len(encoder.terms)
    k = min(dims, size - 1, n - 1)
    if k < 2:
        raise ValueError("too few texts or terms for two dimensions")
    width = min(size, k + OVERSAMPLE)
    lists = bags.select("bag", "n").repartition(bags.sparkSession.sparkContext.defaultParallelism).persist()
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
    names = [f"z{j}" for j in range(width)]
    ddl = "i long, " + ", ".join(f"{c} double" for c in names)

    def gram(basis: np.ndarray) -> np.ndarray:
        """A'A times the basis, A the sample's matrix."""

        def work(batches):
            total, seen = np.zeros(basis.shape), np.zeros(len(basis), dtype=bool)
            for batch in (b.slice(k, BAGS) for b in batches for k in range(0, b.num_rows, BAGS)):
                row, term, w = encoder.sparse(batch.column(0))
                if not len(row):
                    continue
                y = encoder.dense(batch.column(0), basis) * batch.column(1).to_numpy()[:, None]
                order = np.argsort(term, kind="stable")
                row, term, w = row[order], term[order], w[order]
                first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
                total[term[first]] += np.add.reduceat(w[:, None] * y[row], first)
                seen[term] = True
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *[pa.array(total[at, j]) for j in range(basis.shape[1])]], names=["i", *names])

        out = np.zeros(basis.shape)
        parts = lists.mapInArrow(work, ddl).groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).toPandas()  # a row a term
        out[parts["i"].to_numpy(dtype=int)] = parts[names].to_numpy()
        return out

    try:
        for _ in range(rounds):
            basis = np.linalg.qr(gram(basis))[0]
        values, turn = np.linalg.eigh(basis.T @ gram(basis))
    finally:
        lists.unpersist()
    order = np.argsort(values)[::-1][:k]
    return Encoder(encoder.terms, encoder.idf, basis @ turn[:, order], np.sqrt(np.maximum(values[order], 0)))


def average_linkage(x: np.ndarray, distance: float = 0.35, n: np.ndarray | None = None) -> np.ndarray:
    """Labels of agglomerative clustering of unit rows by mean cosine distance; clusters ``distance`` or more apart stay apart.

    ``n`` says how many rows each stands for. The mean distance of two clusters is 1 less the product of their mean vectors, so
    no matrix of distances is kept. Average linkage never gets nearer by a merge: all mutual nearest neighbours are merged at
    once, only who had one of them for nearest looks again, and a cluster apart from all others is done. Time is quadratic in
    the rows, memory in proportion to them. Labels are numbered by each cluster's first row.
    """
    mean, size = np.array(x, dtype=float), np.ones(len(x)) if n is None else np.array(n, dtype=float)
    label, alive = np.arange(len(x)), np.ones(len(x), dtype=bool)
    near, gap = np.zeros(len(x), dtype=np.int64), np.full(len(x), np.inf)
    live = due = np.arange(len(x))
    while len(live) > 1:
        own = mean[live]
        for rows in np.array_split(due, -(-len(due) * len(live) // CELLS) or 1):
            d = 1 - mean[rows] @ own.T
            d[np.arange(len(rows)), np.searchsorted(live, rows)] = np.inf
            best = d.argmin(axis=1)
            near[rows], gap[rows] = live[best], d[np.arange(len(rows)), best]
        alive[live] = gap[live] < distance
        live = live[alive[live]]
        if not len(live):
            break
        a = live[(near[near[live]] == live) & (live < near[live]) & alive[near[live]]]
        if not len(a) and alive[near[live]].all():  # rounding can hide that two are each other's nearest
            a = live[[gap[live].argmin()]]
        a, b = np.minimum(a, near[a]), np.maximum(a, near[a])
        mean[a] = (mean[a] * size[a, None] + mean[b] * size[b, None]) / (size[a] + size[b])[:, None]
        size[a] += size[b]
        label[b], alive[b] = a, False
        changed = ~alive
        changed[a] = True
        live = live[alive[live]]
        due = live[changed[live] | changed[near[live]]]
    while (label != label[label]).any():
        label = label[label]
    return np.unique(label, return_inverse=True)[1]


def family_centres(vectors: DataFrame, key: str = "id", most: int | None = None, distance: float = 0.35, seed: int = 42, encoder: Encoder | None = None) -> DataFrame:
    """vectors (key, family, vector) -> (family, cluster, centre, members): unit mean vectors of the clusters of each family.

    Clusters are made of all rows, those with a zero vector left out; a family with fewer than two such rows has none. Equal
    vectors are one row of the linkage that counts for all. With ``encoder``, ``vectors`` are bags by family with the smallest
    key of each, and are encoded in their family's task. A user may have ``most`` rows of a family, those with the smallest seeded hash.
    """
    if encoder:
        known = vectors.where(F.size("bag") > 0).select("family", "first", "n", "bag")
    else:
        held = sample_each(vectors.select(key, "family", "vector"), "family", key, most, seed) if most else vectors
        known = held.where(F.exists("vector", lambda v: v != 0)).groupBy("family", "vector").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n"))

    def cluster(table: pa.Table) -> pa.Table:
        table = table.sort_by("first")
        n = table["n"].to_numpy()
        lists = table["bag" if encoder else "vector"].combine_chunks()
        x = encoder.unit(lists) if encoder else lists.flatten().to_numpy().reshape(len(n), -1)
        solid = x.any(axis=1)  # known terms may have no part in the basis
        x, n = x[solid], n[solid]
        found = {"family": [], "cluster": [], "centre": [], "members": []}
        if n.sum() > 1:
            label = average_linkage(x, distance, n)
            order = np.argsort(label, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(label[order]) > 0])
            members = np.add.reduceat(n[order], first)
            mean = np.add.reduceat((x * n[:, None])[order], first) / members[:, None]
            norm = np.linalg.norm(mean, axis=1, keepdims=True)
            found = {"family": [table["family"][0].as_py()] * len(first), "cluster": range(len(first)), "centre": list(mean / np.where(norm == 0, 1, norm)), "members": members}
        return pa.table({f.name: pa.array(found[f.name], f.type) for f in arrow}, schema=arrow)

    schema = StructType.fromDDL("family string, cluster int, centre array<double>, members long")
    arrow = to_arrow_schema(schema)
    return known.groupBy("family").applyInArrow(cluster, schema)


def nearest_centres(vectors: DataFrame, centres: DataFrame, key: str = "id", rows: int = 50_000, encoder: Encoder | None = None, text: str = "text") -> DataFrame:
    """vectors, all of them, with cluster and similarity of the most similar centre of their family, ties to the smaller cluster;
    both null where the family has no centre. The vectors themselves stay behind.

    With ``encoder``, rows have ``text`` in the place of a vector, and are encoded in the task that has the centres: a vector
    takes several times the room of a title, so none is shuffled or written. A family's rows are dealt over tasks of about
    ``rows``, to each of which the family's centres come first; rows then pass batch by batch.
    """
    sizes = staged(vectors.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("__parts")))  # a row a family; written, its size is known
    kept = [f for f in vectors.schema.fields if f.name not in ("cluster", "similarity", "vector", *([text] if encoder else []))]
    own = [F.col(text).alias("__text")] if encoder else [F.col("vector").alias("__vector")]
    dealt = vectors.join(sizes, "family", "left").select(*[f.name for f in kept], salt(F.col(key), F.coalesce("__parts", F.lit(1))).alias("__part"), *own)
    spread = centres.join(sizes, "family").select("family", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__part"), F.col("cluster").alias("__cluster"), F.col("centre").alias("__vector"))
    met = dealt.unionByName(spread, allowMissingColumns=True).repartition("family", "__part").sortWithinPartitions("family", "__part", F.col("__cluster").asc_nulls_last())
    if encoder:
        met = met.withColumn("__text", terms_of(F.col("__text")))
    schema = StructType([*kept, *StructType.fromDDL("cluster int, similarity double").fields])
    arrow = to_arrow_schema(schema)

    def work(batches):
        last, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            family, part, number = batch.column("family"), batch.column("__part").to_numpy(), batch.column("__cluster")
            code = family.dictionary_encode().indices.fill_null(-1).to_numpy()
            spot = number.is_valid().to_numpy(zero_copy_only=False)
            number = number.fill_null(-1).to_numpy()
            given = batch.column("__vector")
            there = given.is_valid().to_numpy(zero_copy_only=False)
            given, place = given.flatten().to_numpy().reshape(int(there.sum()), -1) if there.any() else None, np.cumsum(there) - 1
            x = encoder.unit(batch.column("__text")) if encoder else given[place]
            cluster, score = np.full(batch.num_rows, -1, dtype=np.int32), np.zeros(batch.num_rows)
            cuts = (np.flatnonzero((code[1:] != code[:-1]) | (part[1:] != part[:-1]) | (spot[1:] != spot[:-1])) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if (now := (family[a].as_py(), int(part[a]))) != last:
                    last, held = now, []
                if spot[a]:
                    held.append((number[a:b], given[place[a:b]]))
                elif held:
                    names, centre = (np.concatenate(h) for h in zip(*held, strict=True))
                    held = [(names, centre)]
                    step = max(1, CELLS // len(centre))
                    for c in range(a, b, step):
                        near = x[c : min(b, c + step)] @ centre.T
                        best = near.argmax(axis=1)
                        cluster[c : c + len(near)], score[c : c + len(near)] = names[best], near[np.arange(len(near)), best]
            rest = np.flatnonzero(~spot)
            columns = [batch.column(f.name).take(pa.array(rest)).cast(arrow.field(f.name).type) for f in kept]
            none = cluster[rest] < 0
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cluster[rest], pa.int32(), mask=none), pa.array(score[rest], pa.float64(), mask=none)], schema=arrow)

    return met.mapInArrow(work, schema)


def assignments(nearest: DataFrame, event: str = "event_id", least: float = 0.75, contracts: int = 20, events: int = 10) -> DataFrame:
    """nearest (family, split, event, cluster, similarity, ...) -> the same with status, and cluster only where status is 'assigned'.

    A cluster has support if ``contracts`` training rows of ``events`` events are ``least`` similar to it. unseen_family: no
    training row has the family; insufficient_training_support: no centre, or a similar one without support; distant: no centre ``least`` similar.
    """
    close = F.col("similarity") >= least
    groups = nearest.where("split = 'train'").groupBy("family", "cluster").agg(F.count_if(close).alias("__n"), F.countDistinct(F.when(close, F.col(event))).alias("__e"))
    groups = staged(groups)  # a row a cluster; written, its size is known, and ``nearest`` need not be shuffled to meet it
    seen = groups.select("family").distinct().withColumn("__seen", F.lit(True))
    support = groups.where((F.col("__n") >= contracts) & (F.col("__e") >= events)).select("family", "cluster", F.lit(True).alias("__supported"))
    known = nearest.join(seen, "family", "left").join(support, ["family", "cluster"], "left")
    status = (
        F.when(F.col("__seen").isNull(), "unseen_family")
        .when(F.col("cluster").isNull(), "insufficient_training_support")
        .when(F.col("similarity") < least, "distant")
        .when(F.col("__supported").isNull(), "insufficient_training_support")
        .otherwise("assigned")
    )
    named = known.withColumn("status", status)
    label = F.when(F.col("status") == "assigned", F.format_string("%s/%03d", "family", "cluster"))
    return named.select(*[c for c in nearest.columns if c not in ("cluster", "similarity", "vector")], label.alias("cluster"), F.when(F.col("__seen"), F.col("similarity")).alias("similarity"), "status")
