"""Approximate nearest neighbours by an inverted multi-index.

Each half of a vector has a codebook of its own, and a vector's cell is the pair of its two codes. A query orders the
centroids of each half by inner product and takes centroid pairs from a heap by their sum, the best first, until the
cells that it has met hold the wanted share of the index; the entries of those cells are scored exactly.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calibra.llm.common import hashed_sample, map_arrow, materialise, table

K = 20
CENTROIDS = 8  # in each half's codebook
SAMPLE = 8192  # vectors that the codebooks are fitted on, at most
SHARE = 0.75  # of the index, that a query visits at least
BLOCK = 4096  # entries of a cell that meet a query block in one row, about
FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors that are neither null, empty nor zero, without null or non-finite components."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from the farthest-first points of a fixed start."""
    centres = [x[0]]
    away = ((x - x[0]) ** 2).sum(1)
    for _ in range(1, min(k, len(x))):
        centres.append(x[int(away.argmax())])
        away = np.minimum(away, ((x - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(rounds):
        code = nearest(x, c)
        for i in range(len(c)):
            if (code == i).any():
                c[i] = x[code == i].mean(0)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(1)[None, :] - 2 * x @ c.T).argmin(1)


def halves(n: int) -> int:
    return max(1, n // 2)


def fit_codebooks(entries: DataFrame, size: int, centroids: int = CENTROIDS, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Codebooks of both halves of vectors of one length, from the ``sample`` with the smallest hash of their id."""
    x = np.array([r["v"] for r in hashed_sample(entries, "vec_id", sample).collect()])
    h = halves(size)
    return kmeans(x[:, :h], centroids), kmeans(x[:, h:], centroids)


def traverse(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """Centroid pairs in the order of falling sum, by a heap over the two sorted lists, until ``wanted`` entries are met."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap, seen, out, met = [(-(first[a[0]] + second[b[0]]), 0, 0)], {(0, 0)}, [], 0
    while heap and met < wanted:
        _, i, j = heapq.heappop(heap)
        if n := sizes[a[i], b[j]]:
            out.append((int(a[i]), int(b[j])))
            met += n
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (-(first[a[p]] + second[b[q]]), p, q))
    return out


def multi_index_search(vectors: DataFrame, queries: DataFrame, k: int = K, share: float = SHARE, centroids: int = CENTROIDS, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every query, by largest inner product in double precision.

    vectors and queries have vec_id and embedding; a query's own vec_id is no candidate of it. Ties go to the smaller
    vec_id. Vectors that are null, empty, zero or hold null or non-finite components take no part. Vectors of every length
    that a query has are an index of their own: an inner product needs two of one length. Repeated ids are entries of
    their own. Equal vectors are one entry with its k + 1 smallest ids: no others of them can be among a query's k nearest.
    Entries of a cell are cut into blocks, so a large cell is many rows of bounded size, and each block keeps k a query.
    """
    spark = vectors.sparkSession
    entries, asked = usable(vectors), usable(queries)
    lengths = asked.select(F.size("v").alias("size")).distinct().join(entries.select(F.size("v").alias("size")).distinct(), "size").collect()
    found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for size in sorted(r["size"] for r in lengths):
        of = F.size("v") == size
        found = found.union(search_length(entries.where(of), asked.where(of), size, k, share, centroids, sample, block))
    return found


def search_length(entries: DataFrame, asked: DataFrame, size: int, k: int, share: float, centroids: int, sample: int, block: int) -> DataFrame:
    """multi_index_search of (vec_id, v) of one length."""
    spark = entries.sparkSession
    books = fit_codebooks(entries, size, centroids, sample)
    h, n_cells = books[0].shape[1], len(books[0]) * len(books[1])
    first_ids = entries.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    shared = spark.sparkContext.broadcast(books)

    def code(batches):
        one, two = shared.value
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(1).to_pylist(), dtype=np.float64)
                yield {"vec_id": batch.column(0), "v": [r.tobytes() for r in x], "cell": nearest(x[:, :h], one) * len(two) + nearest(x[:, h:], two)}

    coded = materialise(map_arrow(first_ids.select("vec_id", "v"), code, "vec_id long, v binary, cell int"))
    counted = coded.groupBy("cell").count().collect()  # of len(first book) x len(second book) cells at most
    sizes = np.zeros(n_cells, dtype=np.int64)
    for r in counted:
        sizes[r["cell"]] = r["count"]
    parts = np.maximum(1, -(-sizes // block))
    deal = F.array(*[F.lit(int(n)) for n in parts])
    blocks = coded.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.get(deal, F.col("cell"))).cast("int")).groupBy("cell", "part").agg(F.collect_list(F.struct("vec_id", "v")).alias("entries"))
    wanted = max(int(np.ceil(share * sizes.sum())), k + 1)  # one may be the query's own

    def visit(batches):
        one, two = shared.value
        grid = sizes.reshape(len(one), len(two))
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), dtype=np.float64)
            a, b = x[:, :h] @ one.T, x[:, h:] @ two.T
            cells: dict[int, list[int]] = {}
            for i in range(len(ids)):
                for p, q in traverse(a[i], b[i], grid, wanted):
                    cells.setdefault(p * len(two) + q, []).append(i)
            for cell, rows in cells.items():
                for at in range(0, len(rows), 256):
                    some = rows[at : at + 256]
                    yield {"cell": [cell], "ids": [[ids[i] for i in some]], "q": [x[some].tobytes()]}

    visits = map_arrow(asked, visit, "cell int, ids array<long>, q binary")
    visits = visits.withColumn("part", F.explode(F.sequence(F.lit(0), F.get(deal, F.col("cell")) - 1)))  # a cell's blocks, row by row
    met = visits.join(blocks, ["cell", "part"]).select("ids", "q", "entries")

    def score(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                own = np.array(batch.column(0)[r].as_py())
                q = np.frombuffer(batch.column(1)[r].as_buffer(), dtype=np.float64).reshape(-1, size)
                rows = batch.column(2)[r].values
                ids = rows.field("vec_id").to_numpy()
                v = np.frombuffer(b"".join(rows.field("v").to_pylist()), dtype=np.float64).reshape(-1, size)
                order = np.argsort(ids, kind="stable")
                ids, v = ids[order], v[order]
                s = q @ v.T
                # the product of a whole block may round unlike one vector's own: what is near the k-th is scored one by one
                slack = 4 * size * np.finfo(float).eps * np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max()
                out_q, out_v, out_s = [], [], []
                for i in range(len(own)):
                    others = np.flatnonzero((ids != own[i]) & ~np.isnan(s[i]))
                    if len(others) > k:
                        least = np.partition(s[i, others], -k)[-k]
                        others = others[s[i, others] >= least - (slack[i] if np.isfinite(least) and np.isfinite(slack[i]) else 0)]
                    exact = np.array([float(np.dot(q[i], v[t])) for t in others])
                    best = np.lexsort((ids[others], -exact))[:k]
                    out_q += [own[i]] * len(best)
                    out_v += ids[others[best]].tolist()
                    out_s += exact[best].tolist()
                yield {"query_id": out_q, "vec_id": out_v, "score": out_s}

    found = map_arrow(met, score, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return multi_index_search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
