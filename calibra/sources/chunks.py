"""A chunked table that grows by insert-if-absent.

Chunks are Parquet files of a fixed number of rows, named by the rows that they hold: name_0_10000, name_10000_20000, and
so on; the last may be shorter, and is topped up by the next append. A log of commits, one JSON file each, says which files
are the table, and keeps of each chunk its least and greatest key and, in a side file, a Bloom filter of its keys. So an append
reads the keys of those chunks only that may hold a key of its own, and what a killed task leaves behind is in no commit.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.sources.dataset import Folder

CHUNK_ROWS = 10_000
#: Bits a key, and probes, of a chunk's filter: about one key in 10,000 passes by chance.
BITS, PROBES = 20, 14
#: Keys of an append, at most, that chunks are asked for by filter; of more, only their range is.
ASKED = 20_000
STEP = np.uint64(0x9E3779B97F4A7C15)


def probes(hashes: np.ndarray, size: int) -> np.ndarray:
    """(keys, PROBES) bit places of 64-bit hashes in a filter of ``size`` bits, by double hashing."""
    h = hashes.astype(np.int64).view(np.uint64)
    other = (h * STEP >> np.uint64(17)) | np.uint64(1)
    return ((h[:, None] + np.arange(PROBES, dtype=np.uint64) * other[:, None]) % np.uint64(size)).astype(np.int64)


def filter_of(hashes: np.ndarray) -> bytes:
    size = max(64, BITS * len(hashes))
    bits = np.zeros(size, dtype=bool)
    bits[probes(hashes, size).ravel()] = True
    return np.packbits(bits).tobytes()


def may_hold(stored: bytes, hashes: np.ndarray, rows: int) -> bool:
    size = max(64, BITS * rows)
    bits = np.unpackbits(np.frombuffer(stored, dtype=np.uint8), count=size).astype(bool)
    return bool(bits[probes(hashes, size)].all(axis=1).any())


@dataclass(frozen=True)
class Chunk:
    file: str
    start: int
    end: int
    low: str
    high: str


class ChunkStore:
    """The table ``name`` in a folder, keyed by the text of one column. Appends of two writers at once are told by the log's number: one fails."""

    def __init__(self, spark: SparkSession, folder: str, name: str, key: str, rows: int = CHUNK_ROWS):
        self.spark, self.root, self.name, self.key, self.rows = spark, folder.rstrip("/"), name, key, rows
        self.folder = Folder(spark, self.root)
        self.jvm = spark.sparkContext._jvm

    def path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def commits(self) -> list[str]:
        log = self.path("_log")
        return sorted(x.getPath().getName() for x in self.folder.fs.listStatus(log)) if self.folder.fs.exists(log) else []

    def chunks(self) -> list[Chunk]:
        """The chunks of the last commit, in order. A commit says what it adds and what it takes the place of."""
        held: dict[str, Chunk] = {}
        names = self.commits()
        if names:
            files = [str(self.path("_log", n)) for n in names]
            for row in sorted(self.spark.read.text(files, wholetext=True).select("value").collect(), key=lambda r: json.loads(r.value)["number"]):
                commit = json.loads(row.value)
                for f in commit["removed"]:
                    held.pop(f, None)
                held.update({c["file"]: Chunk(**c) for c in commit["added"]})
        return sorted(held.values(), key=lambda c: c.start)

    def read(self) -> DataFrame:
        found = self.chunks()
        if not found:
            raise FileNotFoundError(self.root)
        return self.spark.read.parquet(*[f"{self.root}/{c.file}" for c in found])

    def candidates(self, chunks: list[Chunk], keys: DataFrame) -> list[Chunk]:
        """Chunks that may hold one of ``keys`` (key, h): by range, then, for few keys, by filter."""
        span = keys.agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("n")).first()
        near = [c for c in chunks if span.n and c.low <= span.high and span.low <= c.high]
        if not near or span.n > ASKED:
            return near
        asked = keys.orderBy("key").toPandas()  # ASKED at most
        order, hashes = asked["key"].tolist(), asked["h"].to_numpy()
        shared = self.spark.sparkContext.broadcast((order, hashes))
        sizes = {c.file: c.end - c.start for c in near}

        def ask(batches):
            from bisect import bisect_left, bisect_right

            order, hashes = shared.value
            for batch in batches:
                hit = []
                for file, low, high, bloom in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    own = hashes[bisect_left(order, low) : bisect_right(order, high)]
                    if file in sizes and len(own) and may_hold(bloom, own, sizes[file]):
                        hit.append(file)
                yield pa.RecordBatch.from_arrays([pa.array(hit, pa.string())], names=["file"])

        side = self.spark.read.parquet(*sorted({f"{self.root}/_keys/{c.file}" for c in near})).select("file", "low", "high", "bloom")
        hit = {r.file for r in side.mapInArrow(ask, "file string").collect()}
        return [c for c in near if c.file in hit]

    def append(self, df: DataFrame) -> int:
        """Adds the rows whose key isn't there yet, one for each key, the key's text in order; gives how many. Rows without a key are an error.

        Everything is written beside the table first; one commit, written last, makes it part of the table or not.
        """
        number, chunks = len(self.commits()), self.chunks()
        stage = f"_staging/{uuid.uuid4().hex}"
        try:
            text = F.col(self.key).cast("string")
            if df.where(text.isNull()).limit(1).count():
                raise ValueError(f"rows without {self.key}")
            fresh = df.withColumn("__key", text).dropDuplicates(["__key"])
            if chunks:
                near = self.candidates(chunks, fresh.select(F.col("__key").alias("key"), F.xxhash64("__key").alias("h")))
                if near:
                    stored = self.spark.read.parquet(*[f"{self.root}/{c.file}" for c in near]).select(text.alias("__key"))
                    fresh = fresh.join(stored, "__key", "left_anti")
            added, removed, n = self.write(fresh, chunks, stage)
            if n:
                self.commit(number, added, removed)
            return n
        finally:
            self.folder.fs.delete(self.path(stage), True)

    def write(self, fresh: DataFrame, chunks: list[Chunk], stage: str) -> tuple[list[Chunk], list[str], int]:
        """Writes ``fresh``, behind the rows of a last chunk that isn't full, as chunks: files of their own and their filters."""
        tail = chunks[-1] if chunks and chunks[-1].end - chunks[-1].start < self.rows else None
        start = tail.start if tail else chunks[-1].end if chunks else 0
        # rows in order of key are numbered by part, then by the counts of the parts before
        numbered = fresh.repartitionByRange("__key").sortWithinPartitions("__key").withColumn("__id", F.monotonically_increasing_id())
        numbered.write.parquet(f"{self.root}/{stage}/rows")
        rows = self.spark.read.parquet(f"{self.root}/{stage}/rows").withColumn("__part", F.shiftright("__id", 33))
        counts = sorted((r["__part"], r["count"]) for r in rows.groupBy("__part").count().collect())  # a row a task
        n = sum(c for _, c in counts)
        if not n:
            return [], [], 0
        before, offsets = (tail.end - start if tail else 0), []
        for part, c in counts:
            offsets.append((part, before))
            before += c
        places = self.spark.createDataFrame(offsets, "__part long, __before long")
        placed = rows.join(F.broadcast(places), "__part").withColumn("__at", F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__before", "__id")
        if tail:
            old = self.spark.read.parquet(f"{self.root}/{tail.file}").withColumn("__key", F.col(self.key).cast("string"))
            order = F.row_number().over(_in_order()) - 1  # a chunk's rows, fewer than ``rows``
            placed = placed.unionByName(old.withColumn("__at", order.cast("long")), allowMissingColumns=True)
        chunked = placed.withColumn("__chunk", F.floor(F.col("__at") / self.rows)).repartition("__chunk").sortWithinPartitions("__chunk", "__at")
        chunked.select("*", F.col("__chunk").alias("__c")).drop("__chunk", "__at", "__key").write.partitionBy("__c").parquet(f"{self.root}/{stage}/chunks")
        facts = self.spark.read.parquet(f"{self.root}/{stage}/chunks").withColumn("__key", F.col(self.key).cast("string"))
        summary = facts.groupBy("__c").agg(F.count(F.lit(1)).alias("n"), F.min("__key").alias("low"), F.max("__key").alias("high")).orderBy("__c").collect()  # a row a chunk
        added, names = [], {}
        for r in summary:
            a = start + r["__c"] * self.rows
            names[r["__c"]] = f"{self.name}_{a}_{a + r.n}.parquet"
            added.append(Chunk(names[r["__c"]], a, a + r.n, r.low, r.high))
        self.publish(stage, names, added, facts)
        return added, [tail.file] if tail else [], n

    def publish(self, stage: str, names: dict, added: list[Chunk], facts: DataFrame) -> None:
        """Moves each chunk's one file, and a row with its filter, to its name. What a commit that failed left there gives way."""
        fs = self.folder.fs
        low = {c.file: (c.low, c.high) for c in added}

        def blooms(pdf):
            return type(pdf)({"__c": [pdf["__c"].iloc[0]], "bloom": [filter_of(pdf["h"].to_numpy())]})

        sides = facts.select("__c", F.xxhash64("__key").alias("h")).groupBy("__c").applyInPandas(blooms, "__c long, bloom binary")  # ``rows`` keys a group
        table = self.spark.createDataFrame([(int(c), f, *low[f]) for c, f in names.items()], "__c long, file string, low string, high string")
        sides.join(table, "__c").drop("__c").withColumn("__f", F.col("file")).repartition("__f").write.partitionBy("__f").parquet(f"{self.root}/{stage}/keys")
        fs.mkdirs(self.path("_keys"))
        for c, name in names.items():
            for source, to in ((f"{stage}/chunks/__c={c}", name), (f"{stage}/keys/__f={name}", f"_keys/{name}")):
                files = [x.getPath() for x in fs.listStatus(self.path(source)) if x.getPath().getName().startswith("part-")]
                if len(files) != 1:
                    raise OSError(f"{len(files)} files of {name}")
                if fs.exists(self.path(to)):
                    fs.delete(self.path(to), False)
                if not fs.rename(files[0], self.path(to)):
                    raise OSError(f"{to} can't be put in place")

    def commit(self, number: int, added: list[Chunk], removed: list[str]) -> None:
        """The next commit; that its file is new is what tells two writers apart."""
        self.folder.fs.mkdirs(self.path("_log"))
        out = self.folder.fs.create(self.path("_log", f"{number:012d}.json"), False)
        out.write(bytearray(json.dumps({"number": number, "added": [asdict(c) for c in added], "removed": removed}).encode()))
        out.close()

    def vacuum(self) -> int:
        """Deletes files that no commit holds: replaced tails, and what failed appends left. Not while another appends."""
        held, gone = {c.file for c in self.chunks()}, 0
        for folder in ("", "_keys"):
            where = self.path(folder) if folder else self.folder.path
            if self.folder.fs.exists(where):
                for x in self.folder.fs.listStatus(where):
                    name = x.getPath().getName()
                    if name.startswith(f"{self.name}_") and name not in held:
                        gone += bool(self.folder.fs.delete(x.getPath(), False))
        return gone


def _in_order():
    from pyspark.sql.window import Window

    return Window.orderBy("__key")
