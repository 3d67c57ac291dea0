"""SimHash near-duplicates by tiled exact comparison.

Distinct 64-bit fingerprints are laid in tiles by the population counts of their four 16-bit words. Two fingerprints
within the radius have population counts that differ by no more than it, word by word and in sum, so only tiles that
near to each other meet; a tile pair is compared with numpy exclusive-or and bit counts, and yields a spanning forest
of its links, not the links themselves.
"""

from __future__ import annotations

from itertools import chain, product

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from calibra.llm.common import documents, map_arrow, materialise, slices
from calibra.llm.components import connected_components, forest, stars

RADIUS = 3
SEED = 42
TILE = 2048  # fingerprints in a tile, about


def majorities(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per run of ``lengths`` hashes, the bits set in over half of them. Byte lanes of 64-bit numbers add up eight bits at once."""
    out = np.zeros(len(lengths), dtype=np.uint64)
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    n = lengths[full]
    parts = -(-n // 255)  # a lane holds the count of 255
    first = np.cumsum(parts) - parts
    within = np.arange(parts.sum()) - np.repeat(first, parts)
    starts = np.repeat(np.cumsum(n) - n, parts) + 255 * within
    counts = np.empty((len(n), 64), dtype=np.uint32)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & np.uint64(0x0101010101010101), starts)
        counts[:, k::8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.uint32)
    out[full] = np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def shingle_hashes(text: str, size: int = 3) -> list[int]:
    """XXH64 (seed 42) of the text's word shingles, lower-cased in A-Z, repeats included."""
    words = text.encode().lower().split()  # bytes: lower() changes A-Z only, split() cuts at 09-0D and 20
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        return [digest(b" ".join(words), SEED)]
    return [digest(s, SEED) for s in map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))]


def text_fingerprints(texts: list[str]) -> np.ndarray:
    hashes = [shingle_hashes(t) for t in texts]
    flat = np.fromiter(chain.from_iterable(hashes), dtype=np.uint64, count=sum(map(len, hashes)))
    return majorities(flat, np.array([len(h) for h in hashes]))


def text_hash():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp) of every whole text, th its 64-bit hash; null and empty texts have fingerprint zero."""

    def work(batches):
        for batch in slices(batches):
            yield {"doc_id": batch.column("doc_id"), "th": batch.column("th"), "fp": text_fingerprints(batch.column("text").to_pylist()).view(np.int64)}

    return map_arrow(documents(docs).withColumn("th", text_hash()), work, "doc_id long, th long, fp long")


def near_cells(radius: int = RADIUS) -> list[int]:
    """Steps to the cells of equal or larger key whose word counts differ by ``radius`` in sum at most."""
    steps = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]
    return [((d[0] * 32 + d[1]) * 32 + d[2]) * 32 + d[3] for d in steps]


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the fingerprints within the radius: between two tiles, or inside one where ``right`` is None."""
    inside = right is None
    right = left if inside else right
    values = left if inside else np.concatenate([left, right])
    label = np.arange(len(values))
    step = max(1, (1 << 20) // max(1, len(right)))
    for at in range(0, len(left), step):
        i, j = np.nonzero(np.bitwise_count(left[at : at + step, None] ^ right[None, :]) <= radius)
        i += at
        if inside:
            i, j = i[i < j], j[i < j]
        label = forest(i, j + (0 if inside else len(left)), len(values), label)
    leaf = np.flatnonzero(label != np.arange(len(values)))
    return values[leaf], values[label[leaf]]


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): links of distinct fingerprints ``fp`` (signed) within ``radius`` bits, down to a spanning forest of each tile pair.

    There are 17^4 cells at most, so the table of their sizes may be broadcast. A large cell is dealt over tiles by hash.
    """
    word = lambda k: F.bit_count(F.shiftrightunsigned("fp", 48 - 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long")))
    keyed = distinct.select("fp", (((word(0) * 32 + word(1)) * 32 + word(2)) * 32 + word(3)).cast("int").alias("cell"))
    sizes = keyed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    sizes = materialise(sizes)
    tiled = keyed.join(F.broadcast(sizes), "cell").withColumn("tile", F.pmod(F.xxhash64("fp"), "tiles").cast("int"))
    tiles = materialise(tiled.groupBy("cell", "tile").agg(F.collect_list("fp").alias("fps")))
    steps = F.array(*[F.lit(s) for s in near_cells(radius)]).cast(ArrayType(IntegerType()))
    near = F.explode(F.transform(steps, lambda s: F.col("from_cell") + s))
    left = tiles.select(F.col("cell").alias("from_cell"), F.col("tile").alias("from_tile"), F.col("fps").alias("left"))
    left = left.withColumn("cell", near).join(F.broadcast(sizes), "cell").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    left = left.where("from_cell <> cell OR from_tile <= tile")
    pairs = left.join(tiles, ["cell", "tile"]).select("left", "fps", ((F.col("from_cell") == F.col("cell")) & (F.col("from_tile") == F.col("tile"))).alias("same"))

    def work(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = (batch.column(c)[k].values.to_numpy().view(np.uint64) for c in (0, 1))
                a, b = tile_links(x, None if batch.column(2)[k].as_py() else y, radius)
                if len(a):
                    yield {"a": a.view(np.int64), "b": b.view(np.int64)}

    return map_arrow(pairs, stars(work), "a long, b long")


def groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, th, fp, component_id, group_fp) of every row; group_fp is a fingerprint that tells its component from all others."""
    rows = materialise(fingerprints(docs))
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    parts = connected_components(fingerprint_links(distinct.select("fp"), radius))
    linked = distinct.join(parts, distinct["fp"] == parts["node"]).select("fp", "component", "first_id")
    least = linked.groupBy("component").agg(F.min("first_id").alias("least_id"))
    grouped = materialise(linked.join(least, "component").select("fp", "component", "least_id"))
    # few fingerprints have links; rows without one are their fingerprint's first document
    ids = distinct.join(grouped, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"), F.coalesce("component", "fp").alias("group_fp"))
    return rows.join(ids, "fp").select("doc_id", "th", "fp", "component_id", "group_fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links of ``radius`` bits at most.

    Documents of equal fingerprint, those without words among them, are linked. Repeated rows give a row each; a null
    doc_id stays null and is never a component's id unless nothing else is there; an empty table gives none; extra
    columns are left behind. Rows are pre-aggregated to distinct fingerprints, so copies cost nothing, and a component
    comes back by joining on fingerprints.
    """
    return groups(docs, radius).select("doc_id", "fp", "component_id")


def first_of_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs, with all their columns: of each group of near duplicates the row with the smallest doc_id (nulls last), then
    the smallest hash of its text. Of rows alike in both one stays, whatever else they hold."""
    first = groups(docs, radius).groupBy("group_fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("kept"))
    kept = first.select(F.col("kept.doc_id").alias("__kept_id"), F.col("kept.th").alias("__kept_th"))
    keyed = docs.withColumns({"__own_id": F.col("doc_id").cast("long"), "__own_th": text_hash()})
    found = keyed.join(kept, keyed["__own_id"].eqNullSafe(kept["__kept_id"]) & (keyed["__own_th"] == kept["__kept_th"]), "left_semi")
    return found.dropDuplicates(["__own_id", "__own_th"]).select(*docs.columns)


def op6(spark, sf_dir: str) -> DataFrame:
    from calibra.llm.common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
