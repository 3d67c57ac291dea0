"""Percentile intervals by resampling whole blocks, with draws that depend on the block's hash alone."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cumulative chances of a Poisson number of mean 1, up to what 64 bits tell apart.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with their bits mixed, each the same wherever and in whatever order it is made."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def poisson_counts(hashes: np.ndarray, repetitions: int, seed: int) -> np.ndarray:
    """(blocks, repetitions) Poisson numbers of mean 1, from the hash of a block and the number of the repetition."""
    step = np.arange(1, repetitions + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    own = mixed(hashes.astype(np.int64).view(np.uint64) + np.uint64(seed))
    u = (mixed(own[:, None] + step[None, :]) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return np.searchsorted(POISSON, u, side="right")


def resampled_sums(blocks: DataFrame, key: str, values: list[str], repetitions: int = 2000, seed: int = 340, rows: int = 512) -> DataFrame:
    """(rep, *values): the sums of ``values`` over the blocks, each counted as often as its draw says, for every repetition.

    Drawing as many blocks as there are comes to Poisson numbers of mean 1 for many blocks. A batch of blocks is drawn and
    multiplied at once; a task sends one row of sums a repetition, whatever it has read.
    """

    def draw(batches):
        total = np.zeros((repetitions, len(values)))
        for pdf in batches:
            x, h = pdf[values].to_numpy(dtype=float), pdf["__h"].to_numpy()
            for at in range(0, len(x), rows):
                total += poisson_counts(h[at : at + rows], repetitions, seed).T.astype(float) @ x[at : at + rows]
        yield pd.DataFrame({"rep": np.arange(repetitions), **{c: total[:, k] for k, c in enumerate(values)}})

    hashed = blocks.select(F.xxhash64(key).alias("__h"), *[F.col(c).cast("double").alias(c) for c in values])
    parts = hashed.mapInPandas(draw, "rep long, " + ", ".join(f"{c} double" for c in values))
    return parts.groupBy("rep").agg(*[F.sum(c).alias(c) for c in values])
