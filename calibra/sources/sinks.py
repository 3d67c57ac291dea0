"""Sinks: chunked Parquet, one-file CSV, insert-if-absent, manifests, staged publishing, chart specifications."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tarfile
import zipfile
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHUNK_ROWS = 10_000
# The names of the chart contract.
CHART_TYPES = ("line", "bar", "stacked-bar", "stacked-bar-100", "area", "stacked-area-100", "pie", "scatter", "heatmap", "treemap")
UNITS = ("dollars", "percent", "bytes", "eth", "btc", "cents", "number")
SCALES = ("linear", "log")
CHART_FIELDS = {
    "type": "type", "data": "data", "series": "series", "x": "xKey", "y": "yKeys", "y_one": "yKey", "z": "zKey", "title": "title", "height": "height", "stacked": "stacked", "name": "nameKey", "value": "valueKey",
    "children": "childrenKey", "x_scale": "xScale", "y_scale": "yScale", "y_unit": "yUnit", "dashes": "strokeDasharrays", "caption": "caption", "colors": "colors", "x_label": "xLabel", "y_label": "yLabel",
}


def append_chunks(df: DataFrame, path: str, rows: int = CHUNK_ROWS) -> None:
    df.write.mode("append").option("maxRecordsPerFile", rows).parquet(path)


def insert_absent(df: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key isn't at ``path`` yet, once each."""
    spark = df.sparkSession
    new = df.dropDuplicates([key])
    try:
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    except Exception as e:  # nothing stored yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    append_chunks(new, path)


def csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    """A small result as one CSV file with a head."""
    df.coalesce(1).write.mode("errorifexists").option("header", True).option("compression", "gzip" if gzip else "none").csv(path)


def save(df: DataFrame, folder: str, name: str, formats: list[str]) -> list[str]:
    """A result in the named formats; those that this suite doesn't write (images) are passed over."""
    writers = {"csv": lambda p: csv(df, p), "csv.gz": lambda p: csv(df, p, gzip=True), "parquet": lambda p: df.write.parquet(p), "json": lambda p: df.write.json(p)}
    done = []
    for f in formats:
        if f in writers:
            writers[f](path := f"{folder}/{name}.{f}")
            done.append(path)
    return done


@dataclass
class Chart:
    """A chart specification. Its JSON has the contract's names; what isn't set is left out."""

    type: str
    data: list[dict]
    series: dict[str, list[dict]] | None = None  # name -> points
    x: str | None = None
    y: list[str] | None = None
    y_one: str | None = None
    z: str | None = None
    title: str | None = None
    height: int | None = None
    stacked: bool | None = None
    name: str | None = None
    value: str | None = None
    children: str | None = None
    x_scale: str | None = None
    y_scale: str | None = None
    y_unit: str | None = None
    dashes: list[str | None] | None = None
    caption: str | None = None
    colors: dict[str, str] | None = None
    x_label: str | None = None
    y_label: str | None = None

    def __post_init__(self):
        for value, known, what in ((self.type, CHART_TYPES, "chart type"), (self.y_unit, UNITS, "unit"), (self.x_scale, SCALES, "scale"), (self.y_scale, SCALES, "scale")):
            if value is not None and value not in known:
                raise ValueError(f"no such {what}: {value}")

    def to_dict(self) -> dict:
        out = {k: getattr(self, f) for f, k in CHART_FIELDS.items() if getattr(self, f) is not None}
        if self.series is not None:
            out["series"] = [{"name": n, "data": points} for n, points in self.series.items()]
        return out

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2, default=plain)


def plain(value):
    """Dates and times as ISO text, decimals as numbers."""
    return value.isoformat() if hasattr(value, "isoformat") else float(value) if hasattr(value, "__float__") else str(value)


def rows_of(data, most: int = 10_000) -> list[dict]:
    """The rows of a small result, or dicts as they are. A chart of more than ``most`` points is an error."""
    rows = [r.asDict(recursive=True) for r in data.limit(most + 1).collect()] if isinstance(data, DataFrame) else list(data)
    if len(rows) > most:
        raise ValueError(f"a chart of more than {most} points")
    return rows


def _ys(y) -> list[str]:
    return [y] if isinstance(y, str) else list(y)


def line_chart(data, x: str = "x", y: str | list[str] = "y", **more) -> Chart:
    return Chart("line", rows_of(data), x=x, y=_ys(y), **more)


def bar_chart(data, x: str = "x", y: str | list[str] = "y", stacked: bool = False, **more) -> Chart:
    return Chart("stacked-bar" if stacked else "bar", rows_of(data), x=x, y=_ys(y), **more)


def area_chart(data, x: str = "x", y: str | list[str] = "y", stacked: bool = False, **more) -> Chart:
    return Chart("area", rows_of(data), x=x, y=_ys(y), stacked=stacked, **more)


def pie_chart(data, name: str = "name", value: str = "value", **more) -> Chart:
    return Chart("pie", rows_of(data), name=name, value=value, **more)


def scatter_chart(data, x: str = "x", y: str = "y", z: str | None = None, series: dict[str, list[dict]] | None = None, **more) -> Chart:
    return Chart("scatter", rows_of(data), x=x, y=[y], z=z, series=series, **more)


def heatmap(data, x: str = "x", y: str = "y", value: str = "value", **more) -> Chart:
    return Chart("heatmap", rows_of(data), x=x, y_one=y, value=value, **more)


def treemap(data, name: str = "name", value: str = "value", children: str = "children", **more) -> Chart:
    return Chart("treemap", rows_of(data), name=name, value=value, children=children, **more)


def nested(tree: DataFrame, levels: list[str], value: str) -> list[dict]:
    """A tree as rows (depth, a column a level, value), such as category_treemap's, nested by value, the largest first."""
    rows = sorted(rows_of(tree), key=lambda r: (r["depth"], -r[value], *[str(r[c]) for c in levels]))
    roots: list[dict] = []
    held = {}
    for r in rows:
        path = tuple(r[c] for c in levels[: r["depth"]])
        node = {"name": path[-1], "value": r[value]}
        held[path] = node
        if len(path) == 1:
            roots.append(node)
        else:
            held[path[:-1]].setdefault("children", []).append(node)
    return roots


def chart_of(df: DataFrame, kind: str, x: str, y: list[str], **more) -> Chart:
    """A chart of a small result."""
    return Chart(kind, rows_of(df.select(x, *y).orderBy(x)), x=x, y=y, **more)


def manifest(path: str, **facts) -> None:
    Path(path).write_text(json.dumps(facts, indent=2, default=str))


def checksum(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def install(archive: str, sha256: str, members: list[str], target: str) -> None:
    """Unpack exactly ``members`` of a checked archive; the target appears whole or not at all."""
    if checksum(archive) != sha256:
        raise ValueError("checksum differs")
    if os.path.exists(target):
        raise FileExistsError(target)
    staging = f"{target}.staging"
    shutil.rmtree(staging, ignore_errors=True)
    try:
        with zipfile.ZipFile(archive) as z:
            if sorted(z.namelist()) != sorted(members) or any(os.path.isabs(m) or ".." in Path(m).parts for m in members):
                raise ValueError("unexpected members")
            z.extractall(staging)
        os.rename(staging, target)
    finally:
        shutil.rmtree(staging, ignore_errors=True)


def count_rows(spark: SparkSession, path: str) -> int:
    return spark.read.option("header", True).csv(path).count()


def pack(folder: str, archive: str) -> str:
    """``folder`` as a tar archive compressed with zstd, members in order of their names; gives the checksum."""
    import zstandard

    part = f"{archive}.part"
    with open(part, "wb") as f, zstandard.ZstdCompressor().stream_writer(f) as z, tarfile.open(fileobj=z, mode="w|") as tar:
        for p in sorted(Path(folder).rglob("*")):
            tar.add(p, p.relative_to(folder), recursive=False)
    os.replace(part, archive)
    return checksum(archive)


def unpack(archive: str, target: str) -> bool:
    """Unpacks what pack() made, unless ``target`` exists; the target appears whole or not at all. Gives whether it did."""
    import zstandard

    if os.path.exists(target):
        return False
    staging = f"{target}.staging"
    shutil.rmtree(staging, ignore_errors=True)
    try:
        with open(archive, "rb") as f, zstandard.ZstdDecompressor().stream_reader(f) as z, tarfile.open(fileobj=z, mode="r|") as tar:
            tar.extractall(staging, filter="data")
        os.rename(staging, target)
    finally:
        shutil.rmtree(staging, ignore_errors=True)
    return True
