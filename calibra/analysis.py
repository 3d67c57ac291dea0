"""Analyses and indexers of a user's own: subclass ``Analysis`` or ``Indexer`` in a module of some folder, and run them by name.

    python -m calibra.analysis analyze FOLDER SF_DIR OUT_DIR [--formats csv,json,parquet,csv.gz] [NAME ...]
    python -m calibra.analysis index FOLDER [NAME ...]

Without names, all of them.
"""

from __future__ import annotations

import importlib.util
import inspect
import sys
from abc import ABC, abstractmethod
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from calibra.sources import sinks
from calibra.sources.dataset import Folder


@dataclass
class Output:
    """What an analysis gives: rows, a chart, or both."""

    data: DataFrame | None = None
    chart: sinks.Chart | None = None


class Analysis(ABC):
    """A named analysis; ``run`` declares its rows, as a DataFrame or as an Output with a chart."""

    name: str = ""
    description: str = ""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @abstractmethod
    def run(self) -> DataFrame | Output: ...

    def save(self, out_dir: str, formats: list[str] | None = None) -> str | dict[str, str]:
        """Writes the rows to ``out_dir``/name as Parquet, and gives the path; with ``formats``, to name.format for each of them
        that there is something for, and gives the paths by format. csv, csv.gz and parquet hold the rows, json the
        chart; other formats are passed over. An existing result is an error."""
        made = self.run()
        out = made if isinstance(made, Output) else Output(made)
        base = f"{out_dir.rstrip('/')}/{self.name}"
        if formats is None:
            out.data.write.parquet(base)
            return base
        saved: dict[str, str] = {}
        for f in dict.fromkeys(formats):
            path = f"{base}.{f}"
            if f == "json" and out.chart is not None:
                folder = Folder(self.spark, out_dir)
                folder.fs.mkdirs(folder.path)
                folder.write(f"{self.name}.json", out.chart.to_json())
            elif f in ("csv", "csv.gz", "parquet") and out.data is not None:
                sinks.save(out.data, out_dir.rstrip("/"), self.name, [f])
            else:
                continue
            saved[f] = path
        return saved


class Indexer(ABC):
    """A named job that brings data in; ``run`` does it, and may be run again."""

    name: str = ""
    description: str = ""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    @abstractmethod
    def run(self) -> None: ...


def discover(folder: str, base: type = Analysis) -> dict[str, type]:
    """The concrete analyses (or other ``base``) that modules of ``folder`` define, by name. Files that begin with '_' are left
    out; a name given twice, or none, is an error."""
    found: dict[str, type] = {}
    for file in sorted(Path(folder).glob("[!_]*.py")):
        spec = importlib.util.spec_from_file_location(f"analyses_{file.stem}", file)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        for _, kind in inspect.getmembers(module, inspect.isclass):
            if not issubclass(kind, base) or inspect.isabstract(kind) or kind.__module__ != module.__name__:
                continue
            if not kind.name or kind.name in found:
                raise ValueError(f"{file}: {kind.__name__} has no name of its own")
            found[kind.name] = kind
    return found


def chosen(kinds: dict[str, type], names: tuple[str, ...]) -> list[type]:
    unknown = set(names) - set(kinds)
    if unknown:
        raise SystemExit(f"nothing named {', '.join(sorted(unknown))}; there are {', '.join(kinds)}")
    return [kinds[n] for n in names or kinds]


def main(*args: str, spark: SparkSession | None = None) -> None:
    from calibra.session import session

    verb, *rest = args or ("",)
    if verb == "analyze" and len(rest) >= 3:
        folder, sf_dir, out_dir, *names = rest
        formats = None
        if "--formats" in names:
            at = names.index("--formats")
            formats = names[at + 1].split(",")
            del names[at : at + 2]
        for kind in chosen(discover(folder), tuple(names)):
            print(kind(spark or session(), sf_dir).save(out_dir, formats))
    elif verb == "index" and rest:
        folder, *names = rest
        for kind in chosen(discover(folder, Indexer), tuple(names)):
            kind(spark or session()).run()
            print(f"{kind.name}: done")
    else:
        raise SystemExit(__doc__)


if __name__ == "__main__":
    main(*sys.argv[1:])
