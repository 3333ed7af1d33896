"""A session: an active query, settings, input files, and batches, by the names of the user commands."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .benchmark import Report, run_batch
from .engine import Engine, Result
from .loader import Loader
from .plans.terms import to_query

#: Settings and their starting values.
DEFAULTS: dict[str, Any] = {"result_record_max": 1000, "block_size": 100, "number_of_columns": 4, "distribution_algorithm": "predicate_based", "triple_id_skeleton": "<triple_id_", "hints": True, "compat": False}


@dataclass
class Session:
    spark: SparkSession
    triples: Any = None
    settings: dict[str, Any] = field(default_factory=lambda: dict(DEFAULTS))
    text: str = ""
    tasks: dict[str, str] = field(default_factory=dict)
    last: Report = field(default_factory=Report)

    def __post_init__(self):
        self.loader = Loader(self.spark)

    def config(self, name: str | None = None, value: Any = None) -> Any:
        """All settings, one of them, or one set."""
        if name is None:
            return dict(self.settings)
        if name not in self.settings:
            raise KeyError(name)
        if value is not None:
            self.settings[name] = value
        return self.settings[name]

    # queries
    def active(self, text: str | None = None) -> str:
        """The active query's text; with a text, that becomes active if it is a query."""
        if text is not None:
            to_query(text)
            self.text = text
        return self.text

    def edit(self, old: str, new: str) -> str:
        """Replace a part of the active query."""
        return self.active(self.text.replace(old, new))

    def exec(self, path: str | None = None) -> Result:
        """Run the active query, or that of a file."""
        engine = Engine(self.triples, self.settings["compat"], self.settings["hints"])
        return engine.execute_file(path) if path else engine.execute(self.text)

    def graphs(self, path: str | None = None) -> list[str]:
        """Lines of decoded graphs, at most result_record_max of them."""
        result = self.exec(path).limit(self.settings["result_record_max"])
        return [", ".join(f"{n}: {' '.join(str(v) for v in t)}" for n, t in sorted(g.items())) for block in result.read(self.settings["block_size"]) for g in block]

    # benchmark
    def start_benchmark(self, name: str) -> Report:
        return self.batch_benchmark(name)

    def batch_benchmark(self, *names: str, repeats: int = 1) -> Report:
        """Time tasks (all if none is named); a task is a query's text under a name."""
        engine = Engine(self.triples, self.settings["compat"], self.settings["hints"])
        chosen = {n: self.tasks[n] for n in names or self.tasks}
        self.last = run_batch({n: lambda t=t: engine.execute(t).count() for n, t in chosen.items()}, repeats)
        return self.last

    def report_benchmark(self) -> str:
        return self.last.text()

    def check_benchmark(self, expected: dict[str, int]) -> dict[str, bool]:
        """Whether the last batch had the expected numbers of results."""
        return {t.name: t.results == expected[t.name] for t in self.last.timings if t.name in expected}

    # load
    def data_files(self, command: str = "ls", *paths: str) -> list[str]:
        """ls, add, rem or clr."""
        files = self.loader.files
        {"ls": lambda: files, "add": lambda: files.add(*paths), "rem": lambda: files.remove(*paths), "clr": files.clear}[command]()
        return list(files.paths)

    def _configured(self) -> Loader:
        loader = self.loader
        loader.columns, loader.algorithm, loader.skeleton = self.settings["number_of_columns"], self.settings["distribution_algorithm"], self.settings["triple_id_skeleton"]
        return loader

    def investigate(self) -> dict[str, int]:
        return self._configured().investigate()

    def distribute(self, path: str) -> DataFrame | None:
        return self._configured().distribute(path)

    def load(self, path: str) -> Any:
        """Write the store and query it from now on."""
        self.triples = self._configured().store(path)
        return self.triples

    def save(self, name: str) -> None:
        """The triples at hand as a table of that name in the catalog."""
        frame = self.triples.all() if hasattr(self.triples, "all") else self.triples
        frame.write.mode("overwrite").saveAsTable(name)

    def open(self, name: str) -> DataFrame:
        """Query a table of the catalog from now on."""
        self.triples = self.spark.table(name)
        return self.triples

    def tables(self) -> list[str]:
        return [t.name for t in self.spark.catalog.listTables()]

    def psql(self, text: str) -> DataFrame:
        """A statement on the tables of the catalog."""
        return self.spark.sql(text)

    def profile(self, path: str | None = None) -> list[tuple[int, str, int, float]]:
        """Number, operator, graphs and seconds of each node of the active query, or of a file's."""
        engine = Engine(self.triples, self.settings["compat"], self.settings["hints"])
        if path:
            with open(path) as f:
                return engine.profile(f.read())
        return engine.profile(self.text)

    def describe(self, path: str) -> list[tuple[str, str]]:
        """Columns of a stored table."""
        return self.spark.read.parquet(path).dtypes
