"""The load pipeline: look at files, assign columns, dump or store, encode."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .operators.dictionary import Dictionary, Encoded, encode_triples, strings_of
from .operators.distribution import assign_greedy, assign_round_robin, collect_frequency, dump_columns, predicate_frequency, route, route_random
from .sources.triples import BUCKETS, Store, dump_csv, from_lexical, load_map, save_map, write_store
from .sources.tsv import FileList, fill_ids

ALGORITHMS = ("predicate_based", "predicate_based_p", "random")


@dataclass
class Loader:
    """Files to triples.  columns: the number of horizontal parts; algorithm: how predicates are assigned to them."""

    spark: SparkSession
    columns: int = 4
    algorithm: str = "predicate_based"
    skeleton: str = "<triple_id_"
    files: FileList = field(default_factory=FileList)
    pred_freq: dict[str, int] = field(default_factory=dict)
    pred_clm: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        if self.algorithm not in ALGORITHMS:
            raise ValueError(f"algorithm must be one of {ALGORITHMS}")

    def raw(self) -> DataFrame:
        """tid, s, p, o of all files, missing ids filled in."""
        return fill_ids(self.files.read(self.spark), self.skeleton, scan=True)

    def investigate(self) -> dict[str, int]:
        """Count predicates and assign them to columns."""
        self.pred_freq = collect_frequency(predicate_frequency(self.files.read(self.spark)))
        return self.assign()

    def assign(self) -> dict[str, int]:
        """Assign columns from the frequencies known."""
        if self.algorithm == "random":
            self.pred_clm = {}
        else:
            self.pred_clm = (assign_greedy if self.algorithm == "predicate_based" else assign_round_robin)(self.pred_freq, self.columns)
        return self.pred_clm

    def routed(self, triples: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Triples with a column each, and those refused because investigate() hasn't seen their predicate."""
        return (route_random(triples, self.columns), None) if self.algorithm == "random" else route(triples, self.pred_clm)

    def save_maps(self, path: str) -> None:
        save_map(self.spark, self.pred_freq, f"{path}/pred_freq")
        save_map(self.spark, self.pred_clm, f"{path}/pred_clm")

    def load_maps(self, path: str) -> None:
        self.pred_freq, self.pred_clm = load_map(self.spark, f"{path}/pred_freq"), load_map(self.spark, f"{path}/pred_clm")

    def distribute(self, path: str) -> DataFrame | None:
        """Dump the raw triples as text, a folder per column; returns the refused ones."""
        kept, refused = self.routed(self.raw())
        dump_columns(kept, path)
        return refused

    def store(self, path: str, buckets: int = BUCKETS) -> Store:
        """Type the triples and write the store that queries scan."""
        write_store(from_lexical(self.raw()), path, buckets)
        return Store(self.spark, path, buckets)

    def encode(self, path: str, dictionary: Dictionary | None = None) -> Dictionary:
        """Write the encoded triples and the dictionary as Parquet; strings known before keep their ids."""
        triples = from_lexical(self.raw())
        known = (dictionary or Dictionary.empty(self.spark)).append(strings_of(triples))
        known.entries.write.mode("overwrite").parquet(f"{path}/dictionary")
        known = Dictionary(self.spark.read.parquet(f"{path}/dictionary"), known.last)
        encode_triples(triples, known).write.mode("overwrite").parquet(f"{path}/triples")
        return known

    def encoded(self, path: str) -> Encoded:
        """What encode() wrote, to query."""
        return Encoded(self.spark.read.parquet(f"{path}/triples"), Dictionary(self.spark.read.parquet(f"{path}/dictionary")))

    def dump(self, table: str, path: str) -> None:
        """A stored table as tab-separated text, without the columns of its layout."""
        dump_csv(self.spark.read.parquet(table).drop("batch", "p_part"), path)
