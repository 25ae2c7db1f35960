"""Tables kept by generation in a folder: each generation adds what changed, and a manifest says what makes up a table.

    <table>/g<generation>      rows written by a generation, with `gone` for keys that it takes away
    manifest/g<generation>     a row (table, generations) for each table, written last

A generation counts from the moment its manifest is there; what a failed one has left behind is written over by the next
try. A table is the first of its generations without the keys of the later ones, and of these the latest row of each key.
Compacting writes it as one generation; clearing deletes what no manifest that is kept refers to."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Store:
    """A folder of generations; keys: the key column of each table."""

    spark: SparkSession
    folder: str
    keys: dict[str, str]
    made: dict[str, list[int]] = field(default_factory=dict)

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _generations(self, name: str) -> list[int]:
        files, path = self._files(), self._path(name)
        return sorted(int(s.getPath().getName()[1:]) for s in files.listStatus(path) if s.getPath().getName().startswith("g")) if files.exists(path) else []

    def generations(self) -> list[int]:
        """Those whose manifest is whole."""
        files = self._files()
        return [g for g in self._generations("manifest") if files.exists(self._path(f"manifest/g{g}/_SUCCESS"))]

    def parts(self, generation: int | None = None) -> dict[str, list[int]]:
        """The generations that make up each table."""
        known = self.generations()
        if not known:
            return {}
        rows = self.spark.read.parquet(f"{self.folder}/manifest/g{known[-1] if generation is None else generation}").collect()  # a row for each table
        return {r["table"]: list(r["generations"]) for r in rows}

    def read(self, table: str, generation: int | None = None) -> DataFrame | None:
        """The table as of a generation (the last one), or None before the first."""
        made = self.parts(generation).get(table)
        return None if made is None else self._read(table, made)

    def _read(self, table: str, made: list[int]) -> DataFrame:
        key = self.keys[table]
        rows = {g: self.spark.read.parquet(f"{self.folder}/{table}/g{g}") for g in made}
        first = rows[made[0]]
        if len(made) > 1:
            later = None
            for g in made[1:]:
                own = rows[g].withColumn("__g", F.lit(g))
                later = own if later is None else later.unionByName(own)
            columns = [c for c in later.columns if c not in (key, "__g")]
            last = later.groupBy(key).agg(F.max_by(F.struct(*columns), "__g").alias("x")).select(key, "x.*")
            first = first.join(last.select(key), key, "left_anti").unionByName(last.select(first.columns))
        return first.filter("not gone").drop("gone")

    def commit(self, changes: dict[str, DataFrame], whole: bool = False) -> int:
        """Write changes (rows with `gone`) as the next generation; whole: they are the tables, not changes of them."""
        before = self.parts()
        generation = max([0, *self.generations()]) + 1
        for table, rows in changes.items():
            rows.write.mode("overwrite").parquet(f"{self.folder}/{table}/g{generation}")
        made = {t: ([] if whole else before.get(t, [])) + ([generation] if t in changes else []) for t in {**before, **changes}}
        self.spark.createDataFrame(list(made.items()), "table string, generations array<int>").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/g{generation}")
        return generation

    def written(self, generation: int) -> dict[str, int]:
        """The rows that a generation wrote of each table."""
        return {t: self.spark.read.parquet(f"{self.folder}/{t}/g{generation}").count() for t, made in self.parts(generation).items() if generation in made}

    def compact(self) -> int:
        """The tables as they are, as one generation."""
        return self.commit({t: self._read(t, made).withColumn("gone", F.lit(False)) for t, made in self.parts().items()}, whole=True)

    def clear(self, keep: int = 1) -> list[str]:
        """Delete the manifests before the last `keep` and the rows that none of these needs; gives the folders deleted."""
        known = self.generations()
        kept = known[-keep:]
        needed = {(t, g) for k in kept for t, made in self.parts(k).items() for g in made}
        old = [f"manifest/g{g}" for g in known if g not in kept]
        old += [f"{t}/g{g}" for t in self.keys for g in self._generations(t) if (t, g) not in needed and known and g <= known[-1]]
        files = self._files()
        for name in old:
            files.delete(self._path(name), True)
        return old
