"""State tables: insert-if-absent, replacement, cascades, run logs.

Tables are immutable relations; changes are anti-joins and unions, and :class:`StateStore` keeps their versions.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _keyed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.select(*[F.col(k).alias(f"_key_{k}") for k in keys]).distinct()


def _same(rows: DataFrame, other: DataFrame, keys: Sequence[str]):
    test = F.lit(True)
    for k in keys:
        test = test & rows[k].eqNullSafe(other[f"_key_{k}"])
    return test


def without(rows: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys do not occur in ``gone``; nulls are equal."""
    other = _keyed(gone, keys)
    return rows.join(other, _same(rows, other, keys), "left_anti")


def absent(existing: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows to insert: keys that ``existing`` lacks, one row a key."""
    return without(rows.dropDuplicates(list(keys)), existing, keys)


def replace_rows(existing: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``existing`` with the rows of equal keys replaced, new keys appended."""
    return without(existing, rows, keys).unionByName(rows.dropDuplicates(list(keys)), allowMissingColumns=True)


def run_counters(outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """seen, inserted, skipped, replaced, errors and the last key of each run."""
    def count(name: str):
        return F.count_if(F.col("outcome") == name)

    return outcomes.groupBy(*keys).agg(
        F.count("*").alias("seen"), count("inserted").alias("inserted"), count("skipped").alias("skipped"),
        count("replaced").alias("replaced"), count("error").alias("errors"), F.max("mbox_key").alias("last_mbox_key"))


def latest_runs(runs: DataFrame, keys: Sequence[str], order: str = "id") -> DataFrame:
    """The run with the largest ``order`` of each key."""
    kept = [x for x in runs.columns if x not in keys]
    return runs.groupBy(*keys).agg(F.max_by(F.struct(*kept), order).alias("_r")).select(*keys, "_r.*")


def resume_points(runs: DataFrame) -> DataFrame:
    """Checkpoint of the latest running or interrupted run of each source."""
    open_runs = runs.filter(F.col("status").isin("running", "interrupted"))
    return latest_runs(open_runs, ["source_id"]).select("source_id", "id", "last_mbox_key")


class Change:
    """What one change does to the tables; it takes effect as a whole when the store commits it."""

    def __init__(self, store: StateStore):
        self.store, self.base = store, store.version()
        self.tables = store.current()

    def read(self, table: str, schema: StructType | str) -> DataFrame:
        """The table as this change leaves it so far."""
        return self.store.load(self.tables.get(table, []), schema)

    def create(self, table: str) -> None:
        """An empty table, unless there is one."""
        self.tables.setdefault(table, [])

    def append(self, table: str, rows: DataFrame) -> None:
        """Write the new rows, with the parts at the end when there are seven of the same level: eight make one of the next."""
        parts, level = list(self.tables.get(table, [])), 0
        while len(tail := parts[1 - MERGED:]) == MERGED - 1 and {_level(p) for p in tail} == {level}:
            rows = rows.unionByName(self.store.load(tail, rows.schema))
            parts, level = parts[:1 - MERGED], level + 1
        self.tables[table] = [*parts, self.store.save(table, rows, level)]

    def replace(self, table: str, rows: DataFrame) -> None:
        self.tables[table] = [self.store.save(table, rows, 0)]


#: Parts of one level that are merged.
MERGED = 8


def _level(part: str) -> int:
    return int(part.rsplit("/", 1)[1].split("-")[0])


class StateStore:
    """Tables as lists of Parquet part folders under one root, on any file system Spark knows.

    A manifest names the parts of every table.  A change writes its parts first and then the next manifest by one
    rename, so it takes effect for all its tables at once, and a lost one changes nothing.  Readers take the newest
    manifest.  Two writers at once cannot both make the next version: the later one fails.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, where: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(where)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifest(self, version: int) -> str:
        return f"{self.root}/_manifests/{version:08d}.json"

    def versions(self) -> list[int]:
        fs, folder = self._fs(), self._path(f"{self.root}/_manifests")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def version(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int) -> dict[str, list[str]]:
        if not version:
            return {}
        stream = self._fs().open(self._path(self._manifest(version)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> dict[str, list[str]]:
        return self.manifest(self.version())

    def tables(self) -> list[str]:
        return sorted(self.current())

    def load(self, parts: list[str], schema: StructType | str) -> DataFrame:
        """The rows of some parts; columns that an older part lacks are null."""
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in parts])

    def read(self, table: str, schema: StructType | str) -> DataFrame:
        """The newest version; an empty relation when there is none."""
        return self.load(self.current().get(table, []), schema)

    def save(self, table: str, rows: DataFrame, level: int) -> str:
        """Write a part that no manifest names yet; returns its place under the root."""
        part = f"{table}/{level}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{part}")
        return part

    @contextmanager
    def change(self) -> Iterator[Change]:
        """A change that is committed at the end, or dropped on an error."""
        made = Change(self)
        yield made
        self.commit(made)

    def commit(self, made: Change, keep: int = 2) -> None:
        """Make the change's tables the next version; older versions than the last ``keep`` go with their parts."""
        fs, target = self._fs(), self._path(self._manifest(made.base + 1))
        partial = self._path(f"{self.root}/_manifests/.{uuid.uuid4().hex}")
        out = fs.create(partial)
        out.write(bytearray(json.dumps(made.tables).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(partial, target):
            fs.delete(partial, False)
            raise RuntimeError("another change came first")
        kept = self.versions()[-keep:]
        needed = {p for v in kept for parts in self.manifest(v).values() for p in parts}
        for old in [v for v in self.versions() if v not in kept]:
            for part in {p for parts in self.manifest(old).values() for p in parts} - needed:
                fs.delete(self._path(f"{self.root}/{part}"), True)
            fs.delete(self._path(self._manifest(old)), False)

    def write(self, table: str, rows: DataFrame) -> None:
        """Replace one table."""
        with self.change() as made:
            made.replace(table, rows)

    def append(self, table: str, rows: DataFrame) -> None:
        """Add rows to one table."""
        with self.change() as made:
            made.append(table, rows)
