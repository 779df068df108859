"""The stored tables as Parquet: append, upsert by key, replace a snapshot's rows, rebuild columns.

A table is a folder of parts, a list of those that hold its rows now (a file ``v-...``), and a file,
CURRENT, that names the list.  A write adds parts and a list, and then puts a new CURRENT in the old
one's place by one atomic rename, so that a job or driver that ends at any moment leaves the old table
or the new one.  What no list names goes when the next write is done.

Tests and failures are cut to slices, one a snapshot: replacing or rebuilding some snapshots writes
these alone, and appending writes the new rows alone.  Repositories and snapshots, a row for each
repository and major, are written whole when rows are replaced.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import TABLES

#: The column whose values are a table's slices.
SLICED = {"test_observations": "snapshot_id", "parse_failures": "snapshot_id"}
#: The name of the slice of nulls, and of the only slice of a table without slices.
NONE, WHOLE = "none", "whole"


def merged(old: DataFrame, new: DataFrame, keys: list[str], version: Column | None = None) -> DataFrame:
    """Both tables' rows, one for each key: the one with the greatest ``version``, by default the new one."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    order = [version.desc()] if version is not None else []
    w = Window.partitionBy(*keys).orderBy(*order, F.col("_batch").desc())
    return both.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place", "_batch")


class Store:
    """Tables under one folder, each with its fixed schema."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _current(self, name: str) -> str | None:
        fs, p = self._at(f"{self.root}/{name}/CURRENT")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _slices(self, name: str) -> dict[str, list[str]]:
        """Slice to the folders, under the table's, that hold its rows."""
        version = self._current(name)
        if version is None:
            return {}
        fs, p = self._at(f"{self.root}/{name}/{version}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _of(self, name: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*(f"{self.root}/{name}/{x}" for x in folders))

    def read(self, name: str, slices: list | None = None) -> DataFrame:
        """The table, or those of its slices that are named by their values."""
        have = self._slices(name)
        names = have if slices is None or name not in SLICED else {_named(v) for v in slices} & set(have)
        return self._of(name, [x for n in names for x in have[n]])

    def _add(self, name: str, df: DataFrame) -> dict[str, list[str]]:
        """Write ``df`` to a new part; its slices."""
        df = df.select(*(F.col(f.name).cast(f.dataType) for f in TABLES[name]))
        part = f"p-{uuid.uuid4().hex}"
        column = SLICED.get(name)
        if column is None:
            df.write.parquet(f"{self.root}/{name}/{part}")
            return {WHOLE: [part]}
        cut = df.withColumn("slice", F.coalesce(F.col(column).cast("string"), F.lit(NONE)))
        cut.hint("rebalance", "slice").write.partitionBy("slice").parquet(f"{self.root}/{name}/{part}")
        fs, folder = self._at(f"{self.root}/{name}/{part}")
        found = [e.getPath().getName() for e in fs.listStatus(folder) if e.isDirectory()]
        return {x.removeprefix("slice="): [f"{part}/{x}"] for x in found if x.startswith("slice=")}

    def _commit(self, name: str, slices: dict[str, list[str]]) -> None:
        """Make ``slices`` the table, then delete what it doesn't hold."""
        version = f"v-{uuid.uuid4().hex}"
        fs, listed = self._at(f"{self.root}/{name}/{version}")
        out = fs.create(listed, True)
        out.write(json.dumps(slices).encode())
        out.close()
        self._point(name, version)
        held = {x for folders in slices.values() for x in folders}
        parts = {x.split("/")[0] for x in held}
        for entry in fs.listStatus(self._at(f"{self.root}/{name}")[1]):
            path = entry.getPath()
            if path.getName() not in (version, "CURRENT") and path.getName() not in parts:
                fs.delete(path, True)
            elif entry.isDirectory():
                for inner in fs.listStatus(path):
                    if inner.isDirectory() and f"{path.getName()}/{inner.getPath().getName()}" not in held:
                        fs.delete(inner.getPath(), True)

    def write(self, name: str, df: DataFrame) -> None:
        """Put ``df`` in the table's place; it may read the table itself."""
        self._commit(name, self._add(name, df))

    def _swap(self, name: str, slices: list, df: DataFrame) -> None:
        """Put ``df`` in the place of the slices of these values, and next to what other slices hold."""
        gone = {_named(v) for v in slices}
        kept = {n: x for n, x in self._slices(name).items() if n not in gone}
        for n, folders in self._add(name, df).items():
            kept[n] = [*kept.get(n, []), *folders]
        self._commit(name, kept)

    def _point(self, name: str, version: str) -> None:
        """Make ``version`` the current one."""
        fs, draft = self._at(f"{self.root}/{name}/.next-{version}")
        out = fs.create(draft, True)
        out.write(version.encode())
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        options = gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        files.rename(draft, self._at(f"{self.root}/{name}/CURRENT")[1], options)

    def append(self, name: str, df: DataFrame) -> None:
        self._swap(name, [], filled(df, name))

    def upsert(self, name: str, df: DataFrame, keys: list[str]) -> None:
        """``df``'s rows, each in the place of the row with its keys."""
        self.write(name, merged(self.read(name), filled(df, name), keys))

    def replace_keys(self, name: str, df: DataFrame, keys: DataFrame) -> None:
        """Rows whose values in the columns of ``keys`` are there give way to ``df``, even if that is empty.

        ``keys`` names the slices' column in a sliced table; its different values there, a batch's snapshots, go through the driver.
        """
        column = SLICED.get(name)
        slices = None if column is None else [r[0] for r in keys.select(column).distinct().collect()]
        kept = self.read(name, slices).join(keys.distinct(), keys.columns, "left_anti").select(*TABLES[name].names)
        new = kept.unionByName(filled(df, name))
        if slices is None:
            self.write(name, new)
        else:
            self._swap(name, slices, new)

    def replace(self, name: str, df: DataFrame, column: str, values: list) -> None:
        """Rows whose ``column`` is one of ``values`` give way to ``df``, even if that is empty."""
        if SLICED.get(name) == column:
            self._swap(name, [v for v in values if v is not None], filled(df, name))
            return
        kept = self.read(name).where(~F.col(column).isin(*values) | F.col(column).isNull()) if values else self.read(name)
        self.write(name, kept.unionByName(filled(df, name)))

    def rebuild(self, name: str, where: Column, facts: DataFrame, key: str, columns: list[str], slices: list | None = None) -> None:
        """Reset ``columns`` of the rows that ``where`` holds for, then fill them from ``facts`` by ``key``; in ``slices`` alone, where given."""
        out = rebuilt(self.read(name, slices), where, facts, key, columns)
        if slices is None or name not in SLICED:
            self.write(name, out)
        else:
            self._swap(name, slices, out)


def _named(value) -> str:
    return NONE if value is None else str(value)


def rebuilt(rows: DataFrame, where: Column, facts: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` null where ``where`` holds and ``facts`` has no row of that ``key``, else the facts' there."""
    found = facts.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns))
    out = rows.join(found, rows[key] == F.col("_key"), "left")
    return out.withColumns({c: F.when(where, F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).select(*rows.columns)


def filled(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the table's columns, absent ones null."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name]))
