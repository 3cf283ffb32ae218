"""Tables that change by key, on any file system that Spark writes to: what is written grows with a change, not with the table.

A change writes rows and their keys beside what is there. Readers merge: a row counts if no later change has its
key. One manifest names the files of all tables of a root, and a change counts from the moment that the next manifest is
there, for all its tables at once. Whoever reads an older manifest still finds its files, until vacuum().
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The column that tells a row's bucket; buckets are folders.
BUCKET = "bucket_"


class ChangedMeanwhile(RuntimeError):
    """Another change was committed since this one began."""


class Tables:
    """Tables of a root. Each has a key, and may be laid out in buckets by any column of its rows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # Files

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._path(folder)
        return [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []

    def _read_text(self, name: str) -> str:
        fs, path = self._path(name)
        stream = fs.open(path)
        try:
            return bytes(b & 255 for b in stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write_text(self, text: str, name: str) -> None:
        """The file is there as a whole or not at all: it is written under another name first."""
        fs, path = self._path(name)
        _, beside = self._path(f"{name}-{uuid.uuid4().hex}.part")
        stream = fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if fs.exists(path) or not fs.rename(beside, path):
            fs.delete(beside, False)
            raise ChangedMeanwhile(f"{name} is there already")

    # Versions

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names(f"{self.root}/manifests") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{version, tables: {name: {key, bucket, buckets, entries}}}; version 0 has no tables."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if not version:
            return {"version": 0, "tables": {}}
        return json.loads(self._read_text(f"{self.root}/manifests/{version:09}.json"))

    def read(self, name: str, version: int | None = None, buckets: list[int] | None = None, of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame | None:
        """The rows of a table in a version, the last one if none is told; only those of some buckets, if they are told. None: no such table.

        of makes of each entry's rows what is wanted of them, with their key, before changes are merged, so that no others are shuffled.
        """
        table = self.manifest(version)["tables"].get(name)
        if table is None:
            return None
        rows = self._merged(table, buckets, of)
        return rows.drop(BUCKET, "seq_") if table["buckets"] else rows.drop("seq_")

    def kept(self, rows: DataFrame) -> DataFrame:
        """The rows, written beside the tables, so that several plans read them; vacuum() deletes them."""
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _entry_rows(self, table: dict, entry: dict, buckets: list[int] | None, of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        rows = self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{entry['rows']}")
        if entry.get("without"):
            rows = rows.where(~F.col(BUCKET).isin(entry["without"]))
        if buckets is not None and table["buckets"]:
            rows = rows.where(F.col(BUCKET).isin(buckets))
        return (rows if of is None else of(rows)).withColumn("seq_", F.lit(entry["seq"]))

    def _changed(self, table: dict) -> DataFrame | None:
        """(key, last_): of the keys that were changed the last change. The first entry's keys can't be older than anything."""
        first = min(e["seq"] for e in table["entries"])
        found = [self.spark.read.parquet(f"{self.root}/{e['keys']}").withColumn("last_", F.lit(e["seq"])) for e in table["entries"] if e["keys"] and e["seq"] > first]
        if not found:
            return None
        out = found[0]
        for one in found[1:]:
            out = out.unionByName(one)
        return out.groupBy(table["key"]).agg(F.max("last_").alias("last_"))

    def _merged(self, table: dict, buckets: list[int] | None = None, of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        rows = None
        for entry in table["entries"]:
            if entry["rows"]:
                own = self._entry_rows(table, entry, buckets, of)
                rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
        if rows is None:
            none = self.spark.createDataFrame([], table["schema"]).withColumns({BUCKET: F.lit(0)} if table["buckets"] else {})
            return (none if of is None else of(none)).withColumn("seq_", F.lit(0))
        changed = self._changed(table)
        if changed is None:
            return rows
        return rows.join(changed, table["key"], "left").where(F.col("last_").isNull() | (F.col("seq_") >= F.col("last_"))).drop("last_")

    def written_rows(self, change: Change, name: str) -> DataFrame | None:
        """The rows that a change has written to a table; None if none."""
        own = [e for e in change.tables.get(name, {"entries": []})["entries"] if e["seq"] > change.version and e["rows"]]
        return self.spark.read.parquet(f"{self.root}/{own[-1]['rows']}") if own else None

    def change(self) -> Change:
        return Change(self)

    def compact(self, name: str) -> int:
        """Rewrites the buckets that changes have touched, all of a table without buckets, into one entry; the others stay. The new version."""
        change = self.change()
        table = change.tables[name]
        if len(table["entries"]) < 2:
            return change.version
        merged = self._merged(table)
        if table["buckets"]:
            touched = self._touched(table)
            base = table["entries"][0] | {"without": sorted({*table["entries"][0].get("without", []), *touched})}
            merged = merged.where(F.col(BUCKET).isin(touched)).drop("seq_", BUCKET)
            # Keys of changes count no more: every row that they replace was in a bucket that is rewritten.
            table["entries"] = [base | {"keys": None}]
        else:
            merged, table["entries"] = merged.drop("seq_"), []
        change._write(name, table, merged, keys=False)
        return change.commit()

    def _touched(self, table: dict) -> list[int]:
        """The buckets that hold rows of changes, or rows that changes replace."""
        first, *rest = table["entries"]
        buckets = self._entry_rows(table, first, None).select(table["key"], BUCKET)
        changed = self._changed(table)
        gone = buckets.join(changed, table["key"], "left_semi").select(BUCKET) if changed is not None else buckets.limit(0).select(BUCKET)
        for entry in rest:
            if entry["rows"]:
                gone = gone.unionByName(self._entry_rows(table, entry, None).select(BUCKET))
        return sorted(r[0] for r in gone.distinct().collect())  # as many as there are buckets

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes manifests but the last so many, and folders that none of these names. Not while a change is being written."""
        known = self.versions()
        for version in known[:-keep]:
            fs, path = self._path(f"{self.root}/manifests/{version:09}.json")
            fs.delete(path, False)
        named = {e[k] for v in known[-keep:] for t in self.manifest(v)["tables"].values() for e in t["entries"] for k in ("rows", "keys") if e[k]}
        gone = []
        for name in self._names(f"{self.root}/data"):
            if f"data/{name}" not in named:
                fs, path = self._path(f"{self.root}/data/{name}")
                fs.delete(path, True)
                gone.append(name)
        return gone


class Change:
    """Rows to put and keys to remove, in any number of tables; nothing of it counts before commit()."""

    def __init__(self, tables: Tables):
        self.at = tables
        manifest = tables.manifest()
        self.version, self.tables = manifest["version"], manifest["tables"]

    def _folder(self) -> str:
        return f"data/{uuid.uuid4().hex}"

    def _write(self, name: str, table: dict, rows: DataFrame | None, keys: DataFrame | bool = True) -> None:
        entry = {"seq": self.version + 1, "rows": None, "keys": None}
        if rows is not None:
            entry["rows"] = self._folder()
            out = rows
            if table["buckets"]:
                out = rows.withColumn(BUCKET, F.pmod(F.xxhash64(table["bucket"]), F.lit(table["buckets"])).cast("int"))
                # A bucket of one frequent value may be most of all rows: it becomes several files.
                out = out.hint("rebalance", F.col(BUCKET)).sortWithinPartitions(BUCKET, table["bucket"]).write.partitionBy(BUCKET)
            else:
                out = out.write
            out.parquet(f"{self.at.root}/{entry['rows']}")
            table["schema"] = rows.schema.simpleString()[7:-1] if not table.get("schema") else table["schema"]
        if keys is not False:
            entry["keys"] = self._folder()
            own = self.at.spark.read.parquet(f"{self.at.root}/{entry['rows']}") if keys is True else keys
            own.select(table["key"]).distinct().write.parquet(f"{self.at.root}/{entry['keys']}")
        table["entries"].append(entry)

    def upsert(self, name: str, rows: DataFrame, key: str, bucket: str | None = None, buckets: int = 0, several: bool = False, keys: DataFrame | None = None) -> Change:
        """Rows that replace those of their keys. A key has one row, any of those told, or with several all of them.

        keys: those of the rows, and others whose rows go, where they are known; else they are sought among the rows.
        bucket and buckets hold for a new table. No rows: nothing is written.
        """
        table = self.tables.get(name) or {"key": key, "bucket": bucket, "buckets": buckets if bucket else 0, "entries": []}
        if table["key"] != key:
            raise ValueError(f"{name} has the key {table['key']}")
        if not rows.isEmpty():
            self._write(name, table, rows if several else rows.dropDuplicates([key]), True if keys is None else keys)
            self.tables[name] = table
        return self

    def delete(self, name: str, keys: DataFrame) -> Change:
        """Removes the rows of some keys; keys that aren't there do nothing."""
        if name in self.tables and not keys.isEmpty():
            self._write(name, self.tables[name], None, keys)
        return self

    def pending(self, name: str) -> DataFrame | None:
        """The rows of a table as they will be."""
        table = self.tables.get(name)
        return None if table is None else self.at._merged(table).drop("seq_", BUCKET)

    def commit(self, check: Callable[[Change], None] | None = None) -> int:
        """Makes the change count, unless check raises or another was faster. The new version."""
        if check is not None:
            check(self)
        if self.at.manifest()["version"] != self.version:
            raise ChangedMeanwhile(f"version {self.version} isn't the last one any more")
        self.at._write_text(json.dumps({"version": self.version + 1, "tables": self.tables}), f"{self.at.root}/manifests/{self.version + 1:09}.json")
        return self.version + 1


def buckets_of(values: DataFrame, column: str, buckets: int) -> list[int]:
    """The buckets that values of a bucket column lie in."""
    own: Column = F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")
    return sorted(r[0] for r in values.select(own).distinct().collect())
