"""Stores: ledgers and results by run, chunks and datasets by key, on any file system that Spark writes to."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from plumbline.operators.aggregate import ALL
from plumbline.sources.versions import Tables

#: Changes of a table by key after which they are merged into it, and versions that are kept then.
MANY_CHANGES = 8


def merged(old: DataFrame | None, new: DataFrame, key: str) -> DataFrame:
    """old with new rows added and rows of the same key replaced; of equal keys in new one stays."""
    new = new.dropDuplicates([key])
    return new if old is None else old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


class Store:
    """root/ledger, root/runs and root/samples are partitioned by run_id; writing a run replaces that run only."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.tables = Tables(spark, f"{self.root}/tables")

    def _read(self, table: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.root}/{table}")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" in str(missing):
                return None
            raise

    def _replace(self, df: DataFrame, table: str, by: str = "run_id") -> None:
        df.write.partitionBy(by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.root}/{table}")

    def save_snapshot(self, snapshot: DataFrame, run_id: str, status: str = "running") -> None:
        """The run's settings (one row) as JSON, with its status."""
        self._replace(snapshot.select(F.to_json(F.struct("*")).alias("snapshot"), F.lit(status).alias("status"), F.lit(run_id).alias("run_id")), "runs")

    def save_result(self, ledger: DataFrame, samples: DataFrame | None, snapshot: DataFrame, run_id: str) -> None:
        """A run's ledger rows and samples, domains included; what was there of the run goes."""
        self._replace(ledger, "ledger")
        if samples is not None:
            self._replace(samples.withColumn("run_id", F.lit(run_id)), "samples")
        self.save_snapshot(snapshot, run_id, "done")

    def load_baseline(self, run_id: str) -> DataFrame | None:
        """The ledger rows of a run, in order of metric, k and layer; None if there are none."""
        found = self._read("ledger")
        rows = None if found is None else found.where(F.col("run_id") == run_id)
        return None if rows is None or rows.isEmpty() else rows.orderBy("metric", F.coalesce("k", F.lit(-1)), "layer", "type_bucket", "domain_bucket")

    def load_totals(self, run_id: str) -> DataFrame | None:
        """A baseline's values over all samples, as diff() takes them."""
        rows = self.load_baseline(run_id)
        return None if rows is None else rows.where((F.col("type_bucket") == ALL) & (F.col("domain_bucket") == ALL))

    def load_snapshot(self, run_id: str, schema: str | StructType) -> DataFrame | None:
        runs = self._read("runs")
        return None if runs is None else runs.where(F.col("run_id") == run_id).select(F.from_json("snapshot", schema).alias("s")).select("s.*")

    def load_samples(self, run_id: str) -> DataFrame | None:
        """A run's values by sample, as they were saved."""
        found = self._read("samples")
        rows = None if found is None else found.where(F.col("run_id") == run_id)
        return None if rows is None or rows.isEmpty() else rows.drop("run_id")

    def load(self, table: str) -> DataFrame | None:
        """The newest whole version of a table by key; None if there is none."""
        return self.tables.read(table)

    def upsert(self, rows: DataFrame, table: str, key: str) -> DataFrame:
        """Rows by key into a table of the store; of equal keys among them one stays.

        Only what changes is written, and counts once it is whole, so a crash at any time leaves the last whole version.
        Changes are merged as soon as there are many.
        """
        self.tables.change().upsert(table, rows, key).commit()
        if len(self.tables.manifest()["tables"].get(table, {"entries": []})["entries"]) > MANY_CHANGES:
            self.tables.compact(table)
            self.tables.vacuum(MANY_CHANGES)
        return self.load(table)


class JsonStore:
    """Runs as one JSON file each: a light store without baselines, for results of aggregated size."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, run_id: str, snapshot: DataFrame, buckets: DataFrame) -> str:
        from plumbline.plans.report import write_text

        rows = lambda df: [json.loads(x) for x in df.toJSON().collect()]
        path = f"{self.root}/{run_id}.json"
        write_text(self.spark, json.dumps({"run_id": run_id, "snapshot": rows(snapshot)[0], "metrics": rows(buckets)}, ensure_ascii=False, sort_keys=True), path)
        return path

    def load(self, run_id: str) -> dict | None:
        try:
            return json.loads(self.spark.read.text(f"{self.root}/{run_id}.json", wholetext=True).first()[0])
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" in str(missing):
                return None
            raise
