"""Results of many runs kept side by side as Parquet, partitioned by run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

# The five collections of a run.
COLLECTIONS = ("demand_data", "forecasts", "suppliers", "inventory", "analysis_metadata")
# Beside them: which runs were stored to the end.
MARKS = "finished_runs"
ARRAY_FIELDS = ("forecast_values", "lower_ci", "upper_ci")


def new_run_id(now: datetime | None = None) -> str:
    return (now or datetime.now()).strftime("%Y%m%d%H%M%S")


def encode_arrays(df: DataFrame, columns: Sequence[str] = ARRAY_FIELDS) -> DataFrame:
    """Array columns as JSON text."""
    return df.withColumns({c: F.to_json(c) for c, kind in df.dtypes if c in columns and kind.startswith("array")})


def decode_arrays(df: DataFrame, columns: Sequence[str] = ARRAY_FIELDS) -> DataFrame:
    """JSON text columns as arrays of doubles."""
    return df.withColumns(
        {c: F.from_json(c, "array<double>") for c, kind in df.dtypes if c in columns and kind == "string"}
    )


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The rows whose key equals a value."""
    return df.where(F.col(key) == F.lit(value))


def sample_rows(df: DataFrame, order: Sequence[Column | str], limit: int = 100) -> DataFrame:
    """The first rows of a collection in a stated order."""
    return df.orderBy(*order).limit(limit)


def stamped(df: DataFrame, run_id: str, stored_at: datetime | None = None) -> DataFrame:
    """A result with its run and the time it was stored."""
    when = F.lit(stored_at or datetime.now()).cast("timestamp")
    return df.withColumns({"run_id": F.lit(run_id), "stored_at": when})


def read_demand(stored: DataFrame, category: str | None = None, limit: int = 1000) -> DataFrame:
    """Stored demand, newest first."""
    chosen = stored if category is None else stored.where(F.col("product_category_name") == category)
    return chosen.orderBy(F.desc("stored_at"), "product_category_name", "date").limit(limit)


def read_forecasts(stored: DataFrame, category: str | None = None, run_id: str | None = None) -> DataFrame:
    """Stored forecasts, newest first, with arrays decoded."""
    chosen = stored if category is None else stored.where(F.col("category") == category)
    chosen = chosen if run_id is None else chosen.where(F.col("run_id") == run_id)
    return decode_arrays(chosen).orderBy(F.desc("stored_at"), "category")


def read_suppliers(stored: DataFrame, tier: int | None = None, run_id: str | None = None) -> DataFrame:
    """Stored sellers, optionally of one tier and run."""
    chosen = stored if tier is None else stored.where(F.col("prediction") == tier)
    return chosen if run_id is None else chosen.where(F.col("run_id") == run_id)


def read_inventory(stored: DataFrame, category: str | None = None, run_id: str | None = None) -> DataFrame:
    """Stored recommendations; the category may be in either of two columns."""
    chosen = stored
    if category is not None:
        chosen = chosen.where((F.col("product_category") == category) | (F.col("category") == category))
    return chosen if run_id is None else chosen.where(F.col("run_id") == run_id)


def recent_runs(stored: DataFrame, limit: int = 10) -> DataFrame:
    """Metadata of the newest runs."""
    return stored.orderBy(F.desc("stored_at"), F.desc("run_id")).limit(limit)


def partition_folder(run_id: str) -> str:
    """Folder of a run inside a collection, escaped as the partitioned writer does; ids that could leave it are refused."""
    if not run_id or "/" in run_id or "\\" in run_id or run_id in (".", ".."):
        raise ValueError(f"not a run id: {run_id!r}")
    special = set("\"#%'*:=?{[]^\x7f") | {chr(c) for c in range(1, 32)}
    return "run_id=" + "".join(f"%{ord(c):02X}" if c in special else c for c in run_id)


class RunStore:
    """The five collections below one folder. Reads of one run touch that run's folder only.

    A run is stored as a whole by `store_run`: its mark is written after its last collection, and `finished` shows marked
    runs alone. Writing a collection of a run again replaces what the run holds there, so a repeated attempt leaves one
    copy. One writer at a time per run.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, collection: str) -> str:
        if collection not in COLLECTIONS:
            raise ValueError(f"unknown collection {collection!r}")
        return f"{self.root}/{collection}"

    def store(self, collection: str, df: DataFrame, run_id: str, stored_at: datetime | None = None) -> int:
        """Put a result under its run, in place of an earlier one of the same run; returns the number of rows there now."""
        partition_folder(run_id)
        if collection in [n for n in COLLECTIONS if self._exists(n)]:
            self._empty(collection, run_id)
        self._write(stamped(encode_arrays(df), run_id, stored_at), self.path(collection))
        return self.collection(collection).where(F.col("run_id") == run_id).count()

    def store_run(self, run_id: str, results: Mapping[str, DataFrame], stored_at: datetime | None = None) -> dict[str, int]:
        """Store the collections of a run and mark it as finished; a run whose mark is missing was broken off."""
        rows = {name: self.store(name, df, run_id, stored_at) for name, df in results.items()}
        mark = stamped(self.spark.createDataFrame([(len(rows),)], "collections int"), run_id, stored_at)
        self._write(mark, f"{self.root}/{MARKS}")
        return rows

    def finished_runs(self) -> DataFrame:
        """Run id, number of collections and storing time of every finished run."""
        if not self._exists(MARKS):
            return self.spark.createDataFrame([], "collections int, stored_at timestamp, run_id string")
        return self._read(f"{self.root}/{MARKS}")

    def finished(self, collection: str) -> DataFrame:
        """A collection without the rows of runs that were broken off."""
        return self.collection(collection).join(self.finished_runs().select("run_id"), "run_id", "left_semi")

    @staticmethod
    def _write(rows: DataFrame, path: str) -> None:
        """Replace the partitions of the runs in `rows` and no others."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)

    def _empty(self, collection: str, run_id: str) -> None:
        """Leave a run's partition without rows, if it has any. The folder is written over, so no file system is asked."""
        rows = self._read(f"{self.root}/{collection}").where(F.col("run_id") == run_id)
        if not rows.isEmpty():
            nothing = self.spark.createDataFrame([], rows.drop("run_id").schema)
            nothing.write.mode("overwrite").parquet(f"{self.root}/{collection}/{partition_folder(run_id)}")

    def collection(self, collection: str) -> DataFrame:
        """A whole collection; run ids stay the text they were stored as, `007` included."""
        return self._read(self.path(collection))

    def _read(self, path: str) -> DataFrame:
        setting = "spark.sql.sources.partitionColumnTypeInference.enabled"
        before = self.spark.conf.get(setting)
        self.spark.conf.set(setting, "false")
        try:
            return self.spark.read.parquet(path)
        finally:
            self.spark.conf.set(setting, before)

    def _exists(self, collection: str) -> bool:
        try:
            self.spark.read.parquet(f"{self.root}/{collection}").limit(0)
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return False
            raise
        return True

    def counts(self, run_id: str) -> DataFrame:
        """Rows a run holds per collection."""
        parts = []
        for name in COLLECTIONS:
            n = (
                self.collection(name).where(F.col("run_id") == run_id).agg(F.count(F.lit(1)).alias("n"))
                if self._exists(name) else self.spark.range(1).select(F.lit(0).cast("long").alias("n"))
            )
            parts.append(n.select(F.lit(name).alias("collection"), "n"))
        return reduce(DataFrame.unionByName, parts)

    def delete_run(self, run_id: str) -> DataFrame:
        """Empty a run's partition in every collection and return the rows removed per collection.

        The counts are taken before anything is removed, and the run's mark goes first. Other partitions are left untouched.
        """
        partition_folder(run_id)
        removed = self.spark.createDataFrame(self.counts(run_id).collect(), "collection string, n long")
        for name in (n for n in (MARKS, *COLLECTIONS) if self._exists(n)):
            self._empty(name, run_id)
        return removed


def metadata_frame(
    spark: SparkSession, run_id: str, parameters: dict[str, object], environment: dict[str, object] | None = None
) -> DataFrame:
    """One row describing a run: parameters and environment as text maps."""
    texts = lambda d: {k: str(v) for k, v in (d or {}).items()}
    row = (run_id, datetime.now(), texts(parameters), {"engine": f"spark {spark.version}", **texts(environment)})
    return spark.createDataFrame(
        [row],
        "run_id string, timestamp timestamp, parameters map<string,string>, execution_environment map<string,string>",
    )


def log_metrics(metrics: DataFrame, path: str, at: datetime | None = None) -> None:
    """Append metric rows as JSON lines (timestamp, metrics)."""
    moment = (at or datetime.now()).strftime("%Y-%m-%d %H:%M:%S")
    metrics.select(F.lit(moment).alias("timestamp"), F.struct(*metrics.columns).alias("metrics")).write.mode(
        "append").json(path)
