"""Sinks: staged tables, exports, upserts, week replacement, status updates."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Whether a query's shuffle files go when it ends; another query of the same frame makes them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage_folder(spark: SparkSession) -> str:
    """Folder for staged tables that all executors share: spark.checkpoint.dir, or else the context's checkpoint folder.

    Where neither is set an own folder is made in local mode only; on a cluster that is an error."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = context.getCheckpointDir()
    return base.rstrip("/")


def reread(df: DataFrame, name: str) -> DataFrame:
    """df written as a staged Parquet table, and read. What was shuffled for it goes with the end of the write, not when the
    driver happens to collect its garbage, so that steps in turn don't add up on disk."""
    path, conf = f"{stage_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}", df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged.saved_at = path
    return staged


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, results not yet computed included."""
    for df in staged:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def compiled(spark: SparkSession) -> None:
    """Rows of many columns go through functions that the JVM compiles: one of more than 8,000 bytes, which a stage of such
    rows makes, would be interpreted for each row. Holds for plans that are run from now on."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and quotes doubled inside quoted cells."""
    df.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def export_rows(df: DataFrame, names: Mapping[str, str], percents: Sequence[str] = ()) -> DataFrame:
    """Columns under their export names; shares as percent texts with one decimal."""
    cell = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.1f%%", F.col(c) * 100)) if c in percents else F.col(c)
    return df.select(*(cell(c).alias(name) for c, name in names.items()))


def import_rows(df: DataFrame, status: Column) -> DataFrame:
    """Rows of an upload with key and name, trimmed, money as a number and status by a mapping."""
    cut = df.select(F.trim("project_key").alias("project_key"), F.trim("project_name").alias("project_name"), F.regexp_replace("amount", "[^0-9.\\-]", "").try_cast("decimal(18,2)").alias("amount"), status.alias("status"))
    return cut.filter("project_key <> '' and project_name <> ''")


def upsert(old: DataFrame, new: DataFrame, key: str, order: Sequence[Column | str] = ()) -> DataFrame:
    """Rows of old, replaced or joined by those of new; of several new rows for a key the first by order is taken."""
    if order:
        new = new.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")
    return old.join(new.select(key), key, "left_anti").unionByName(new.select(*old.columns))


def keep_batch_keys(old: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of old whose key is in the batch; the others are stale."""
    return old.join(batch.select(key).distinct(), key, "left_semi")


def replace_weeks(df: DataFrame, path: str) -> bool:
    """Write rows by week_of: weeks in df are replaced as a whole, others stay.

    A frame without rows is refused, so that no week is cleared by mistake: nothing changes, and False is returned."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week_of").parquet(path)
    return True


def apply_reports(projects: DataFrame, reports: DataFrame) -> DataFrame:
    """Status of each project from its latest report; a completed one also gets the day of the report."""
    last = reports.groupBy("project_key").agg(F.max_by(F.struct("status_observed", "observed_at"), F.struct("observed_at", "report_id")).alias("_r"))
    joined = projects.join(last, "project_key", "left")
    done = F.when(F.col("_r.status_observed") == "Completed", F.col("_r.observed_at").cast("date"))
    return joined.withColumn("completed_on", F.coalesce(done, "completed_on")).withColumn("status", F.coalesce("_r.status_observed", "status")).drop("_r")


def merged_schema(spark: SparkSession, path: str) -> DataFrame:
    """A table whose files differ in columns; those that a file lacks are null."""
    return spark.read.option("mergeSchema", True).parquet(path)
