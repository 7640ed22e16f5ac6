"""Each report once, whenever it comes, with bounded state.

Ids that arrived lately are kept as state under a watermark on the time of arrival, which no report is late for. Older ones are in a
table of ids by the day of the report, on which a batch is anti-joined: a report that comes again has the same day, so only days of
the batch are read. A late report that comes for the first time is in neither, so it is kept."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids of reports without a time lie in so many parts by hash.
UNDATED = 64


def recent(reports: DataFrame, keep: str = "1 hour") -> DataFrame:
    """Reports but for those whose id arrived within `keep` before; state holds the ids of about that time only."""
    return reports.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", keep).dropDuplicatesWithinWatermark(["report_id"]).drop("_arrived")


def slot() -> Column:
    """Part of the id table: the day of the report, or one by hash where it has no time."""
    undated = F.concat(F.lit("none-"), F.pmod(F.xxhash64("report_id"), F.lit(UNDATED)).cast("string"))
    return F.coalesce(F.col("observed_at").cast("date").cast("string"), undated)


class Once:
    """A foreachBatch sink that writes the reports of a batch which no earlier batch had, and then their ids.

    Both are written under the number of the batch, so a batch that is run again writes the same: its own ids aren't
    held against it. Rows of one id with different times count as one report only if they come within what `recent` keeps."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def __call__(self, batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(["report_id"]).withColumn("_slot", slot())
        slots = [r[0] for r in new.select("_slot").distinct().collect()]  # days of a batch
        known = self.ids(slots, number)
        if known is not None:
            new = new.join(known, ["_slot", "report_id"], "left_anti")
        new.drop("_slot").write.mode("overwrite").parquet(f"{self.path}/reports/number={number}")
        written = self.spark.read.schema(batch.schema).parquet(f"{self.path}/reports/number={number}")
        for_ids = written.select("report_id", slot().alias("_slot"), F.lit(number).alias("number")).repartition("_slot")
        for_ids.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_slot", "number").parquet(f"{self.path}/ids")

    def ids(self, slots: list[str], number: int) -> DataFrame | None:
        """Ids of these days in batches before; None if there are none. Folders of other days are neither listed nor read."""
        if not slots:
            return None
        try:
            rows = self.spark.read.option("basePath", f"{self.path}/ids").schema("report_id long, _slot string, number long").parquet(f"{self.path}/ids/_slot={{{','.join(slots)}}}/number=*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        # small in files and large in memory: a broadcast by the size of the files would send all ids through the driver
        return rows.filter(F.col("number") < number).select("_slot", "report_id").distinct().hint("shuffle_merge")

    def delivered(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/reports").schema(f"{self.schema}, number long").parquet(f"{self.path}/reports/number=*")
