"""Rows for the published project table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import status_in_order, without_nan
from .reports import tier


def project_rows(projects: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per key with cleaned fields; a project without a score keeps nulls."""
    rows = without_nan(projects).join(scores, "project_key", "left")
    return rows.select(
        "project_key",
        F.left("project_name", F.lit(200)).alias("project_name"),
        F.col("amount").cast("decimal(18,2)").alias("amount"),
        status_in_order("status").alias("status"),
        F.date_format("released", "yyyy-MM-dd").alias("released_on"),
        F.col("prob").alias("risk_probability"),
        tier("prob").alias("risk_tier"),
    )
