"""All queries of the library by inventory name, and the SQL that each is checked against."""

from . import cleaning_queries, features_queries, linkage_queries, modelling_queries, publishing_queries, reports_queries, series_queries, streams_queries, target_queries  # noqa: F401
from .register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
