"""Term indexes and many-file collections as table sources."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..operators.postings import TermIndex
from ..operators.postings import read_index as _read_index


def read_index(spark: SparkSession, path: str) -> TermIndex:
    """Open a stored index; see ``operators.postings.write_index``."""
    return _read_index(spark, path)


def read_many(spark: SparkSession, read, paths: Sequence[str]) -> DataFrame:
    """Several files and folders as one collection."""
    return reduce(DataFrame.unionByName, (read(spark, path) for path in paths))
