"""SQL-database source (#7): read only the needed columns and rows,
split into parallel range reads on a numeric column."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def jdbc_query(table: str, columns: Sequence[str] | None = None, where: str | None = None) -> str:
    """The sub-query handed to the database: projection and predicate run
    there, so only needed columns and rows cross the wire."""
    cols = ", ".join(columns) if columns else "*"
    sql = f"SELECT {cols} FROM {table}"
    if where:
        sql += f" WHERE {where}"
    return f"({sql}) tw_src"


def load_jdbc(spark: SparkSession, url: str, *, table: str,
              columns: Sequence[str] | None = None, where: str | None = None,
              partition_column: str | None = None, lower_bound: int | None = None,
              upper_bound: int | None = None, num_partitions: int = 16,
              fetch_size: int = 10_000, properties: dict[str, str] | None = None,
              **options: Any) -> DataFrame:
    """``spark.read.jdbc`` of ``table`` with projection and predicate.

    With ``partition_column`` the read is split into ``num_partitions``
    range queries over ``[lower_bound, upper_bound]`` (bounds only set the
    stride; rows outside them are still read by the first/last range).
    """
    reader = (spark.read.format("jdbc")
              .option("url", url)
              .option("dbtable", jdbc_query(table, columns, where))
              .option("fetchsize", str(fetch_size)))
    if partition_column:
        if lower_bound is None or upper_bound is None:
            raise ValueError("partition_column needs lower_bound and upper_bound")
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", str(lower_bound))
                  .option("upperBound", str(upper_bound))
                  .option("numPartitions", str(num_partitions)))
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    return reader.options(**options).load()
