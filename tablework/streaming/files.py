"""File streams in, tables out."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablework.sources.files import _TEXT_TS, CSV_QUOTES


def stream_table(spark: SparkSession, path: str, kind: str, schema: T.StructType | str, *,
                 max_files_per_trigger: int | None = None, header: bool = True,
                 sep: str = ",", **options: Any) -> DataFrame:
    """Files arriving under ``path`` as a streaming DataFrame (the schema
    is required: a stream cannot be inferred)."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    kind = kind.lower()
    if kind in ("csv", "tsv"):
        r = r.options(**_TEXT_TS).options(**CSV_QUOTES).option("header", header).option("sep", "\t" if kind == "tsv" else sep)
        return r.options(**options).csv(path)
    if kind == "json":
        return r.options(**_TEXT_TS).options(**options).json(path)
    if kind == "parquet":
        return r.options(**options).parquet(path)
    if kind == "text":
        return r.options(**options).text(path)
    raise ValueError(f"unsupported stream kind {kind!r}")


def write_stream(df: DataFrame, path: str, *, output_mode: str = "append",
                 checkpoint_location: str | None = None, available_now: bool = True,
                 query_name: str | None = None) -> StreamingQuery:
    """Start a stream into a Parquet table at ``path``.

    ``append``: new rows are appended (exactly-once file sink).
    ``complete``: each micro-batch's whole result replaces the table
    (``foreachBatch`` overwrite), the form a roll-up needs. ``update`` batches
    hold changed rows only and would lose the others, so it is refused. The
    checkpoint lies beside the table unless given, so a stream that is started
    again goes on where it ended.
    """
    if output_mode not in ("append", "complete"):
        raise ValueError("output_mode must be 'append' or 'complete'")
    ckpt = checkpoint_location or path.rstrip("/") + "__checkpoint"
    w = df.writeStream.option("checkpointLocation", ckpt).outputMode(output_mode)
    if query_name:
        w = w.queryName(query_name)
    if available_now:
        w = w.trigger(availableNow=True)
    if output_mode == "append":
        return w.format("parquet").start(path)

    def overwrite(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return w.foreachBatch(overwrite).start()
