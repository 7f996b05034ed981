"""Result tables, summaries, metrics, chunks, models and reports on storage."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_summary(df: DataFrame, path: str, order_by: list | None = None) -> None:
    """One ordered CSV file with a header. Only for aggregates of a few rows."""
    if order_by:
        df = df.orderBy(*order_by)
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_metrics(metrics: DataFrame, operating: DataFrame, folder: str) -> None:
    write_summary(metrics, f"{folder}/metrics")
    write_summary(operating, f"{folder}/operating_table", ["point"])


def write_policy_chunks(chunks: DataFrame, path: str) -> None:
    """Chunk text and manifest in one table, a folder per source."""
    write_table(chunks, path, partition_by=["source"])


def write_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def write_report(report: DataFrame, path: str) -> None:
    """Report lines in order as one text file."""
    lines = report.orderBy("section", "line").select("text")
    lines.coalesce(1).write.mode("overwrite").text(path)
