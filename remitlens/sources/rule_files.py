"""Coding-rule files: fixed-width, CSV and TSV releases to typed tables."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remitlens.functions.claims import present
from remitlens.schema import (
    ARTICLE_HCPCS_SCHEMA,
    ARTICLE_ICD10_SCHEMA,
    MUE_FILE_SCHEMA,
    PTP_FILE_SCHEMA,
)

PERIOD_START, PERIOD_END = "2008-01-01", "2010-12-31"
MUE_PREAMBLE, PTP_PREAMBLE = 9, 6


def _fixed(name: str, start: int, end: int) -> Column:
    """Zero-based, end-exclusive positions of a text line."""
    return present(F.substring("value", start + 1, end - start)).alias(name)


def _day(value: Column) -> Column:
    return F.try_to_timestamp(value, F.lit("yyyyMMdd")).cast("date")


def _any_day(value: Column) -> Column:
    """Dates come compact or with separators; anything else is unknown."""
    formats = ("yyyyMMdd", "yyyy-MM-dd", "M/d/yyyy")
    text = F.trim(value)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("date")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "")


def read_hcpcs(spark: SparkSession, path: str, cutoff: str = PERIOD_END) -> DataFrame:
    """Procedure codes in force by ``cutoff``; deleted, terminated or expired
    codes are marked as not covered."""
    end = F.to_date(F.lit(cutoff))
    parsed = _lines(spark, path).select(
        _fixed("hcpcs_code", 0, 5),
        _fixed("long_desc", 6, 126),
        _fixed("short_desc", 126, 180),
        _fixed("action_code", 292, 293),
        _day(_fixed("e", 276, 284)).alias("effective_date"),
        _day(_fixed("t", 284, 292)).alias("termination_date"),
    )
    gone = F.col("action_code").isin("D", "T")
    return parsed.where(
        F.col("effective_date").isNull() | (F.col("effective_date") <= end)
    ).withColumn(
        "is_noncovered",
        F.coalesce(gone, F.lit(False))
        | F.coalesce(F.col("termination_date") <= end, F.lit(False)),
    )


def _body_lines(
    spark: SparkSession, path: str, pattern: str, preamble: int, recursive: bool
) -> DataFrame:
    """(file, value) lines after each file's preamble.

    Files are read in splits, line by line. Line ids rise within a split, so the ids
    of a file's first split, less its smallest, count its lines from the top; one row
    per file is joined back to leave the preamble out. Lines that are not UTF-8 are
    read as Latin-1. Hidden files are skipped by the file source.
    """
    lines = (
        spark.read.option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", recursive)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_name").alias("name"),
            (F.col("_metadata.file_block_start") == 0).alias("top"),
            F.monotonically_increasing_id().alias("id"),
            "value",
        )
    )
    first = lines.where("top").groupBy("path").agg(F.min("id").alias("first"))
    text = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(
        F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    )
    body = ~F.col("top") | (F.col("id") - F.col("first") >= preamble)
    return (
        lines.join(first, "path", "left")
        .where(body & (F.trim("value") != ""))
        .select(F.regexp_extract("name", r"^(.+)\.[^.]*$", 1).alias("file"), text.alias("value"))
    )


def read_mue(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Unit limits of all variants; a limit that is no number is NULL."""
    lines = _body_lines(spark, path, pattern, MUE_PREAMBLE, recursive=False)
    row = F.from_csv("value", MUE_FILE_SCHEMA.simpleString()[7:-1].replace(":", " "))
    return lines.select("file", row.alias("r")).select(
        F.trim("r.hcpcs_code").alias("hcpcs_code"),
        F.trim("r.mue_value").try_cast("double").alias("mue_value"),
        F.col("r.adjudication_indicator").alias("adjudication_indicator"),
        F.col("file").alias("variant"),
    )


def read_ptp(
    spark: SparkSession,
    path: str,
    pattern: str = "*.txt",
    start: str = PERIOD_START,
    end: str = PERIOD_END,
) -> DataFrame:
    """Code-pair edits in force at some time between ``start`` and ``end``."""
    lines = _body_lines(spark, path, pattern, PTP_PREAMBLE, recursive=True)
    row = F.from_csv(
        "value", PTP_FILE_SCHEMA.simpleString()[7:-1].replace(":", " "), {"sep": "\t"}
    )
    edits = lines.select(row.alias("r")).select(
        F.trim("r.code1").alias("code1"),
        F.trim("r.code2").alias("code2"),
        F.trim("r.modifier").alias("modifier"),
        _any_day(F.col("r.effective_date")).alias("effective_date"),
        _any_day(F.col("r.deletion_date")).alias("deletion_date"),
        F.col("r.rationale").alias("rationale"),
    )
    return edits.where(
        (F.col("effective_date") <= F.to_date(F.lit(end)))
        & (
            F.col("deletion_date").isNull()
            | (F.col("deletion_date") >= F.to_date(F.lit(start)))
        )
    )


def read_drg_history(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).select(
        _fixed("drg_code", 0, 3),
        _fixed("w", 3, 9).try_cast("double").alias("weight_hist"),
        _fixed("a", 9, 12).try_cast("double").alias("alos_hist"),
        _fixed("trim_point", 12, 15),
    )


# What a header of the stay table may contain, and the column it becomes.
TABLE5_HEADERS = [
    ("drg", "drg_code"),
    ("weight", "weight"),
    ("geometric", "geometric_mean_los"),
    ("arithmetic", "arithmetic_mean_los"),
]


def read_drg_table5(
    spark: SparkSession, folder: str, pattern: str = "*[Tt]able*5*.tsv"
) -> DataFrame | None:
    """All matching files, which must have the same header; None where there are none.
    Columns are found by words in their header. Where two headers match the same word
    the first is taken."""
    names = spark.read.option("pathGlobFilter", pattern).text(folder).inputFiles()
    if not names:
        return None
    # a file with another header is an error, not a row of wrong columns
    reader = spark.read.option("sep", "\t").option("header", True).option("enforceSchema", False)
    raw = reader.csv([unquote(n) for n in sorted(names)])
    target: dict[str, str] = {}
    for header in raw.columns:
        for word, name in TABLE5_HEADERS:
            if word in header.strip().lower():
                target.setdefault(name, header)
                break
    columns = [F.trim(F.col(f"`{target['drg_code']}`")).alias("drg_code")]
    for name in ("weight", "geometric_mean_los"):
        value = F.col(f"`{target[name]}`").try_cast("double") if name in target else F.lit(None)
        columns.append(value.cast("double").alias(name))
    if "arithmetic_mean_los" in target:
        columns.append(F.col(f"`{target['arithmetic_mean_los']}`").alias("arithmetic_mean_los"))
    return raw.select(*columns)


def merge_drg(history: DataFrame | None, table5: DataFrame | None) -> DataFrame:
    """One row per code: the stay table's weight wins over the historical one."""
    if history is None and table5 is None:
        raise FileNotFoundError("no DRG files")
    if table5 is None:
        merged = history.withColumnRenamed("weight_hist", "weight")
    elif history is None:
        merged = table5
    else:
        merged = history.join(table5, "drg_code", "full_outer").withColumn(
            "weight", F.coalesce("weight", "weight_hist")
        ).drop("weight_hist")
    rest = [c for c in merged.columns if c != "drg_code"]
    return merged.groupBy("drg_code").agg(*[F.max(c).alias(c) for c in rest])


def pick_column(columns: list[str], candidates: list[str]) -> str | None:
    by_name = {c.strip().lower(): c for c in columns}
    return next((by_name[c] for c in candidates if c in by_name), None)


def _links(
    spark: SparkSession, path: str, schema: T.StructType, candidates: dict[str, list[str]]
) -> DataFrame:
    empty = spark.createDataFrame([], schema)
    try:
        raw = spark.read.option("header", True).csv(path)
    except Exception as error:  # a missing file is an empty table
        if "PATH_NOT_FOUND" in str(error):
            return empty
        raise
    chosen = {name: pick_column(raw.columns, names) for name, names in candidates.items()}
    if None in chosen.values():
        return empty
    return raw.select(*[F.col(f"`{source}`").alias(name) for name, source in chosen.items()])


def read_article_hcpcs(spark: SparkSession, path: str) -> DataFrame:
    return _links(
        spark,
        path,
        ARTICLE_HCPCS_SCHEMA,
        {"article_id": ["article_id"], "hcpcs_code": ["hcpcs_code", "hcpc_code", "hcpc_code_id"]},
    )


def read_article_icd10(spark: SparkSession, path: str) -> DataFrame:
    return _links(
        spark,
        path,
        ARTICLE_ICD10_SCHEMA,
        {"article_id": ["article_id"], "icd10_code": ["icd10_code", "icd10_code_id"]},
    )
