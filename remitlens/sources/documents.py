"""Policy exports, policy chunks, letters, uploads and context files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlens.schema import CLAIM_CONTEXT_SCHEMA, DENIAL_CASE_SCHEMA, MANIFEST_SCHEMA

# White space as Python's text functions see it.
SPACE = r"[\s\x1c-\x1f\x85\xa0]"


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"(?U){SPACE}+", " "))


def scan_policy_csv(spark: SparkSession, path: str) -> DataFrame:
    """Latin-1 export whose quoted fields hold HTML over several lines."""
    return (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("encoding", "ISO-8859-1")
        .option("quote", '"')
        .option("escape", '"')
        .option("maxCharsPerColumn", -1)
        .csv(path)
    )


def strip_chunk_header(text: Column) -> Column:
    """Drop the metadata lines in front of a chunk, up to the first blank line or
    the first line of another kind. A chunk of nothing else is kept as it is."""
    body = F.trim(
        F.regexp_replace(
            text,
            r"^(?:(?:source|source_id|version|title|chunk):[^\n]*(?:\n|$))*(?:[ \t]*(?:\n|$))?",
            "",
        )
    )
    trimmed = F.regexp_replace(body, r"^\s+|\s+$", "")
    return F.when(trimmed == "", text).otherwise(trimmed)


def _plain_path(path: Column) -> Column:
    """A path without its scheme, so listed and found paths compare equal."""
    return F.regexp_replace(path, r"^[A-Za-z0-9]+:/+", "/")


def scan_policy_chunks(spark: SparkSession, manifest: str, root: str) -> DataFrame:
    """Manifest rows with their chunk text; missing and blank files are skipped.

    ``file_path`` is taken under ``root`` unless it is absolute."""
    rows = spark.read.option("header", True).schema(MANIFEST_SCHEMA).csv(manifest)
    files = (
        spark.read.option("recursiveFileLookup", True)
        .text(root, wholetext=True)
        .select(
            _plain_path(F.col("_metadata.file_path")).alias("found"),
            F.regexp_replace("value", r"^\s+|\s+$", "").alias("text"),
        )
        .where("text <> ''")
    )
    absolute = F.col("file_path").rlike(r"^(/|[A-Za-z0-9]+:/)")
    listed = F.when(absolute, F.col("file_path")).otherwise(
        F.concat(F.lit(root.rstrip("/") + "/"), F.col("file_path"))
    )
    named = rows.withColumn("found", _plain_path(listed))
    return named.join(files, "found").select(
        *MANIFEST_SCHEMA.names, strip_chunk_header(F.col("text")).alias("body")
    )


def letter_text(content: Column, name: Column) -> Column:
    """Readable text of an uploaded file: UTF-8 without its bad bytes, else Latin-1,
    white space collapsed; nothing left names the file."""
    utf8 = F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))
    text = collapse_space(utf8)
    fallback = collapse_space(F.decode(content, "ISO-8859-1"))
    any_text = F.coalesce(F.nullif(text, F.lit("")), F.nullif(fallback, F.lit("")))
    return F.when(F.length(content) == 0, "").otherwise(
        F.coalesce(any_text, F.concat(F.lit("Uploaded file: "), name))
    )


def scan_letters(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path``, ``filename`` and ``extracted_text`` of every letter file, one file a letter."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(path)
    )
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(
        "path", name.alias("filename"), letter_text(F.col("content"), name).alias("extracted_text")
    )


def scan_upload(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded claim table as text, empty cells as ''. Lines that do not fit the
    header are kept whole in ``_corrupt_record``."""
    header = spark.read.option("header", True).csv(path).columns
    ddl = ", ".join(f"`{c}` string" for c in [*header, "_corrupt_record"])
    return (
        spark.read.option("header", True)
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .schema(ddl)
        .csv(path)
        .na.fill("", subset=header)
    )


def scan_claim_context(spark: SparkSession, path: str) -> DataFrame:
    """One row per scenario of a context file; a missing scenario has no row."""
    raw = spark.read.schema(CLAIM_CONTEXT_SCHEMA).option("multiLine", True).json(path)
    both = raw.select(
        F.explode(
            F.create_map(
                F.lit("2"), F.col("scenario_2"), F.lit("3"), F.col("scenario_3")
            )
        ).alias("scenario", "context")
    )
    return both.where(F.col("context").isNotNull())


def scan_denial_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DENIAL_CASE_SCHEMA).option("multiLine", True).json(path)
