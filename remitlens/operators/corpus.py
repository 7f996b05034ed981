"""Policy corpus: HTML exports to cleaned, filtered, chunked text."""

from __future__ import annotations

import html
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remitlens.sources.documents import collapse_space

CHUNK_SIZE, CHUNK_OVERLAP = 1400, 180

# Default topics of the corpus (fixed values).
TOPICS = [
    "drg 207",
    "respiratory",
    "ventilator",
    "ventilation",
    "pneumonia",
    "pulmonary",
    "short-stay",
    "short stay",
    "two-midnight",
    "mechanical ventilation",
    "tracheostomy",
    "sepsis",
]

NCD_PIECES = ["itm_srvc_desc", "indctn_lmtn", "xref_txt", "othr_txt", "rev_hstry"]
ARTICLE_PIECES = ["description", "other_comments", "cms_cov_policy"]


@F.pandas_udf(T.StringType())
def _decode_entities(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def clean_html(text: Column) -> Column:
    """Entities first, then tags and NULs to blanks, then white space collapsed.

    Only the entity table needs Python; the rest runs as native expressions.
    """
    decoded = _decode_entities(F.coalesce(text, F.lit("")))
    no_tags = F.regexp_replace(decoded, "<[^>]+>", " ")
    return collapse_space(F.translate(no_tags, "\x00", " "))


def policy_body(pieces: list[Column]) -> Column:
    """Cleaned pieces that are not empty, with a blank line between them."""
    cleaned = F.array(*[F.nullif(clean_html(p), F.lit("")) for p in pieces])
    return F.array_join(F.array_compact(cleaned), "\n\n")


def _or_default(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def _source(
    df: DataFrame, name: str, id_: str, version: str, title: str, keywords: str, pieces: list[str]
) -> DataFrame:
    return df.select(
        F.lit(name).alias("source"),
        _or_default(F.col(id_), "unknown").alias("source_id"),
        _or_default(F.col(version), "0").alias("version"),
        clean_html(F.col(title)).alias("title"),
        clean_html(F.col(keywords)).alias("keywords"),
        policy_body([F.col(p) for p in pieces]).alias("body"),
    )


def ncd_documents(df: DataFrame) -> DataFrame:
    return _source(
        df, "ncd", "NCD_id", "NCD_vrsn_num", "NCD_mnl_sect_title", "ncd_keyword", NCD_PIECES
    )


def article_documents(df: DataFrame) -> DataFrame:
    return _source(
        df, "article", "article_id", "article_version", "title", "keywords", ARTICLE_PIECES
    )


def union_sources(ncd: DataFrame, articles: DataFrame) -> DataFrame:
    return ncd_documents(ncd).unionByName(article_documents(articles))


def contains_topic(text: Column, topics: list[str]) -> Column:
    haystack = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(haystack, F.lit(t.lower())) for t in topics])


def topic_filter(documents: DataFrame, topics: list[str] = TOPICS) -> DataFrame:
    """Documents with a body that name a topic in title, keywords or early body."""
    index_text = F.concat_ws(" ", "title", "keywords", F.substring("body", 1, 1000))
    return documents.where((F.col("body") != "") & contains_topic(index_text, topics))


def cap_records(documents: DataFrame, max_records: int | None, order: list[str]) -> DataFrame:
    """The first ``max_records`` documents of each source in ``order``. The rank
    filter is applied inside every task before the shuffle."""
    if max_records is None:
        return documents
    first = Window.partitionBy("source").orderBy(*order)
    return (
        documents.withColumn("nth", F.row_number().over(first))
        .where(F.col("nth") <= max_records)
        .drop("nth")
    )


def chunk_words(words: list[str], size: int, overlap: int) -> list[str]:
    """Word runs of at most ``size`` characters. A run that is not the last hands
    its shortest tail worth ``overlap`` characters (a blank counted per word) on
    to the next one, which still starts at least one word later."""
    # ends[i]: characters of the first i words, each with one blank behind it
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    chunks, start, count = [], 0, len(words)
    while start < count:
        stop = max(start + 1, bisect_right(ends, ends[start] + size + 1) - 1)
        chunks.append(" ".join(words[start:stop]))
        if stop == count:
            break
        # last position whose tail up to `stop` still has `overlap` characters
        back = bisect_right(ends, ends[stop] - overlap) - 1
        start = min(max(start + 1, back), stop)
    return chunks


def _check_sizes(size: int, overlap: int) -> None:
    if size <= 100:
        raise ValueError("chunk size must be above 100")
    if overlap < 0:
        raise ValueError("chunk overlap must not be negative")


def chunk_documents(
    documents: DataFrame,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    text: str = "body",
) -> DataFrame:
    """One row per chunk with ``chunk_number`` and ``chunk_total``; the greedy
    packing of one document is sequential, documents are independent."""
    _check_sizes(size, overlap)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: chunk_words((t or "").split(), size, overlap))

    keep = [c for c in documents.columns if c != text]
    listed = documents.select(*keep, split(F.col(text)).alias("chunks"))
    return listed.select(
        *keep,
        F.size("chunks").alias("chunk_total"),
        F.posexplode("chunks").alias("position", text),
    ).select(
        *keep, (F.col("position") + 1).alias("chunk_number"), "chunk_total", text
    )


def file_name() -> Column:
    """Name of a chunk's file; characters outside [a-zA-Z0-9._-] become '_'."""
    name = F.concat(
        F.col("source"), F.lit("_"), F.col("source_id"), F.lit("_v"), F.col("version"),
        F.lit("_part"), F.format_string("%03d", F.col("chunk_number")), F.lit(".txt"),
    )
    return F.regexp_replace(name, "[^a-zA-Z0-9._-]", "_")


def build_corpus(
    ncd: DataFrame,
    articles: DataFrame,
    topics: list[str] = TOPICS,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    max_records: int | None = None,
) -> DataFrame:
    """The chunk table, manifest columns and text in one."""
    chosen = cap_records(
        topic_filter(union_sources(ncd, articles), topics), max_records, ["source_id", "version"]
    )
    chunks = chunk_documents(chosen.drop("keywords"), size, overlap)
    return chunks.withColumn("file_name", file_name())


def emit_counts(chunks: DataFrame) -> DataFrame:
    """Documents and chunks per source. A document's first chunk stands for it,
    so documents are counted without a distinct."""
    return chunks.groupBy("source").agg(
        F.count_if(F.col("chunk_number") == 1).alias("documents"),
        F.count("*").alias("chunks"),
    )
