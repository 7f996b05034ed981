"""Letters to appeal packets and calls to prompts, over a stored chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.operators import calls as ca
from remitlens.operators import letters as lt
from remitlens.operators import retrieval as rt

LETTER_HITS, CALL_HITS = 3, 2


def with_chunk_key(chunks: DataFrame) -> DataFrame:
    """Chunks of the corpus table under one text key."""
    key = F.concat_ws(
        "|", "source", "source_id", "version", F.format_string("%06d", F.col("chunk_number"))
    )
    return chunks.withColumn("chunk_key", key)


def corpus_index(chunks: DataFrame, stop_words: list[str] | None = None) -> rt.BlockIndex:
    """Fit the index of a chunk table, in blocks; store its two tables to reuse it."""
    words = rt.english_stop_words() if stop_words is None else stop_words
    keyed = with_chunk_key(chunks).select("chunk_key", F.col("body").alias("text"))
    return rt.block_index(rt.fit_index(keyed, "chunk_key", words), "chunk_key")


def excerpts(
    index: rt.BlockIndex,
    chunks: DataFrame,
    queries: DataFrame,
    query_key: str,
    k: int,
    stop_words: list[str] | None = None,
) -> DataFrame:
    """``queries`` (key, text) with a ``policy_excerpts`` block each."""
    words = rt.english_stop_words() if stop_words is None else stop_words
    best = rt.best_chunks(index, queries, "chunk_key", query_key, words, k)
    texts = with_chunk_key(chunks).select("chunk_key", "source", "source_id", "title", "body")
    hits = rt.format_hits(best.join(texts, "chunk_key"))
    return rt.prompt_blocks(queries, hits, query_key)


def appeal_letters(
    letters: DataFrame,
    key: str,
    index: rt.BlockIndex,
    chunks: DataFrame,
    stop_words: list[str] | None = None,
) -> DataFrame:
    requests = lt.appeal_requests(letters)
    asked = requests.select(key, F.col("retrieval_query").alias("text"))
    found = excerpts(index, chunks, asked, key, LETTER_HITS, stop_words).drop("text")
    return lt.appeal_packets(requests.join(found, key))


def call_prompts(
    turns: DataFrame,
    contexts: DataFrame,
    index: rt.BlockIndex,
    chunks: DataFrame,
    scenario: str = "2",
    template: str = ca.DEFAULT_TEMPLATE,
    stop_words: list[str] | None = None,
) -> DataFrame:
    """Prompts per turn. ``contexts`` has call_id, ``query_context`` (nested, for the
    retrieval query) and ``context`` (the map shown in the prompt)."""
    flow = ca.FLOWS[scenario]
    log = ca.transcript(turns, flow)
    known = log.join(contexts, "call_id").withColumn(
        "turn_key", F.concat_ws("|", "call_id", "turn")
    )
    asked = known.select(
        "turn_key", ca.call_query(F.col("payer"), F.col("query_context")).alias("text")
    )
    found = excerpts(index, chunks, asked, "turn_key", CALL_HITS, stop_words).drop("text")
    ready = known.join(found, "turn_key").join(ca.prior_context(log), ["call_id", "turn"])
    return ca.prompt_rows(ready, flow, template)
