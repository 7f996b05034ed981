"""A training-data pipeline over ``documents``: five stages of ``remitlens.llm``.

Each stage reads what the one before has kept, as Parquet in the shared folder. All
but the last return the columns of their input; ``n_chars`` follows the text. Nulls
and repeated rows go as each operator says: rows that share an id share a verdict. Of
rows equal in id (null among them) and text, the second stage keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from remitlens.llm import bpe_tree, host_quality, lsh_forest, source_mix, suffix_dedup
from remitlens.llm.common import WORD, table
from remitlens.session import cut_lineage


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is among those of ``kept``; a null id equals a null."""
    ids = kept.where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their own figures or their host fail go."""
    return _only(docs, host_quality.judge(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: shingles of five words, similarity 0.8."""
    kept = _only(docs, lsh_forest.near_duplicates(docs, size=5, percent=80))
    keys = docs.select(F.col("doc_id").alias("again_id"), F.md5("text").alias("again_tie"))
    again = cut_lineage(keys.groupBy("again_id", "again_tie").count().where("count > 1").drop("count"), "again")
    if again.isEmpty():
        return kept
    kept = kept.withColumn("tie", F.md5("text"))
    same = F.col("doc_id").eqNullSafe(F.col("again_id")) & F.col("tie").eqNullSafe(F.col("again_tie"))
    one = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "tie"])
    return kept.join(again, same, "left_anti").unionByName(one).drop("tie")


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; a document of which no word is left goes as a whole."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = suffix_dedup.cut_documents(docs, carry=others, as_text=True)
    cut = cut.where((F.col("n_removed") == 0) | F.col("kept").rlike(WORD))
    made = {
        "doc_id": F.col("doc_id"),
        "text": F.col("kept"),
        "n_chars": F.length("kept").cast("bigint"),
        **{c: F.col(f"carried.`{c}`") for c in others},
    }
    return cut.select(*[made[c].alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; of equal rows, as many as were drawn."""
    mixed = source_mix.mix(docs).groupBy("doc_id", "tie", "source")
    mixed = mixed.agg(F.count("*").alias("n"), F.min("copies").alias("copies"), F.sum("copies").alias("all"))
    # equal rows have the same whole copies, and some of them one more
    mixed = mixed.where("all > 0").select(
        F.col("doc_id").alias("mixed_id"), F.col("source").alias("mixed_source"), F.col("tie").alias("mixed_tie"),
        "n", "copies", (F.col("all") - F.col("n") * F.col("copies")).alias("more"),
    )
    mixed = cut_lineage(mixed, "mixed")
    same = (
        F.col("doc_id").eqNullSafe(F.col("mixed_id"))
        & (F.md5(F.coalesce("text", F.lit(""))) == F.col("mixed_tie"))
        & F.col("source").eqNullSafe(F.col("mixed_source"))
    )

    def repeated(rows: DataFrame) -> DataFrame:
        taken = rows.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
        return taken.select(*docs.columns)

    single = "n = 1 or more = 0"
    even = mixed.where(single).withColumn("copies", F.col("copies") + F.col("more"))
    some = mixed.where(f"not ({single})")
    if some.isEmpty():
        return repeated(docs.join(even, same))
    # number the equal rows in blocks, so that no task holds all of them
    key = ["mixed_id", "mixed_tie", "mixed_source"]
    block = F.floor(F.rand(source_mix.SEED) * F.ceil(F.col("n") / source_mix.BUCKET))
    rows = cut_lineage(docs.join(some, same).withColumn("block", block), "equal")
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*key, "block").agg(F.count("*").alias("held"))
    offsets = offsets.withColumn("offset", F.coalesce(F.sum("held").over(before), F.lit(0)))
    offsets = offsets.select(*[F.col(c).alias(f"o_{c}") for c in (*key, "block")], "offset")
    fits = F.col("block") == F.col("o_block")
    for c in key:
        fits &= F.col(c).eqNullSafe(F.col(f"o_{c}"))
    number = F.row_number().over(Window.partitionBy(*key, "block").orderBy("n")) + F.col("offset")
    drawn = rows.join(offsets, fits).withColumn("number", number)
    drawn = drawn.withColumn("copies", F.col("copies") + (F.col("number") <= F.col("more")).cast("bigint"))
    return repeated(docs.join(even, same)).unionByName(repeated(drawn))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of what they decode to."""
    return bpe_tree.encode_documents(docs).select(
        "doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", suffix_dedup_stage),
    ("source_mix", mix_sources),
    ("bpe", encode),
]

#: SQL cannot express the tokenizer and the byte-wise cuts; tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
