"""Small helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, and the white space that parts words.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text as a long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_random(seed: int, *key: Column) -> Column:
    """A reproducible number in (0, 1) from the key's characters.

    48 bits of an MD5 digest, so any engine that has MD5 gets the same number and
    a task that runs again repeats its own.
    """
    name = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in key])
    bits = F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(281474976710656.0)


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, for DuckDB; 3988292384 is the checksum's polynomial."""
    step = "case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end"
    byte = f"list_reduce(list_prepend(xor(r, v), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, y: {step})"
    codes = f"list_transform(string_split({text}, ''), lambda s: ascii(s)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), lambda r, v: {byte}), 4294967295)"
