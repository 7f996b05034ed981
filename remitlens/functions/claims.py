"""Column expressions over the wide claims table.

Everything here is built from functions that take part in code generation; a
repeated column group is addressed by name, so columns that are not used never
leave the Parquet file.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.schema import CHRONIC_FLAGS, PROCEDURES

# Symptom-only primary diagnosis prefixes (fixed values).
SYMPTOM_PREFIXES = [
    "780.0", "780.3", "780.6", "780.7",
    "781.", "782.", "783.", "784.",
    "785.", "786.", "787.", "789.",
]

# Procedures that need a confirmed diagnosis, with their weights (fixed values).
SURGERY_WEIGHT, SURGERY = 1.0, [
    "27447", "27130", "22551", "22612", "43239",
    "45385", "33533", "33510", "61510", "58150",
]
IMAGING_WEIGHT, IMAGING = 0.7, [
    "70553", "71250", "74177", "78816",
    "78452", "93306", "70450", "72148",
]
ONCOLOGY_WEIGHT, ONCOLOGY = 1.0, ["96413", "96415", "96401", "J9035", "J9055", "J9305"]
EQUIPMENT_WEIGHT, EQUIPMENT = 0.8, ["E0601", "E0470", "K0001", "A4253", "A9150", "L5100"]


def procedure_weights() -> list[tuple[str, float]]:
    groups = (
        (SURGERY, SURGERY_WEIGHT),
        (IMAGING, IMAGING_WEIGHT),
        (ONCOLOGY, ONCOLOGY_WEIGHT),
        (EQUIPMENT, EQUIPMENT_WEIGHT),
    )
    return [(code, weight) for codes, weight in groups for code in codes]


def present(value: Column) -> Column:
    """Trimmed text, with blanks turned into NULL."""
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def slot_names(df: DataFrame, group: tuple[str, int]) -> list[str]:
    """The columns of a repeated group that this table really has, in slot order."""
    prefix, width = group
    have = set(df.columns)
    return [n for n in (f"{prefix}_{i}" for i in range(1, width + 1)) if n in have]


def any_populated(df: DataFrame, group: tuple[str, int]) -> Column:
    names = slot_names(df, group)
    if not names:
        return F.lit(False)
    return F.coalesce(*[present(F.col(n)) for n in names]).isNotNull()


def any_equals(df: DataFrame, group: tuple[str, int], target: str) -> Column:
    names = slot_names(df, group)
    if not names:
        return F.lit(False)
    # the array is the same for every target, so a row's slots are trimmed once
    return F.coalesce(F.array_contains(F.array(*[F.trim(F.col(n)) for n in names]), target), F.lit(False))


def count_populated(
    df: DataFrame, group: tuple[str, int], blank_words: tuple[str, ...] = ()
) -> Column:
    """Number of filled slots; ``blank_words`` are texts that also mean "empty"."""

    names = slot_names(df, group)
    if not names:
        return F.lit(0)
    # a test of an array's slots, since a sum over the columns made methods too long to be compiled
    slots = F.array(*[F.col(n).cast("string") for n in names])
    return F.size(F.filter(slots, lambda c: ~F.trim(c).isin("", *blank_words)))


def code_array(df: DataFrame) -> Column:
    """The filled procedure slots of one claim row, trimmed, repeats kept."""
    names = slot_names(df, PROCEDURES)
    return F.filter(F.array(*[F.trim(F.col(n)) for n in names]), lambda c: c != "")


def optional(df: DataFrame, name: str, cast: str, default=None) -> Column:
    """A column that may be missing from the table; then a typed constant."""
    if name in df.columns:
        return F.col(name).try_cast(cast)
    return F.lit(default).cast(cast)


def first_available(df: DataFrame, names: list[str], cast: str, default) -> Column:
    """First non-NULL of the columns that exist, then ``default``."""
    found = [F.col(n).try_cast(cast) for n in names if n in df.columns]
    return F.coalesce(*found, F.lit(default).cast(cast))


def symptom_primary(
    line_dx: Column, prefixes: list[str] = SYMPTOM_PREFIXES, strip_dots: bool = False
) -> Column:
    """First line diagnosis starts with a symptom prefix.

    The prefixes carry dots while claim codes usually do not; ``strip_dots``
    compares both sides without them.
    """
    value = F.coalesce(F.trim(line_dx), F.lit(""))
    if strip_dots:
        value = F.replace(value, F.lit("."), F.lit(""))
        prefixes = [p.replace(".", "") for p in prefixes]
    return reduce(lambda a, b: a | b, [value.startswith(p) for p in prefixes])


def los_outlier(days: Column, reference: Column) -> Column:
    return F.when((reference > 0) & (days > 1.5 * reference), 1).otherwise(0)


def short_stay(days: Column, reference: Column) -> Column:
    return F.when((reference > 0) & (days < 0.5 * reference), 1).otherwise(0)


TRUTHY_BATCH = ("1", "Y", "y")
TRUTHY_SERVING = ("1", "y", "yes", "true")


def chronic_count(
    df: DataFrame, truthy: tuple[str, ...] = TRUTHY_BATCH, fold_case: bool = False
) -> Column:
    def flag(name: str) -> Column:
        value = F.col(name).cast("string")
        if fold_case:
            value = F.lower(F.trim(value))
        return F.coalesce(value.isin(*truthy), F.lit(False)).cast("int")

    return reduce(add, [flag(n) for n in CHRONIC_FLAGS if n in df.columns], F.lit(0))


def parse_day(value: Column) -> Column:
    return F.try_to_timestamp(value.cast("string"), F.lit("yyyyMMdd"))


def age_at_claim(birth: Column, service: Column) -> Column:
    """Difference of calendar years; NULL if either date does not parse."""
    return F.year(parse_day(service)) - F.year(parse_day(birth))


def age_at_claim_serving(birth: Column, service: Column) -> Column:
    """Same on the leading four digits of free text, never below 0, 0 if unknown."""
    b, s = F.trim(birth.cast("string")), F.trim(service.cast("string"))
    years = F.substring(s, 1, 4).try_cast("int") - F.substring(b, 1, 4).try_cast("int")
    known = b.rlike("^[0-9]{4}") & s.rlike("^[0-9]{4}")
    return F.coalesce(F.when(known, F.greatest(years, F.lit(0))), F.lit(0))


def claim_month(service: Column) -> Column:
    return F.month(parse_day(service))


def claim_month_serving(service: Column) -> Column:
    text = F.trim(service.cast("string"))
    # six digits or more, the fifth and sixth from 01 to 12
    month = F.when(text.rlike("^[0-9]{4}(0[1-9]|1[0-2])[0-9]*$"), F.substring(text, 5, 2).try_cast("int"))
    return F.coalesce(month, F.lit(0))


def safe_double(value: Column, default: float = 0.0) -> Column:
    """Number from free text; blanks, ``nan``, ``None`` and junk give the default."""
    text = F.nullif(F.trim(value.cast("string")), F.lit("nan"))
    return F.coalesce(text.try_cast("double"), F.lit(default))


def safe_int(value: Column, default: int = 0) -> Column:
    """Integer by cutting a decimal text towards zero."""
    number = F.trim(value.cast("string")).try_cast("double")
    return F.coalesce(number.try_cast("bigint"), F.lit(default).cast("bigint"))
