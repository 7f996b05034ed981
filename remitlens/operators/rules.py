"""Stage 1: hard-deny rules.

A rule convicts a claim id, not a row: segments that share an id share the
verdict. Each rule yields claim ids; the ids are folded into one row per claim
and joined to the claims once.

The rules read *claim facts*: one narrow row per claim row with its codes as an
array and its tests already made. Folding the wide table takes a single scan;
stored, the facts spare every later stage the wide columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.functions import claims as fc
from remitlens.schema import CLAIM_KEY, HEADER_DX, LINE_DX, LINE_STATUS
from remitlens.session import cut_lineage

NONCOVERED = "HCPCS_NONCOVERED"
UNBUNDLING = "PTP_UNBUNDLING"
CONDITION_UNMET = "LCD_CONDITION_UNMET"
#: Codes of a block when the codes of a claim meet.
PAIR_BLOCK = 64


def unpivot_codes(claims: DataFrame) -> DataFrame:
    """One row per filled procedure slot, repeats kept, from a single scan."""
    return claims.select(
        "CLM_ID", "DESYNPUF_ID", "CLM_FROM_DT", F.explode(fc.code_array(claims)).alias("hcpcs_code")
    )


def fold_claims(claims: DataFrame) -> DataFrame:
    """Claim facts: key, codes, diagnosis counts and observed line statuses."""
    header, line = fc.count_populated(claims, HEADER_DX), fc.count_populated(claims, LINE_DX)
    return claims.select(
        *CLAIM_KEY,
        F.col("CLM_UTLZTN_DAY_CNT").try_cast("double").alias("days"),
        fc.code_array(claims).alias("codes"),
        header.alias("header_dx_count"),
        line.alias("line_dx_count"),
        fc.optional(claims, "LINE_ICD9_DGNS_CD_1", "string").alias("first_line_dx"),
        *[
            fc.any_equals(claims, LINE_STATUS, code).alias(f"seen_{code.lower()}")
            for code in ("A", "B", "C")
        ],
    )


def claim_codes(facts: DataFrame) -> DataFrame:
    """(CLM_ID, hcpcs_code) slots of claims that have an id.

    Rules match ids with plain equality, so rows without an id can never be
    convicted and need not travel.
    """
    return facts.where(F.col("CLM_ID").isNotNull()).select(
        "CLM_ID", F.explode("codes").alias("hcpcs_code")
    )


def noncovered_claims(codes: DataFrame, hcpcs: DataFrame) -> DataFrame:
    listed = hcpcs.where(F.coalesce("is_noncovered", F.lit(False))).select("hcpcs_code")
    return codes.join(listed, "hcpcs_code", "left_semi").select("CLM_ID").distinct()


def canonical_pairs(ptp: DataFrame, with_modifier: bool = True) -> DataFrame:
    a, b = fc.present(F.col("code1")), fc.present(F.col("code2"))
    pairs = ptp.where(a.isNotNull() & b.isNotNull()).select(
        F.least(a, b).alias("code_lo"),
        F.greatest(a, b).alias("code_hi"),
        F.trim("modifier").alias("modifier"),
    )
    if not with_modifier:
        pairs = pairs.drop("modifier")
    return pairs.distinct()


def _row_pairs(facts: DataFrame) -> DataFrame:
    """Code pairs inside one claim row: bounded by the table's slot count."""
    return (
        facts.where(F.col("CLM_ID").isNotNull() & (F.size("codes") > 1))
        .select("CLM_ID", F.array_distinct("codes").alias("codes"))
        .select("CLM_ID", "codes", F.explode("codes").alias("code_lo"))
        .select(
            "CLM_ID",
            "code_lo",
            F.explode(F.filter("codes", lambda code: code > F.col("code_lo"))).alias("code_hi"),
        )
    )


def _row_partners(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Claims with a row that holds both codes of a listed pair: a code fetches its partners
    and these are looked for in the row, so a row is as long as its codes, not its pairs."""
    partners = pairs.groupBy("code_lo").agg(F.collect_set("code_hi").alias("partners"))
    return (
        facts.where(F.col("CLM_ID").isNotNull() & (F.size("codes") > 1))
        .select("CLM_ID", "codes", F.explode(F.array_distinct("codes")).alias("code_lo"))
        .join(partners, "code_lo")
        .where(F.arrays_overlap("codes", "partners"))
        .select("CLM_ID")
    )


def _split_claim_codes(facts: DataFrame) -> DataFrame:
    """Distinct codes of the claims that arrive in several segments.

    Their ids are stored: where they are few, Spark knows it before it plans and drops
    the other claims' codes where they lie, instead of shuffling all of them.
    """
    several = (
        facts.where(F.col("CLM_ID").isNotNull())
        .groupBy("CLM_ID")
        .count()
        .where("count > 1")
        .select("CLM_ID")
    )
    several = cut_lineage(several, "several")
    return claim_codes(facts).distinct().join(several, "CLM_ID", "left_semi")


def _block_pairs(codes: DataFrame, size: int) -> DataFrame:
    """Pairs of the distinct ``codes`` of a claim: a triangle of blocks of about ``size`` codes.

    Codes are dealt into blocks by hash; every two blocks of a claim, and every block
    with itself, meet in a group of their own, so a claim with very many codes is many
    small groups.
    """
    sizes = codes.groupBy("CLM_ID").agg(F.ceil(F.count("*") / size).alias("blocks"))
    dealt = codes.join(sizes, "CLM_ID").withColumn("own", F.pmod(F.xxhash64("hcpcs_code"), F.col("blocks")))
    first = dealt.select(
        "CLM_ID", F.col("hcpcs_code").alias("a"), F.col("own").alias("i"),
        F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"),
    )
    second = dealt.select(
        "CLM_ID", F.col("hcpcs_code").alias("b"), F.explode(F.sequence(F.lit(0).cast("bigint"), "own")).alias("i"),
        F.col("own").alias("j"),
    )
    met = first.join(second, ["CLM_ID", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("a") < F.col("b")))
    return met.select("CLM_ID", F.least("a", "b").alias("code_lo"), F.greatest("a", "b").alias("code_hi"))


def claim_code_pairs(facts: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """Distinct (claim, lower code, higher code).

    Pairs inside a row need no shuffle. Only claims in several segments can own
    pairs across rows; their codes are made distinct and meet block by block.
    """
    across = _block_pairs(_split_claim_codes(facts), block)
    return _row_pairs(facts).unionByName(across).distinct()


def listed_pair_claims(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Claims that carry both codes of a listed pair.

    Same claims as joining ``claim_code_pairs`` to the list, without ever
    forming the pairs of a many-segment claim: there a code fetches its listed
    partners and each partner is looked up among the claim's own codes. A code listed
    with itself is no pair.
    """
    pairs = pairs.where("code_lo < code_hi").select("code_lo", "code_hi").distinct()
    inside = _row_partners(facts, pairs)
    split = _split_claim_codes(facts)
    wanted = (
        split.join(pairs, split["hcpcs_code"] == pairs["code_lo"])
        .select("CLM_ID", F.col("code_hi").alias("hcpcs_code"))
        .distinct()
    )
    across = wanted.join(split, ["CLM_ID", "hcpcs_code"], "left_semi").select("CLM_ID")
    return inside.unionByName(across).distinct()


def unbundled_claims(facts: DataFrame, ptp: DataFrame) -> DataFrame:
    never_together = canonical_pairs(ptp).where(F.col("modifier") == "0")
    return listed_pair_claims(facts, never_together)


def linked_codes(links: DataFrame) -> DataFrame:
    code = fc.present(F.col("hcpcs_code"))
    return links.select(code.alias("hcpcs_code")).where(F.col("hcpcs_code").isNotNull()).distinct()


def undiagnosed_linked_claims(facts: DataFrame, links: DataFrame) -> DataFrame:
    """Claims with an article-linked code and a row without any diagnosis.

    The diagnosis test looks at one row, the code may sit on any row of the claim.
    """
    bare = (
        facts.where("header_dx_count = 0 and line_dx_count = 0 and CLM_ID is not null")
        .select("CLM_ID")
        .distinct()
    )
    with_code = claim_codes(facts).join(linked_codes(links), "hcpcs_code", "left_semi")
    # one row per claim before the shuffle, however many codes a claim holds
    return bare.join(with_code.select("CLM_ID").distinct(), "CLM_ID", "left_semi")


def rule_hits(
    facts: DataFrame, hcpcs: DataFrame, ptp: DataFrame, links: DataFrame
) -> DataFrame:
    """One row per convicted claim with a flag per rule."""
    found = (
        noncovered_claims(claim_codes(facts), hcpcs)
        .withColumn("rule", F.lit(NONCOVERED))
        .unionByName(unbundled_claims(facts, ptp).withColumn("rule", F.lit(UNBUNDLING)))
        .unionByName(
            undiagnosed_linked_claims(facts, links).withColumn("rule", F.lit(CONDITION_UNMET))
        )
    )
    return found.groupBy("CLM_ID").agg(
        F.bool_or(F.col("rule") == NONCOVERED).alias("rule_hcpcs_noncovered"),
        F.bool_or(F.col("rule") == UNBUNDLING).alias("rule_ptp_unbundling"),
        F.bool_or(F.col("rule") == CONDITION_UNMET).alias("rule_lcd_condition_unmet"),
    )


def with_decision(flagged: DataFrame) -> DataFrame:
    """Reason by fixed precedence, decision and confidence from three flags."""
    n, p, u = (
        F.col("rule_hcpcs_noncovered"),
        F.col("rule_ptp_unbundling"),
        F.col("rule_lcd_condition_unmet"),
    )
    convicted = n | p | u
    return flagged.withColumns(
        {
            "stage1_reason_code": F.when(n, NONCOVERED)
            .when(p, UNBUNDLING)
            .when(u, CONDITION_UNMET)
            .otherwise("NONE"),
            "stage1_decision": F.when(convicted, "HARD_DENY").otherwise("PASS_TO_ML"),
            "stage1_confidence": F.when(convicted, 1.0).otherwise(0.0),
        }
    )


def judged(facts: DataFrame, hits: DataFrame) -> DataFrame:
    """Claim rows with the verdict of their claim; ``hits`` has one row per convicted claim."""
    flags = ["rule_hcpcs_noncovered", "rule_ptp_unbundling", "rule_lcd_condition_unmet"]
    narrow = facts.select(
        *CLAIM_KEY,
        F.col("seen_b").alias("observed_has_b"),
        F.col("seen_c").alias("observed_has_c"),
    )
    joined = narrow.join(hits, "CLM_ID", "left").select(
        *CLAIM_KEY,
        *[F.coalesce(f, F.lit(False)).alias(f) for f in flags],
        "observed_has_b",
        "observed_has_c",
    )
    return with_decision(joined)


def stage1(facts: DataFrame, hcpcs: DataFrame, ptp: DataFrame, links: DataFrame) -> DataFrame:
    return judged(facts, rule_hits(facts, hcpcs, ptp, links))


def code_rules(hcpcs: DataFrame, ptp: DataFrame, links: DataFrame) -> DataFrame:
    """What the rule tables say about each code: ``noncovered``, ``linked`` and ``partners``,
    the codes it must not stand with. Codes that no rule names have no row."""
    pairs = canonical_pairs(ptp).where("modifier = '0' and code_lo < code_hi").select("code_lo", "code_hi").distinct()
    both = pairs.unionByName(pairs.select(F.col("code_hi").alias("code_lo"), F.col("code_lo").alias("code_hi")))
    none = F.lit(None).cast("string")
    no = F.lit(False)
    listed = hcpcs.where(F.coalesce("is_noncovered", no)).select("hcpcs_code")
    named = (
        listed.select("hcpcs_code", F.lit(True).alias("noncovered"), no.alias("linked"), none.alias("partner"))
        .unionByName(linked_codes(links).select("hcpcs_code", no.alias("noncovered"), F.lit(True).alias("linked"), none.alias("partner")))
        .unionByName(both.select(F.col("code_lo").alias("hcpcs_code"), no.alias("noncovered"), no.alias("linked"), F.col("code_hi").alias("partner")))
    )
    return named.groupBy("hcpcs_code").agg(
        F.bool_or("noncovered").alias("noncovered"), F.bool_or("linked").alias("linked"), F.collect_set("partner").alias("partners")
    )
