"""Star-schema tables seen as claims.

An order is a claim and its lines are the code slots. Lines of one order that
look the same (code, status, line diagnosis) are counted first, with map-side
combining, so an order that owns a large share of all lines shrinks before it
is shuffled. A kind is then cut into pieces of at most ``SLOTS`` lines; piece
``p`` of every kind of the order goes to block ``p``. A block therefore holds
at most kinds x SLOTS lines whatever the order's size, and each run of
``SLOTS`` lines in it becomes one claim row (segment). No line is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 13

# Brands that stand for procedures of the definitive list; others get H00nn.
SPECIAL_CODES = {1: "27447", 2: "70553", 3: "96413", 4: "E0601"}


_SCHEMAS: dict[str, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its schema is looked up in the file once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def brand_code(brand) -> F.Column:
    number = F.replace(brand, F.lit("Brand#"), F.lit(""))
    code = F.concat(F.lit("H"), F.lpad(number, 4, "0"))
    for n, special in SPECIAL_CODES.items():
        code = F.when(number == str(n), special).otherwise(code)
    return code


def claim_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_returnflag", "l_linestatus", "l_tax", "l_discount"
    )
    returned = F.col("l_returnflag") == "R"
    status = (
        F.when(returned & (F.col("l_tax") > 0.075), "C")
        .when(returned & (F.col("l_discount") > 0.095), "B")
        .when(~returned, "A")
    )
    line_dx = F.when(
        F.col("l_linestatus") == "F",
        F.when(F.col("p_type") == "PROMO", "78650").otherwise("4019"),
    )
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey",
        brand_code(F.col("p_brand")).alias("code"),
        status.alias("ind"),
        line_dx.alias("dx"),
    )


def claim_segments(lines: DataFrame) -> DataFrame:
    """(l_orderkey, block, segment, slots): up to SLOTS lines per row."""
    kinds = lines.groupBy("l_orderkey", "code", "ind", "dx").agg(F.count("*").alias("n"))
    last_piece = F.expr(f"(n - 1) div {SLOTS}")
    pieces = kinds.select(
        "l_orderkey", "code", "ind", "dx", "n",
        F.explode(F.sequence(F.lit(0).cast("bigint"), last_piece)).alias("block"),
    ).withColumn("size", F.least(F.col("n") - F.col("block") * SLOTS, F.lit(SLOTS)))
    # dealt by order, blocks need no exchange of their own and none to meet their order
    blocks = pieces.repartition("l_orderkey").groupBy("l_orderkey", "block").agg(
        F.sort_array(F.collect_list(F.struct("code", "ind", "dx", "size"))).alias("kinds")
    )
    laid_out = blocks.select(
        "l_orderkey",
        "block",
        F.flatten(
            F.transform("kinds", lambda k: F.array_repeat(k, k["size"].cast("int")))
        ).alias("laid"),
    )
    return laid_out.select(
        "l_orderkey",
        "block",
        F.explode(F.sequence(F.lit(0), F.expr(f"int((size(laid) - 1) div {SLOTS})"))).alias(
            "segment"
        ),
        "laid",
    ).select(
        "l_orderkey",
        "block",
        "segment",
        F.slice("laid", F.col("segment") * SLOTS + 1, SLOTS).alias("slots"),
    )


def wide_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus"
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    segments = claim_segments(claim_lines(spark, sf_dir))
    days = (F.col("o_orderkey") % 15).cast("int")
    priority = F.col("o_orderpriority")
    slot = [F.get("slots", F.lit(i)) for i in range(SLOTS)]
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(segments, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            F.col("o_orderkey").cast("string").alias("CLM_ID"),
            F.col("o_custkey").cast("string").alias("DESYNPUF_ID"),
            (1 + F.col("o_orderkey") % 2).cast("int").alias("sample_id"),
            F.date_format("o_orderdate", "yyyyMMdd").alias("CLM_FROM_DT"),
            F.date_format(F.date_add(F.to_date("o_orderdate"), days), "yyyyMMdd").alias(
                "CLM_THRU_DT"
            ),
            F.when(
                F.col("o_orderstatus") == "P", (200 + F.col("c_nationkey")).cast("string")
            ).alias("CLM_DRG_CD"),
            days.cast("string").alias("CLM_UTLZTN_DAY_CNT"),
            # absent header diagnoses come as NULL and as blanks
            F.when(
                priority == "4-NOT SPECIFIED", F.when(F.col("o_orderkey") % 2 == 0, "  ")
            )
            .when(priority == "5-LOW", "78650")
            .otherwise("25000")
            .alias("ICD9_DGNS_CD_1"),
            F.when(priority == "1-URGENT", "4280").alias("ICD9_DGNS_CD_2"),
            *[slot[i]["code"].alias(f"HCPCS_CD_{i + 1}") for i in range(SLOTS)],
            *[slot[i]["ind"].alias(f"LINE_PRCSG_IND_CD_{i + 1}") for i in range(SLOTS)],
            *[slot[i]["dx"].alias(f"LINE_ICD9_DGNS_CD_{i + 1}") for i in range(SLOTS)],
        )
    )


def beneficiaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    flags = [
        "SP_DIABETES", "SP_CHF", "SP_CNCR", "SP_COPD",
        "SP_CHRNKIDN", "SP_OSTEOPRS", "SP_RA_OA", "SP_STRKETIA",
    ]

    def bit(i: int):
        on = F.shiftright(key, i).bitwiseAND(1) == 1
        # set bits appear under all three accepted spellings
        return F.when(on, F.when(key % 3 == 0, "1").when(key % 3 == 1, "Y").otherwise("y")).otherwise(
            "2"
        )

    return customer.select(
        key.cast("string").alias("DESYNPUF_ID"),
        F.concat((1920 + key % 70).cast("string"), F.lit("0615")).alias("BENE_BIRTH_DT"),
        (1 + F.col("c_nationkey") % 2).cast("string").alias("BENE_SEX_IDENT_CD"),
        (key % 13).cast("string").alias("BENE_HI_CVRAGE_TOT_MONS"),
        F.when(key % 5 != 0, (key % 12).cast("string")).alias("BENE_SMI_CVRAGE_TOT_MONS"),
        F.col("c_acctbal").cast("string").alias("MEDREIMB_IP"),
        F.when(F.col("c_acctbal") > 0, (F.col("c_acctbal") * 2).cast("string")).alias(
            "MEDREIMB_CAR"
        ),
        (F.col("c_acctbal") / 4).cast("string").alias("BENRES_CAR"),
        *[bit(i).alias(name) for i, name in enumerate(flags)],
    )


def hcpcs_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select("p_brand").distinct()
    code = brand_code(F.col("p_brand"))
    return brands.select(code.alias("hcpcs_code"), (code == "H0013").alias("is_noncovered"))


def ptp_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits between brands: partner numbers come from the brand's own number."""
    number = F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int")
    brands = (
        table(spark, sf_dir, "part").select("p_brand").distinct().select(number.alias("x"))
    )
    edits = brands.withColumn("y", F.explode(F.sequence(F.lit(1), F.lit(25)))).where(
        (F.col("x") != F.col("y")) & ((F.col("x") * 7 + F.col("y") * 3) % 23 == 0)
    )
    present = brands.select(F.col("x").alias("y"))
    third = (F.col("x") + F.col("y")) % 3

    def code(c):
        return brand_code(F.concat(F.lit("Brand#"), F.col(c).cast("string")))

    return edits.join(present, "y", "left_semi").select(
        code("x").alias("code1"),
        code("y").alias("code2"),
        F.when(third == 0, "0").when(third == 1, "1").otherwise("9").alias("modifier"),
    )


def article_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select("p_brand").distinct()
    code = brand_code(F.col("p_brand"))
    return brands.where(code >= "H0018").select(
        F.concat(F.lit("A"), F.replace("p_brand", F.lit("Brand#"), F.lit(""))).alias("article_id"),
        code.alias("hcpcs_code"),
    )


def drg_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        (200 + n).cast("string").alias("drg_code"),
        (1.0 + n / 10).alias("weight"),
        F.when(n % 4 != 0, 2.5 + n % 7).cast("double").alias("geometric_mean_los"),
        (3.0 + n % 9).cast("double").alias("alos_hist"),
    )


def ncd_from_pages(pages: DataFrame) -> DataFrame:
    """Web pages in the layout of the coverage export."""
    key = F.col("page_id")
    return pages.select(
        key.cast("string").alias("NCD_id"),
        (key % 3).cast("string").alias("NCD_vrsn_num"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("NCD_mnl_sect_title"),
        F.col("url").alias("ncd_keyword"),
        F.col("html").alias("itm_srvc_desc"),
        F.when(key % 4 == 0, F.concat(F.lit("<p>See &sect; "), F.col("url"), F.lit("</p>")))
        .otherwise("")
        .alias("indctn_lmtn"),
        F.lit(None).cast("string").alias("xref_txt"),
        F.lit("<br/>").alias("othr_txt"),
        F.lit("").alias("rev_hstry"),
    )


def articles_from_documents(documents: DataFrame) -> DataFrame:
    """Documents in the layout of the article export."""
    key = F.col("doc_id")
    return documents.select(
        key.cast("string").alias("article_id"),
        (key % 4).cast("string").alias("article_version"),
        F.concat(F.col("source"), F.lit(" "), F.col("lang")).alias("title"),
        F.col("lang").alias("keywords"),
        F.col("text").alias("description"),
        F.when(key % 5 == 0, "Local <b>note</b>").otherwise("").alias("other_comments"),
        F.lit(None).cast("string").alias("cms_cov_policy"),
    )
