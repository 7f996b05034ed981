"""Readers of rule files, uploads and context files; sinks; the whole batch run."""

import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from remitlens.operators import uploads as up
from remitlens.operators.model import TreeSettings
from remitlens.plans import claims_run as cr
from driver_queries import adapter as ad
from remitlens.sources import claims as sc
from remitlens.sources import documents as dc
from remitlens.sources import rule_files as rf

SF = "/root/testdata/sf0.001"


def hcpcs_line(code, action, effective, termination):
    line = f"{code:<6}{'long':<120}{'short':<54}{'price':<88}{'20000101':<8}{effective:<8}{termination:<8}{action}"
    assert len(line) - len(action) == 292
    return line


def test_hcpcs(spark, tmp_path):
    path = tmp_path / "h.txt"
    path.write_text(
        "\n".join(
            [
                hcpcs_line("A0001", "D", "20050101", ""), hcpcs_line("A0002", "T", "", ""),
                hcpcs_line("A0003", "", "20050101", "20101231"), hcpcs_line("A0004", "A", "20050101", "20110101"),
                hcpcs_line("A0005", "D", "20110101", ""), "", hcpcs_line("A0006", "C", "2005xx01", ""),
            ]
        )
    )
    got = {r.hcpcs_code: r.is_noncovered for r in rf.read_hcpcs(spark, str(path)).collect()}
    assert got == {"A0001": True, "A0002": True, "A0003": True, "A0004": False, "A0006": False}


def test_mue_variants_encodings_and_hidden_files(spark, tmp_path):
    preamble = "\n".join(f"notice {i}" for i in range(9)) + "\n"
    (tmp_path / "MUE_One.csv").write_bytes((preamble + 'A1 ,3,"2 Date","caf').encode() + b"\xe9\"\n")
    (tmp_path / "MUE_Two.csv").write_text(preamble + "A2,n/a,1,why\n\nA3,4.5,3,why\n")
    (tmp_path / ".x.csv").write_text(preamble + "HID,1,1,x\n")
    rows = {r.hcpcs_code: r for r in rf.read_mue(spark, str(tmp_path)).collect()}
    assert {c: (r.mue_value, r.variant) for c, r in rows.items()} == {
        "A1": (3.0, "MUE_One"), "A2": (None, "MUE_Two"), "A3": (4.5, "MUE_Two"),
    }


def test_ptp_periods_in_subfolders(spark, tmp_path):
    preamble = "n\n" * 6
    rows = [
        "A\tB\tx\t20060101\t*\t0\tr", "A\tC\tx\t20060101\t20071231\t0\tr", "A\tD\tx\t20110101\t*\t0\tr",
        "A\tE\tx\t\t*\t0\tr", " F\tA \tx\t20101231\t20080101\t1\tr",
    ]
    for i, name in enumerate(("x", "y")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "p.txt").write_text(preamble + "\n".join(rows[i::2]) + "\n")
    got = sorted((r.code1, r.code2, r.modifier) for r in rf.read_ptp(spark, str(tmp_path)).collect())
    assert got == [("A", "B", "0"), ("F", "A", "1")]


def test_drg_merge_and_links(spark, tmp_path):
    (tmp_path / "h.TXT").write_text("207  1.50  7 40\n208     x  5 10\n207  2.00  9 41\n")
    (tmp_path / "FY Table 5.tsv").write_text(
        "MS-DRG\tType DRG\tWeights\tGeometric mean LOS\n207\tm\t\t11.5\n301\tm\t3.0\t2.5\n"
    )
    drg = rf.merge_drg(
        rf.read_drg_history(spark, str(tmp_path / "h.TXT")), rf.read_drg_table5(spark, str(tmp_path))
    )
    got = {r.drg_code: (r.weight, r.geometric_mean_los, r.alos_hist) for r in drg.collect()}
    assert got == {"207": (2.0, 11.5, 9.0), "208": (None, None, 5.0), "301": (3.0, 2.5, None)}
    with pytest.raises(FileNotFoundError):
        rf.merge_drg(None, None)
    (tmp_path / "l.csv").write_text("X,Article_ID, HCPC_Code \n1,a1,H1\n")
    assert [tuple(r) for r in rf.read_article_hcpcs(spark, str(tmp_path / "l.csv")).collect()] == [("a1", "H1")]
    assert rf.read_article_icd10(spark, str(tmp_path / "l.csv")).count() == 0
    assert rf.read_article_icd10(spark, str(tmp_path / "none.csv")).columns == ["article_id", "icd10_code"]


def test_policy_csv_with_line_breaks(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_bytes('NCD_id,itm_srvc_desc\n1,"<p>a ""q""\nb \xe9</p>"\n'.encode("latin-1"))
    assert [tuple(r) for r in dc.scan_policy_csv(spark, str(path)).collect()] == [("1", '<p>a "q"\nb é</p>')]


def test_chunk_files(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_text("source: ncd\nchunk: 1/1\nline one\n\nline two\n")
    (tmp_path / "docs" / "blank.txt").write_text(" \n ")
    manifest = "source,source_id,version,title,chunk_number,chunk_total,file_path\n"
    for name in ("a", "blank", "gone"):
        manifest += f"ncd,{name},1,t,1,1,docs/{name}.txt\n"
    (tmp_path / "manifest.csv").write_text(manifest)
    rows = dc.scan_policy_chunks(spark, str(tmp_path / "manifest.csv"), str(tmp_path)).collect()
    assert [(r.source_id, r.body) for r in rows] == [("a", "line one\n\nline two")]


def test_chunk_files_lie_in_one_folder(spark):
    from driver_queries import files as fl

    docs = [("1", "one", True), ("2", "two\nlines", True), ("3", None, True), ("4", "gone", False), ("5", "", True)]
    docs = spark.createDataFrame(docs, "key string, text string, is_written boolean")
    manifest, root = fl._chunk_files(spark, docs)
    read = dc.scan_policy_chunks(spark, manifest, root).collect()
    assert {r.source_id: r.body for r in read if r.source_id != "5"} == {"1": "one", "2": "two\nlines"}
    # a folder per row made writing, listing and committing slow
    assert not [p for p in Path(root).iterdir() if p.is_dir()]


def test_chunk_files_are_named_without_being_read(spark, monkeypatch):
    """Each file was read once more to find out its name; keys that no file name can hold are read back too."""
    from driver_queries import files as fl

    docs = [(k, f"text of {k}", True) for k in ("a/b", "c:d ?", "é%20", "x" * 300)] + [(None, "no key", True), ("gone", "g", False), ("two", "1", True), ("two", "1", True)]
    docs = spark.createDataFrame(docs, "key string, text string, is_written boolean")
    want = {k: f"text of {k}" for k in ("a/b", "c:d ?", "é%20", "x" * 300)} | {"two": "1\nsource: doc\nsource_id: two\nversion: 1\ntitle: t\nchunk: 1/1\n1"}
    reads = []
    text = type(spark.read).text
    monkeypatch.setattr(type(spark.read), "text", lambda self, path, **a: reads.append(path) or text(self, path, **a))
    for mounted in (True, False):
        monkeypatch.setattr(fl, "_is_mounted", lambda _: mounted)
        manifest, root = fl._chunk_files(spark, docs)
        assert len(reads) == (not mounted)
        got = dc.scan_policy_chunks(spark, manifest, root).collect()
        assert {r.source_id: r.body for r in got} == want and len(got) == 6
        reads.clear()
    nothing = dc.scan_policy_chunks(spark, *fl._chunk_files(spark, docs.where("false")))
    assert nothing.count() == 0


def test_context_and_cases(spark, tmp_path):
    context = {"scenario_2": {"claim": {"claim_id": "1", "diagnoses": {"49322": "x"}}, "ivr_status": {"carc_code": "CO-4"}}}
    (tmp_path / "c.json").write_text(json.dumps(context, indent=1))
    rows = dc.scan_claim_context(spark, str(tmp_path / "c.json")).collect()
    assert [(r.scenario, r.context.claim.diagnoses, r.context.ivr_status["carc_code"]) for r in rows] == [
        ("2", {"49322": "x"}, "CO-4")
    ]
    (tmp_path / "d.json").write_text(json.dumps([{"id": "1", "denial_code": "D"}, {"id": "2"}], indent=1))
    assert [r.id for r in dc.scan_denial_cases(spark, str(tmp_path / "d.json")).collect()] == ["1", "2"]


HEADER = ",".join(up.UPLOAD_REQUIRED)


def test_upload_scan_and_check(spark, tmp_path):
    path = tmp_path / "u.csv"
    path.write_text(HEADER + ",note\n1,207,d,493,x,CO-4,c,N1,r,n\n,  ,d,,x,CO-4,c,N1,r,n\n1,2,3\n")
    rows = dc.scan_upload(spark, str(path))
    assert sum(r._corrupt_record is not None for r in rows.collect()) == 1
    table = rows.drop("_corrupt_record").coalesce(1).withColumns(
        {"row_index": F.monotonically_increasing_id(), "upload_id": F.lit(1)}
    )
    check = up.schema_check(table).first()
    assert check.is_valid and check.row_errors == [
        "row 1: missing claim_id", "row 1: missing drg_code", "row 1: missing primary_diagnosis_code",
        "row 2: missing primary_diagnosis_code",
    ]
    assert (check.error_count, check.invalid_row_count, check.valid_rows) == (4, 2, 0)
    broken = up.schema_check(table.drop("rarc_code")).first()
    assert not broken.is_valid and broken.blocking_errors.endswith("rarc_code")
    refused = up.score_upload(table.drop("rarc_code", "claim_id"), None)
    assert {(r.status, r.claim_id.split("-")[0]) for r in refused.collect()} == {("rejected", "row")}
    assert up.status_counts(refused).first().asDict() == {
        "upload_id": 1, "rows_total": 3, "rows_scored": 0, "rows_fallback": 0, "rows_rejected": 3
    }
    results = up.score_upload(table, None).orderBy("row_index").collect()
    assert [r.status for r in results] == ["fallback"] * 3 and results[0].denial_probability is None


def test_check_lists_every_error(spark):
    blank = {c: F.lit("x") for c in up.UPLOAD_REQUIRED} | {"claim_id": F.lit(" "), "upload_id": F.lit(1)}
    table = spark.range(150).select(F.col("id").alias("row_index"), *[v.alias(c) for c, v in blank.items()])
    texts = sorted(f"row {i}: missing claim_id" for i in range(150))
    assert up.schema_check(table).first().row_errors == texts
    assert up.schema_check(table, listed=100).first().row_errors == texts[:100]


def test_signals_and_bands(spark):
    df = spark.createDataFrame(
        [(1, 0, 3, 1, 0, 3.0), (0, 0, 0, 2, 1, 0.0)],
        "short_stay_flag int, los_outlier_flag int, hcpcs_count int, total_diag_count int, chronic_condition_count int, utilization_days double",
    )
    got = [r[0] for r in df.select(up.risk_signals()).collect()]
    assert got == [[up.SIGNAL_SHORT, up.SIGNAL_CODES, up.SIGNAL_BALANCE], [up.SIGNAL_DEFAULT]]
    probs = spark.createDataFrame([(0.8,), (0.6,), (0.45,), (0.449,)], "p double")
    bands = probs.select(up.reason_from_probability(F.col("p"), F.array(F.lit("s"))).alias("r")).collect()
    assert [b.r.denial_code for b in bands] == ["D-MN-003", "D-COVERAGE-004", "D-AUTH-002", "D-REVIEW-000"]
    assert bands[0].r.rationale == "High denial risk (0.800) driven by s."


def test_upload_adapter(spark):
    df = spark.createDataFrame([("7", "49322", "2008-02-16")], "length_of_stay_days string, primary_diagnosis_code string, claim_start_date string")
    out = up.serving_features(up.adapt_upload(df), []).first()
    assert (out.utilization_days, out.icd9_diag_count, out.claim_month) == (7.0, 1, 2)
    assert up.serving_features(df, []).first().utilization_days == 0.0


def test_adapter_keeps_every_line(spark):
    """A hot order goes over many segments, a repeated line kind over several blocks."""
    lines = spark.createDataFrame(
        [(1, "A", "A", None)] * 40 + [(1, f"C{i}", None, "x") for i in range(30)] + [(2, "A", "B", None)],
        "l_orderkey long, code string, ind string, dx string",
    )
    rows = ad.claim_segments(lines).collect()
    assert sum(len(r.slots) for r in rows) == 71
    assert max(len(r.slots) for r in rows) == ad.SLOTS
    assert sum(s.code == "A" for r in rows for s in r.slots if r.l_orderkey == 1) == 40


def test_whole_run(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    raw.mkdir()
    claims = ad.wide_claims(spark, SF)
    claims.write.parquet(str(raw / "claims"))
    ad.beneficiaries(spark, SF).write.option("header", True).csv(str(raw / "bene"))
    (raw / "h.txt").write_text(hcpcs_line("H0013", "D", "20050101", "") + "\n" + hcpcs_line("H0014", "A", "20050101", ""))
    for name in ("mue", "ptp", "drg", "art"):
        (raw / name).mkdir()
    (raw / "mue" / "m.csv").write_text("n\n" * 9 + "H0014,2,1,x\n")
    edits = [f"{r.code1}\t{r.code2}\tx\t20060101\t*\t{r.modifier}\tr" for r in ad.ptp_reference(spark, SF).collect()]
    (raw / "ptp" / "p.txt").write_text("n\n" * 6 + "\n".join(edits))
    (raw / "drg" / "h.TXT").write_text("".join(f"{200 + n:3d}   1.5{3 + n % 9:3d} 20\n" for n in range(25)))
    (raw / "drg" / "Table_5.tsv").write_text("MS-DRG\tWeights\tGeometric mean LOS\n201\t1.0\t2.5\n")
    (raw / "art" / "article_x_hcpc_code.csv").write_text("article_id,hcpc_code_id\n" + "".join(f"a,H00{n}\n" for n in range(18, 26)))
    files = cr.RuleFiles(
        str(raw / "h.txt"), str(raw / "mue"), str(raw / "ptp"), str(raw / "drg" / "h.TXT"), str(raw / "drg"), str(raw / "art")
    )
    result = cr.run_all(
        spark, str(raw / "claims"), str(raw / "bene"), files, out, sample_id=1,
        settings=TreeSettings(trees=3, depth=2), strip_dots=True,
    )
    expected = sc.select_claims(claims, sample_id=1).count()
    assert result.count() == expected
    assert result.where("stage1_decision = 'HARD_DENY' and stage2_denial_probability is not null").count() == 0
    assert result.where("stage1_decision = 'PASS_TO_ML' and stage2_denial_probability is null").count() == 0
    report = [r.value for r in spark.read.text(f"{out}/report").collect()]
    assert report[0] == "# Sample 01 Performance Report" and any("Hard deny:" in line for line in report)
    metrics = spark.read.option("header", True).csv(f"{out}/metrics/metrics").first()
    assert int(metrics.rows_train) + int(metrics.rows_val) + int(metrics.rows_test) == int(metrics.rows_total)


def test_letters_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """A table of one small file: its letters are dealt to tasks, each still in a file of its own."""
    from driver_queries import files as fl

    rows = [(i, f"text  {i}") for i in range(1, 41)] + [(50, "blank")]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(fl, "fresh_path", lambda _, name: str(tmp_path / name))
    got = fl._letter_files(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == [*range(1, 41), 50]
    assert [r.doc_id for r in got if r.is_blank] == [50]
    files = [f.name for f in (tmp_path / "letters").glob("letter=*/*.txt")]
    assert len(files) == 41 and len({name.split("-")[1] for name in files}) > 4


def test_letters_share_folders_and_each_has_one_file(spark, tmp_path, monkeypatch):
    """A folder per letter, and a process per file for its rights, made many letters slow to write and to list."""
    from driver_queries import files as fl

    rows = [(i, f"text  {i} é") for i in range(1, 1200)] + [(7, "text  7 é"), (1250, None), (1251, None), (-3, "minus"), (None, "no id")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(fl, "fresh_path", lambda _, name: str(tmp_path / name))
    got = {r.doc_id: r for r in fl._letter_files(spark, str(tmp_path)).collect()}
    assert len(got) == 1203
    sha1 = lambda text: hashlib.sha1(text.encode()).hexdigest()
    assert got[9].text_sha1 == sha1("text 9 é") and got[7].text_sha1 == sha1("text 7 é text 7 é") and got[-3].text_sha1 == sha1("minus")
    assert [i for i in got if got[i].is_blank] and {i for i in got if got[i].is_blank} == {1250, 1251, *range(50, 1200, 50)}
    files = [f for f in (tmp_path / "letters").rglob("*") if f.is_file()]
    assert len(files) == 1203 and not [f for f in files if f.name.startswith((".", "_"))]
    assert len({f.parent for f in files}) <= 32 * spark.sparkContext.defaultParallelism


def test_letters_outside_a_mounted_folder_are_written_by_spark(spark, tmp_path, monkeypatch):
    from driver_queries import files as fl

    spark.createDataFrame([(1, "a"), (50, "b")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(fl, "_is_mounted", lambda _: False)
    assert {r.doc_id: r.is_blank for r in fl._letter_files(spark, str(tmp_path)).collect()} == {1: False, 50: True}


def test_upload_rows_are_dealt_to_all_tasks(spark, tmp_path):
    """A file of few bytes is one split; its rows, long texts once made, are many tasks' work."""
    from driver_queries import files as fl

    rows = spark.range(1, 201).select(
        F.col("id").alias("o_orderkey"), F.lit("1-URGENT").alias("o_orderpriority"), F.lit("F").alias("o_orderstatus"),
        F.lit("2000-01-01").cast("date").alias("o_orderdate"), F.lit(1.5).alias("o_totalprice"),
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    made = fl.upload_rows(spark, str(tmp_path))
    sizes = made.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= spark.sparkContext.defaultParallelism
    assert sorted(r.row_index for r in made.select("row_index").collect()) == list(range(1, 201))


def test_upload_rows_are_scored_by_methods_that_are_compiled(spark, capsys):
    """The JVM runs a method of more than 8,000 bytes uncompiled; a branch per cell made such methods."""
    import re

    from pyspark.sql import functions as F

    from remitlens.operators import uploads as up
    from remitlens.session import cut_lineage

    names = [*(f"HCPCS_CD_{i}" for i in range(1, 14)), *(f"LINE_ICD9_DGNS_CD_{i}" for i in range(1, 14)),
             "drg_code", "drg_description", "primary_diagnosis_code", "primary_diagnosis_description", "carc_code",
             "carc_description", "rarc_code", "rarc_description", "CLM_FROM_DT", "BENE_BIRTH_DT", "CLM_UTLZTN_DAY_CNT",
             "drg_los_reference", "MEDREIMB_IP"]
    cells = {n: F.when(F.col("row_index") % 5 > 0, F.lit([" ", "nan", "None", "", "x "][i % 5])) for i, n in enumerate(names)}
    rows = spark.range(10).select(
        F.col("id").alias("row_index"), F.lit(1).alias("upload_id"), F.lit("c").alias("claim_id"),
        *[c.alias(n) for n, c in cells.items()],
    ).withColumn("CLM_FROM_DT", F.when(F.col("row_index") % 2 == 0, "199507").otherwise("19951301"))
    table = cut_lineage(rows, "upload")
    texted = table.withColumn("row_text", up.row_text(table, ["upload_id", "row_index"]))
    seen = up.serving_features(texted, ["row_index", "row_text"]).orderBy("row_index").collect()
    assert [(r.hcpcs_count, r.line_icd9_diag_count, r.claim_month) for r in seen[:3]] == [(0, 0, 7), (2, 3, 0), (2, 3, 7)]
    assert (seen[0].row_text, seen[2].row_text) == ("c 199507", "c " + " ".join(["x "] * 6) + " 199507")
    capsys.readouterr()
    up.score_upload(table, None).explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000
