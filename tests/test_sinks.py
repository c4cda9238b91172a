"""Writers: what is written reads back."""

from pyspark.sql import functions as F

from tracelake.operators import evidence, flows, reports
from tracelake.operators.files import mac_timeline
from tracelake.plans import views
from tracelake.plans.cases import evidence_items
from tracelake.sinks import writers

SF = "/root/testdata/sf0.001"


def test_timeline(spark, tmp_path):
    t = views.timeline(spark, SF)
    writers.timeline_csv(t, f"{tmp_path}/csv")
    back = spark.read.option("header", True).csv(f"{tmp_path}/csv")
    assert back.count() == t.count() and len(back.columns) == 13 and back.columns[0] == "Timestamp (UTC)"
    writers.timeline_json(t, f"{tmp_path}/json")
    total = spark.read.json(f"{tmp_path}/json/summary").where("dimension = 'total'").first()
    assert total.events == spark.read.json(f"{tmp_path}/json/events").count()


def test_flows_and_files(spark, tmp_path):
    f = flows.flag_flows(flows.flows(views.packets(spark, SF)))
    writers.flows_csv(f, f"{tmp_path}/flows")
    assert len(spark.read.option("header", True).csv(f"{tmp_path}/flows").columns) == 11
    writers.mac_csv(mac_timeline(views.files(spark, SF)), f"{tmp_path}/mac")
    assert spark.read.option("header", True).csv(f"{tmp_path}/mac").count() == 3 * views.files(spark, SF).count()


def test_evidence(spark, tmp_path):
    items = evidence_items(spark, SF)
    writers.evidence_csv(items, f"{tmp_path}/log")
    assert len(spark.read.option("header", True).csv(f"{tmp_path}/log").columns) == 14
    writers.load_file(items, f"{tmp_path}/dat")
    lines = spark.read.text(f"{tmp_path}/dat")
    header = evidence.load_file_header()
    assert lines.where(F.col("value") == header).count() >= 1
    rows = lines.where(F.col("value") != header)
    assert rows.count() == items.count()
    assert rows.where(F.size(F.split("value", "þ")) != 10).count() == 0
    writers.custody_table(evidence.custody_rows(items), f"{tmp_path}/custody")
    assert spark.read.parquet(f"{tmp_path}/custody").count() == 2 * items.count()


def test_hits_and_reports(spark, tmp_path):
    hit = spark.createDataFrame([("t", "h", "v", "hash_sha256", "high", 80, "s", "d" * 150)],
                                "hit_time string, host string, value string, ioc_type string, severity string, "
                                "confidence int, source string, description string")
    writers.hits_csv(hit, f"{tmp_path}/hits", width=100)
    row = spark.read.option("header", True).csv(f"{tmp_path}/hits").first()
    assert row["Matched Field"] == "sha256" and len(row["Description"]) == 100
    findings = reports.findings_section(hit, "host", "x", {"value": F.col("value")})
    writers.report_table(findings, f"{tmp_path}/report")
    assert spark.read.parquet(f"{tmp_path}/report").where("case_id = 'h'").count() == 1
    writers.json_table(findings, f"{tmp_path}/log.json")
    writers.json_table(findings, f"{tmp_path}/log.json")
    assert spark.read.json(f"{tmp_path}/log.json").count() == 2
