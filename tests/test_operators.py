"""Operators on hand-made tables."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from tracelake.operators import (
    alerts, cases, evidence, files, flows, hosts, matching, memory, normalize, reputation, samples, timeline,
)
from tracelake.operators.ordered import Sizes
from tracelake.session import cut_lineage

T0 = dt.datetime(2024, 1, 3, 12, 0)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


# ---- flows ----------------------------------------------------------------

PACKETS = "ts timestamp_ntz, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, length bigint"


def test_flows_and_flags(spark):
    mib = 1024 * 1024
    rows = [(at(5), "a", "b", 1, 443, "TCP", 60 * mib), (at(1), "a", "b", 2, 443, "TCP", 40 * mib),
            (at(1), "a", "c", 2, 443, "TCP", 100 * mib + 1), (at(1), "a", "d", 1, 4444, "TCP", 200 * mib)]
    rows += [(at(1), "a", "e", 1, p, "OTHER", 1) for p in (1337, 31337, 8888, 9001, 9030, 6667, 6666)]
    packets = spark.createDataFrame(rows, PACKETS)
    got = {(r.dst_ip, r.dst_port): r for r in flows.flag_flows(flows.flows(packets)).collect()}
    first = got["b", 443]
    assert (first.packet_count, first.bytes_total, first.suspicious) == (2, 100 * mib, False)  # exactly 100 MiB
    assert (first.first_seen, first.last_seen) == (at(1), at(5))
    assert got["c", 443].reason == "Large data transfer: 100.0 MB"
    assert got["d", 4444].reason == "Known C2/malware port: 4444"  # the port wins over the volume
    assert sum(r.suspicious for r in got.values()) == 9
    assert sum(r.bytes_total for r in got.values()) == sum(r[6] for r in rows)
    s = flows.capture_summary(packets).first()
    assert (s.total_packets, s.total_connections, s.suspicious_connections, s.dns_queries) == (len(rows), 10, 9, 0)


def test_top_ties_are_broken_by_name(spark):
    packets = spark.createDataFrame([(at(1), f"h{i:02d}", "d", 1, 1, "TCP", 1) for i in range(15)], PACKETS)
    assert [r.endpoint for r in flows.top_talkers(packets).collect()] == [f"h{i:02d}:1" for i in range(10)]


def test_flow_names_are_as_of(spark):
    f = spark.createDataFrame([("a", "1.1.1.1", at(10)), ("a", "1.1.1.1", at(1)), ("b", "1.1.1.1", at(10))],
                              "src_ip string, dst_ip string, first_seen timestamp_ntz")
    dns = spark.createDataFrame([(at(2), "old", ["1.1.1.1", "2.2.2.2"], "a"), (at(10), "new", ["1.1.1.1"], "a"),
                                 (at(11), "late", ["1.1.1.1"], "a")],
                                "ts timestamp_ntz, query_name string, response_ips array<string>, src_ip string")
    got = {(r.src_ip, r.first_seen): r.dns_name for r in flows.name_flows(f, dns).collect()}
    assert got == {("a", at(10)): "new", ("a", at(1)): None, ("b", at(10)): None}


def test_beacons(spark):
    rows = [("beat", at(60 * i)) for i in range(10)] + [("jitter", at(60 * i + (i * 7) % 40)) for i in range(10)]
    rows += [("few", at(60 * i)) for i in range(3)]
    e = spark.createDataFrame(rows, "k string, ts timestamp_ntz").withColumn("id", F.monotonically_increasing_id())
    profile = flows.interval_profile(e, ["k"], "ts", ["ts", "id"], sizes=Sizes(rows=20))
    got = {r.k: r for r in profile.collect()}
    assert (got["beat"].mean_gap, got["beat"].gap_deviation, got["beat"].near_60) == (60.0, 0.0, 9)
    assert [r.k for r in flows.beacons(profile).collect()] == ["beat"]


def test_egress(spark):
    f = spark.createDataFrame([("a", "203.0.113.1", 60), ("a", "203.0.113.1", 60), ("a", "10.0.0.1", 900), ("a", "203.0.113.2", 900)],
                              "src_ip string, dst_ip string, bytes_total bigint")
    known = spark.createDataFrame([("203.0.113.2",)], "dst_ip string")
    assert [tuple(r) for r in flows.egress_over(f, known, 100).collect()] == [("a", "203.0.113.1", 120)]


# ---- hosts ----------------------------------------------------------------

def test_host_risk_levels(spark):
    procs = spark.createDataFrame([("h20", "CMD.exe"), ("h50", "cmd.exe"), ("h65", "reg.exe"), ("h0", "cmd.exe.bak"), ("h90", "at.exe")],
                                  "host string, name string")
    socks = spark.createDataFrame([("h30", "1.1.1.1:4444"), ("h50", "::1:1337"), ("h65", "x:9001"), ("h0", "x:6667"), ("h90", "x:8888")],
                                  "host string, remote string")
    sess = spark.createDataFrame([(h, i) for h, n in (("h15", 4), ("h0", 3), ("h65", 5), ("h90", 4)) for i in range(n)],
                                 "host string, n int")
    got = {r.host: (r.score, r.rating) for r in hosts.host_risk(procs, socks, sess).collect()}
    assert got == {"h0": (0, "low"), "h15": (15, "low"), "h20": (20, "medium"), "h30": (30, "medium"), "h50": (50, "high"),
                   "h65": (65, "high"), "h90": (65, "high")}
    files_ = spark.createDataFrame([("h90", ".ps1"), ("h0", ".txt")], "host string, extension string")
    full = {r.host: r for r in hosts.host_risk(procs, socks, sess, files_).collect()}
    assert (full["h90"].score, full["h90"].rating, full["h0"].score) == (90, "critical", 0)
    assert full["h90"].actions[0].startswith("CRITICAL") and len(full["h90"].actions) == 4
    assert full["h0"].actions == ["LOW: Continue normal monitoring cadence"]


def test_process_tree_with_reused_ids(spark):
    rows = [(1, "h", 10, 1, at(0), "first"), (2, "h", 20, 10, at(5), "child1"), (3, "h", 10, 1, at(10), "second"),
            (4, "h", 21, 10, at(15), "child2"), (5, "g", 20, 10, at(20), "other host")]
    p = spark.createDataFrame(rows, "id int, host string, pid int, ppid int, create_time timestamp_ntz, name string")
    got = {r.id: r.parent_name for r in hosts.process_tree(p).collect()}
    assert got == {1: None, 2: "first", 3: None, 4: "second", 5: None}


def test_hidden_processes(spark):
    listed = spark.createDataFrame([("i", 2), ("i", 10), ("i", 3), ("i", 4)], "image_id string, pid int")
    scanned = spark.createDataFrame([("i", 2), ("i", 10), ("i", 3), ("i", 4), ("i", 9), ("j", 1)], "image_id string, pid int")
    assert sorted((r.image_id, r.pid) for r in memory.hidden_processes(listed, scanned).collect()) == [("i", 9), ("j", 1)]
    got = {r.image_id: (r.listed, r.scanned, r.hidden, r.tampering_suspected) for r in memory.hidden_summary(listed, scanned).collect()}
    assert got == {"i": (4, 5, 1, True), "j": (0, 1, 1, True)}


# ---- files ----------------------------------------------------------------

def test_file_flags(spark):
    rows = [("/d/a.txt", b"MZ.."), ("/d/a.exe", b"MZ.."), ("/d/tool", b"\x7fELF"), ("/d/a.pdf.exe", b"x"), ("/Temp/a.ps1", b"x"),
            ("/d/" + "n" * 100, b"x"), ("/d/" + "n" * 101, b"x"), ("/d/.hidden", b""), ("/d/a.tmp", b"x")]
    f = spark.createDataFrame([(p, len(c), bytearray(c), 0o644) for p, c in rows], "path string, size bigint, content binary, mode int")
    got = {r.path: r for r in files.inventory(f).collect()}
    assert [len(got[p].reasons) for p, _ in rows] == [1, 0, 1, 1, 1, 0, 1, 0, 0]
    assert got["/d/a.txt"].reasons == ["Executable magic but extension is '.txt'"]
    assert got["/Temp/a.ps1"].reasons == ["Executable/script in suspicious directory (/Temp)"]
    assert got["/d/.hidden"].is_hidden and got["/d/.hidden"].md5 == hashlib.md5(b"").hexdigest()
    assert got["/d/a.txt"].permissions == "0o644"
    assert files.suspicious_files(f).count() == 5


@pytest.mark.parametrize("chunk", [4, 7, 1 << 20])
def test_carving_across_chunks(spark, chunk):
    blob = b"xPK\x03\x04..PK\x03\x04%PDFPK\x03\x04"
    f = spark.createDataFrame([("p", bytearray(blob)), ("e", bytearray())], "path string, content binary")
    got = files.carve(f, [("504B0304", "zip"), ("25504446", "pdf")], chunk)
    assert sorted((r.label, r.offset) for r in got.collect()) == [("pdf", 11), ("zip", 1), ("zip", 7), ("zip", 15)]
    cut = files.carved_slices(f, got, 5).where("label = 'pdf'").first()
    assert bytes(cut["slice"]) == b"%PDFP"


def test_recent_files_cap_after_the_time_filter(spark):
    rows = [(f"/tmp/old{i:03d}", at(-200_000)) for i in range(60)] + [(f"/tmp/z{i:03d}", at(-10)) for i in range(60)]
    f = spark.createDataFrame(rows, "path string, mtime timestamp_ntz")
    got = files.recent_files(f, F.lit(T0), 24, ["/TMP"], 50).collect()
    assert files.recent_files(f, F.lit(T0), 24, ["/TMP"]).count() == 60
    assert len(got) == 50 and all(r.path.startswith("/tmp/z") for r in got)


# ---- evidence -------------------------------------------------------------

def test_verification(spark):
    h = lambda t: (hashlib.md5(t).hexdigest(), hashlib.sha1(t).hexdigest(), hashlib.sha256(t).hexdigest())
    good, bad = h(b"a"), h(b"b")
    ev = [("ok", *good), ("modified", *good), ("sha1only", *good), ("missing", *good), ("upper", good[0].upper(), *good[1:])]
    now = [("ok", *good), ("modified", *bad), ("sha1only", good[0], bad[1], good[2]), ("upper", *good)]
    e = spark.createDataFrame(ev, "source_path string, md5 string, sha1 string, sha256 string")
    n = spark.createDataFrame(now, "path string, md5 string, sha1 string, sha256 string")
    got = {r.source_path: r.status for r in evidence.verify(e, n).collect()}
    assert got == {"ok": "INTACT", "modified": "MODIFIED", "sha1only": "MODIFIED", "missing": "MISSING", "upper": "MODIFIED"}
    two = evidence.verify(e, n, ("md5", "sha256"))
    assert {r.source_path for r in two.collect() if r.intact} == {"ok", "sha1only"}
    t = evidence.verification_totals(two).first()
    assert (t["items"], t.intact_items, t.missing_items, t.all_intact) == (5, 2, 1, False)


def test_drift(spark):
    b = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, h string")
    a = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, h string")
    assert {r.path: r.drift for r in evidence.drift(b, a, "path", "h").collect()} == {
        "a": "unchanged", "b": "changed", "c": "removed", "d": "added"}


def test_custody_check(spark):
    rows = [("ok", 1, "acquired", at(0)), ("ok", 2, "accessed", at(5)), ("bad", 1, "accessed", at(0)), ("bad", 2, "acquired", at(1)),
            ("back", 1, "acquired", at(9)), ("back", 2, "stored", at(3))]
    c = spark.createDataFrame(rows, "evidence_id string, seq bigint, action string, timestamp timestamp_ntz")
    got = {(r.evidence_id, r.seq): r.issue for r in evidence.custody_check(c).collect() if r.issue}
    assert got == {("bad", 1): "not acquired first", ("bad", 2): "acquired again", ("back", 2): "out of order"}


# ---- samples --------------------------------------------------------------

def test_sample_scores(spark):
    pe = b"MZ" + b"UPX!" + b"http://files.example.org/x cmd.exe " * 2 + bytes(range(256)) * 4
    many = b"\x00".join(b"string%d cmd.exe" % i for i in range(9))
    sections = [("high", 7.5), (".text", 5.0)]
    rows = [("pe", bytearray(pe), ["k::VirtualAllocEx"], sections), ("zero", bytearray(64), [], []),
            ("many", bytearray(many), ["k::VirtualAllocEx"], sections), ("noise", bytearray(bytes(range(256)) * 4), [], [])]
    s = spark.createDataFrame(rows, "sample_id string, content binary, imports array<string>, sections array<struct<name:string,entropy:double>>")
    got = {r.sample_id: r for r in samples.analyze(s).collect()}
    assert got["zero"].threat_score == 0 and got["zero"].entropy == 0.0
    assert got["noise"].threat_score == 25 + 0  # entropy 8
    assert got["many"].threat_score == 20 + 10  # capped strings; cmd.exe counts as a domain; no executable, no imports
    assert got["pe"].threat_score == 100  # 25 + 20 + 30 + 15 + 3 + 10, capped
    assert [x.suspicious for x in got["pe"].sections] == [True, False]
    assert any(i.startswith("Process injection APIs") for i in got["pe"].threat_indicators)


# ---- matching -------------------------------------------------------------

FEED = "ioc_type string, value string, source string"


def test_event_match(spark):
    events = spark.createDataFrame([(1, '{"m": "A.Example.org 198.51.100.7 198.51.100.7 999.1.1.1"}'), (2, "{}")], "id int, raw string")
    feed = spark.createDataFrame([("ip", "198.51.100.7", "x"), ("ip", "198.51.100.7", "y"), ("domain", "a.example.org", "x"),
                                  ("ip", "999.1.1.1", "x"), ("domain", "198.51.100.7", "x")], FEED)
    got = matching.match_events(events, "raw", ["id"], feed)
    assert sorted((r.value, r.source) for r in got.collect()) == [
        ("198.51.100.7", "x"), ("198.51.100.7", "y"), ("999.1.1.1", "x"), ("a.example.org", "x")]
    assert matching.match_events(events, "raw", ["id"], feed, per_occurrence=True).count() == 6


@pytest.mark.parametrize("salts", [1, 3, 16])
def test_salted_match_is_the_same(spark, salts):
    tokens = spark.createDataFrame([(i, "ip", "hot" if i % 3 else f"v{i}") for i in range(300)], "id int, ioc_type string, value string")
    feed = spark.createDataFrame([("ip", "hot", "a"), ("ip", "hot", "b"), ("ip", "v3", "c")], FEED)
    assert matching.match_tokens(tokens, feed, salts).count() == 401


def test_digest_match_and_counts(spark):
    h = hashlib.md5(b"x").hexdigest()
    rows = spark.createDataFrame([(h.upper(),), ("short",)], "h string")
    feed = spark.createDataFrame([("hash_md5", h, "s"), ("hash_sha1", h, "s")], FEED)
    assert matching.match_digests(rows, "h", feed).count() == 1
    assert {r.ioc_type: r.n for r in matching.feed_counts(feed).collect()}["cve"] == 0
    rep = spark.createDataFrame([("ip", "b", 3)], "ioc_type string, value string, hits int")
    ind = spark.createDataFrame([("ip", v) for v in "abcab"], "ioc_type string, value string")
    assert [(r.value, r.hits) for r in matching.enrich(ind, rep, 2).orderBy("value").collect()] == [("a", None), ("b", 3)]


# ---- cases and alerts -----------------------------------------------------

def test_case_workflow(spark):
    c = spark.createDataFrame([("c1", "kim", "identification", "high", "malware"), ("c2", "lee", "closed", "high", "nope")],
                              "case_id string, lead_analyst string, current_phase string, severity string, category string")
    assert cases.valid_cases(c).count() == 1
    tasks = cases.seed_tasks(c)
    assert tasks.count() == 5 and tasks.select("task_id").distinct().count() == 5
    assert cases.seed_tasks(c).exceptAll(tasks).count() == 0  # ids repeat
    got = {r.case_id: r.n for r in c.select("case_id", cases.next_phase("current_phase").alias("n")).collect()}
    assert got == {"c1": "containment", "c2": "closed"}
    notes = spark.createDataFrame([("c1", at(i), f"n{i}", "kim", "x" * 200) for i in range(6)],
                                  "case_id string, ts timestamp_ntz, note_id string, author string, content string")
    assert [r.note_id for r in cases.last_notes(notes, 5).orderBy("rank").collect()] == ["n5", "n4", "n3", "n2", "n1"]
    assert cases.last_notes(notes).count() == 6
    ind = spark.createDataFrame([("c1", "a"), ("c1", "a"), ("c1", "b")], "case_id string, value string")
    rows = cases.status_rows(c, tasks, notes, ind).where("case_id = 'c1'").collect()
    assert [r.text for r in rows if r.section == "summary"] == ["IOCs: 2, Open Tasks: 5"]
    log = spark.createDataFrame([("c1", at(0), "identification"), ("c1", at(90), "containment")], "case_id string, ts timestamp_ntz, phase string")
    assert {r.phase: r.seconds for r in cases.phase_durations(log, Sizes(rows=1)).collect()} == {"identification": 90, "containment": None}


def test_actions(spark):
    rows = [("A1", "block_ip", "1.1.1.1", True, "undo"), ("A2", "kill_process", "p", False, None), ("A3", "disable_task", "t", True, "")]
    a = spark.createDataFrame(rows, "action_id string, action_type string, target string, reversible boolean, reversal_command string")
    got = cases.reversal_guide(a).collect()
    assert [(r.line, r.reversal) for r in got] == [("[block_ip] 1.1.1.1", "Reversal: undo")] and "outbound" in got[0].note
    b = spark.createDataFrame([("b", T0)], "id string, ts timestamp_ntz")
    due = {r.regime: r.deadline - T0 for r in cases.notification_deadlines(b, "id", "ts").collect()}
    assert due["GDPR"] == dt.timedelta(hours=72) and due["PCI-DSS"] == dt.timedelta(0) and due["HIPAA"] == dt.timedelta(days=60)


def test_alert_rows(spark):
    rows = [(1, 12, None, "", "10.0.0.1", "h"), (2, None, ["g"], "1.1.1.1", None, None)]
    a = spark.createDataFrame(rows, "alert_id int, rule_level int, rule_groups array<string>, srcip string, agent_ip string, hash string") \
             .withColumn("rule_description", F.lit(None).cast("string"))
    got = {r.alert_id: r for r in normalize.case_alerts(a).collect()}
    assert (got[1].severity, got[1].title, got[1].tags, [o.data for o in got[1].observables]) == (
        4, "[Wazuh] Security Alert", ["wazuh"], ["10.0.0.1", "h"])
    assert (got[2].severity, got[2].tags, [o.data for o in got[2].observables]) == (1, ["g", "wazuh"], ["1.1.1.1"])
    agents = spark.createDataFrame([("active", "x"), ("disconnected", "x"), ("never", "y")], "status string, os string")
    total = alerts.agent_summary(agents).where("overall = 1").first()
    assert (total.total_agents, total.active_agents, total.disconnected_agents) == (3, 1, 1)


def test_timeline_helpers(spark):
    e = spark.createDataFrame([("c", "h2", at(5), 1, "T1059.001", True), ("c", "h1", at(1), 2, None, False), ("c", "h3", at(9), 3, "T9", True)],
                              "case_id string, host string, ts timestamp_ntz, id int, mitre string, bad boolean")
    z = timeline.first_affected(e, ["case_id"], "host", "ts", "id").first()
    assert (z.first_host, z.first_ts) == ("h1", at(1))
    d = timeline.dwell_time(e, ["case_id"], "ts", F.col("bad"), F.col("host") == "h3").first()
    assert d.dwell_seconds == 4
    names = [r[0] for r in e.orderBy("id").select(timeline.technique_name("mitre")).collect()]
    assert names == ["Command and Scripting Interpreter", None, None]


def test_percent_score_is_cut(spark):
    df = spark.createDataFrame([(149, 1000), (0, 0)], "m bigint, t bigint")
    assert [r[0] for r in df.select(reputation.percent_score(F.col("m"), F.col("t"))).collect()] == [14, 0]


def test_checkpoint_cuts_the_plan(spark):
    df = cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2))
    assert "Range" not in df._jdf.queryExecution().optimizedPlan().toString() and df.count() == 10
