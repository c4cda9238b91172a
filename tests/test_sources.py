"""Readers on hand-made files."""

import json

import pytest
from pyspark.sql import functions as F

from tracelake.operators import memory, normalize, timeline
from tracelake.sources import events as ev
from tracelake.sources import feeds
from tracelake.sources import files as fl


def lines(rows):
    return "\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n"


RAW = [
    {"process": {"Image": "C:\\A.exe", "CommandLine": "a"}, "agent": {"name": "h1"}, "host": "h9"},
    {"process": {}, "data": {"Image": "", "exe": "B.exe", "cmdline": "b"}, "host": "h2"},
    {"Image": "", "process_name": "c.exe", "agent": {"name": ""}, "host": "h3"},
    {"TargetImage": "x\\lsass.exe", "dns": {"question": {"name": "q.example.org"}}},
]


def test_raw_events(spark, write):
    path = write("e.json", lines([RAW[0], '{"cut', "", *RAW[1:]]))
    got = normalize.canonical_events(ev.read_events(spark, path)).collect()
    assert [r.image for r in got] == ["C:\\A.exe", "B.exe", "c.exe", ""]
    assert [r.cmdline for r in got] == ["a", "b", "", ""]
    assert [r.host for r in got] == ["h1", "h2", "h3", "unknown"]
    assert [r.match_host for r in got] == ["h9", "h2", "h3", "unknown"]
    assert got[3].query_name == "q.example.org" and got[3].target_image == "x\\lsass.exe"
    skipped = ev.skipped_lines(spark, path).first()
    assert skipped.skipped == 1


def test_event_array(spark, write):
    assert ev.read_events(spark, write("e.json", json.dumps(RAW)), array=True).count() == len(RAW)
    assert ev.events_from_rows(spark, [json.dumps(r) for r in RAW] + ["bad"]).count() == len(RAW)


ALERTS = [
    {"id": "1", "timestamp": "2024-01-02T03:04:05.000Z", "rule": {"id": "100001", "level": 15, "description": "d"},
     "agent": {"name": "h1", "ip": "10.0.0.1"}, "syscheck": {"path": "/x"}},
    {"id": "2", "@timestamp": "2024-01-02T03:04:05.123456Z", "rule": {"level": 2}},
    {"id": "3", "timestamp": "2024-01-02T03:04:05.1+0100", "agent": {}},
    {"id": "4", "timestamp": "garbage", "rule": {"level": 5}},
    {"id": "5", "rule": {"level": 9}},
]


def test_alert_timeline(spark, write):
    alerts = ev.read_alerts(spark, write("a.json", lines([*ALERTS, '{"bad'])))
    assert alerts.count() == 5
    got = ev.alert_timeline(alerts).orderBy("ts").collect()
    assert [(r.severity, r.host, r.description, r.event_id, r.file_path) for r in got] == [
        ("low", "unknown", "Wazuh Alert", None, None), ("critical", "h1", "d", "100001", "/x"),
        ("info", "unknown", "Wazuh Alert", None, None)]
    assert json.loads(got[1].raw) == ALERTS[0]


def test_telemetry_timeline(spark, write):
    text = ("UtcTime,TimeCreated,EventID,Computer,User,Image,ProcessName,ProcessId,ParentImage,TargetFilename,ImageLoaded,"
            "DestinationIp,DestinationPort,TargetObject,Details,QueryName\n"
            "2024-01-02 03:04:05,,1,h1,u,i.exe,,0,p.exe,,,,,,,\n"
            "2024-01-02 03:04:06,,3,h1,u,i.exe,,7,,,,198.51.100.7,443,,,\n"
            "2024-01-02 03:04:07,,3,h1,u,i.exe,,7,,,,198.51.100.7,,,,\n"
            ",2024-01-02 03:04:08,99,,,,n.exe,,,,d.dll,,,,,\n"
            ",,1,h1,,,,,,,,,,,,\n")
    got = ev.telemetry_timeline(ev.read_telemetry_csv(spark, write("t.csv", text))).orderBy("ts").collect()
    assert len(got) == 4
    assert got[0].description == "Process Created: i.exe (PID:0) Parent:p.exe" and got[0].pid is None
    assert [r.network_info for r in got] == [None, "198.51.100.7:443", None, None]
    assert (got[3].category, got[3].host, got[3].process, got[3].file_path) == ("other", "unknown", "n.exe", "d.dll")
    assert got[3].description == "Sysmon Event 99"


def test_windows_events(spark, write):
    rows = [{"System": {"EventID": 4624, "Computer": "h", "TimeCreated": {"SystemTime": "2024-01-02T03:04:05Z"}},
             "EventData": {"a": "b" * 200}},
            {"System": {"EventID": "4688", "TimeCreated": "2024-01-02 03:04:06"}},
            {"System": {"EventID": 7045, "TimeCreated": "no"}}]
    got = ev.windows_timeline(ev.read_events(spark, write("w.json", lines(rows))), 100).orderBy("ts").collect()
    assert [(r.category, r.host) for r in got] == [("auth", "h"), ("process", "unknown")]
    assert len(got[0].description) == len("EventID 4624: ") + 100


def test_windows_xml(spark, write):
    xml = ('<Events xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><Event><System><EventID>4624</EventID>'
           '<Level>4</Level><TimeCreated SystemTime="2024-01-02T03:04:05.5Z"/></System><EventData><Data Name="u">x</Data>'
           "</EventData></Event></Events>")
    got = ev.read_windows_xml(spark, write("w.xml", xml)).collect()
    assert [(r.event_id, r.level) for r in got] == [(4624, "4")] and got[0].ts is not None
    assert ev.read_windows_xml(spark, write("bad.xml", "no xml at all")).count() == 0


def test_notes_join_the_timeline(spark):
    notes = spark.createDataFrame([("2024-01-02 03:04:05", "seen", "kim", None)],
                                  "ts_text string, note string, analyst string, host string")
    row = timeline.union_timelines(ev.note_timeline(notes), ev.note_timeline(notes)).first()
    assert (row.source, row.host, row.severity, row.analyst_note) == ("Analyst: kim", "N/A", "info", "seen")


def test_log_lines(spark, write):
    text = lines([
        {"@timestamp": "2024-01-02T03:04:05Z", "host": "h", "level": 3, "msg": "m", "EventID": 7}, '{"broken":',
        "2024-01-02 03:04:05  Warning  Security  4625  failed logon", "<13>Jan  5 10:11:12 srv sshd[1]: hello: there",
        "Jan 15 10:11:12 srv cron: x", "1 2024-01-02T03:04:05Z host app - - - rfc5424", "free text", "  "])
    got = {r.raw[:8]: r for r in ev.read_logs(spark, write("l.log", text), year=2024).collect()}
    assert len(got) == 7
    j = got['{"@times']
    assert (j.source, j.level, j.message, j.event_id, j.format) == ("h", "3", "m", 7, "json")
    w = got["2024-01-"]
    assert (w.source, w.level, w.event_id, w.message) == ("Security", "WARNING", 4625, "failed logon")
    s = got["<13>Jan "]
    assert (s.source, s.message, s.process, s.format) == ("srv", "hello: there", "sshd[1]", "syslog")
    assert {got[k].format for k in ('{"broken', "1 2024-0", "free tex")} == {"unknown"}


def test_event_blocks(spark, write):
    text = "Event[0]:\n  Event ID: 4624\n  Date: 2024-01-02T03:04:05\nEvent[1]:\n  Event ID: 4625\n  Event ID: 1\n"
    got = ev.read_event_blocks(spark, write("b.txt", text)).collect()
    assert [r.fields["Event ID"] for r in got] == ["4624", "1"]
    assert got[0].fields["Date"] == "2024-01-02T03:04:05"


def test_feed_csv(spark, write):
    text = ("value,type,source,confidence,severity,tags,description\n"
            " A.Example.ORG ,Domain,s,80,high,\"a,b\",d\n198.51.100.7,,,,,,\n,ip,,,,,\nx,ip,,abc,,,\nx,nope,,1,,,\n")
    got = feeds.read_feed_csv(spark, write("f.csv", text)).collect()
    assert [(r.value, r.ioc_type, r.confidence, r.severity, r.tags) for r in got] == [
        ("a.example.org", "domain", 80, "high", ["a", "b"]), ("198.51.100.7", "ip", 50, "medium", [])]
    renamed = feeds.read_feed_csv(spark, write("g.csv", "ioc,kind\nb.example.org,domain\n"), {"value": "ioc", "type": "kind"})
    assert [(r.value, r.ioc_type) for r in renamed.collect()] == [("b.example.org", "domain")]


def test_event_export_and_pulse(spark, write):
    export = {"Event": {"info": "I", "Attribute": [
        {"type": "ip-dst|port", "value": "198.51.100.7|443", "comment": "c", "Tag": [{"name": "t"}]},
        {"type": "md5", "value": "ABC", "confidence": 0}, {"type": "other", "value": "x"}, {"type": "url", "value": " "}]}}
    path = write("m.json", json.dumps([export]))
    got = feeds.read_event_export(spark, path).collect()
    assert [(r.value, r.ioc_type, r.confidence, r.source) for r in got] == [
        ("198.51.100.7", "ip", 75, "I"), ("abc", "hash_md5", 75, "I")]
    assert feeds.read_event_export(spark, path, split_composite=False).first().value == "198.51.100.7|443"
    pulse = {"name": "P", "indicators": [{"type": "IPv6", "indicator": "FE80::1"}, {"type": "CVE", "indicator": "CVE-2021-1",
             "confidence": 10}, {"type": "Mutex", "indicator": "m"}]}
    p = feeds.read_pulse(spark, write("p.json", json.dumps(pulse)))
    assert [(r.value, r.ioc_type, r.confidence) for r in p.collect()] == [("fe80::1", "ip", 75), ("cve-2021-1", "cve", 10)]
    both = feeds.union_feeds(feeds.read_event_export(spark, path), p, feeds.read_event_export(spark, path))
    assert both.count() == 6
    assert feeds.union_feeds(both, distinct=True).count() == 4


def test_packets(spark, write):
    layer = lambda **k: {"_source": {"layers": {n.replace("_", "."): [v] for n, v in k.items()}}}
    rows = [layer(ip_src="a", ip_dst="b", tcp_srcport="1", tcp_dstport="443", frame_time__epoch="1.5", frame_len="60"),
            layer(ip_src="a", ip_dst="b", udp_srcport="1", udp_dstport="53", frame_len="x"), layer(ip_src="a")]
    rows[0]["_source"]["layers"]["frame.time_epoch"] = ["1704164645.25"]
    got = fl.read_packets(spark, write("p.json", json.dumps(rows))).collect()
    assert [(r.protocol, r.dst_port, r.length) for r in got] == [("TCP", 443, 60), ("UDP", 53, 0), ("OTHER", 0, 0)]
    assert str(got[0].ts).startswith("2024-01-02")


def test_memory_text(spark, write):
    write("img1.txt", "100\texplorer.exe\n0x1\t0x10\ta.dll\tC:\\a.dll\tt\n0x2\t32\tb.dll\tC:\\b.dll\n"
                      "0x3\tzz\tbad.dll\tC:\\c.dll\n200 svchost.exe\n0x1\t1\tc.dll\tC:\\c.dll\n0x9\tshort\n")
    path = write("img2.txt", "0x5\t8\tno_header.dll\tC:\\x\n")
    rows = fl.read_plugin_lines(spark, path.rsplit("/", 1)[0])
    got = memory.dll_rows(rows).collect()
    assert sorted((r.image_id, r.pid, r.size, r.name) for r in got) == [
        ("img1", 100, 16, "a.dll"), ("img1", 100, 32, "b.dll"), ("img1", 200, 1, "c.dll"), ("img2", 0, 8, "no_header.dll")]


def test_memory_tables(spark):
    t = lambda *x: spark.createDataFrame([("i", v) for v in x], "image_id string, line string")
    p = memory.process_rows(t("4\t0\tSystem\t0x\t-\t5\tN/A", "8\t4\tx\t0x\t3\t5\t1\tTrue\tt0\t", "PID\tx", "9\tx\ty\tz\t1\t2\t3"))
    assert [(r.pid, r.threads, r.session_id, r.wow64, r.create_time) for r in p.collect()] == [
        (4, 0, None, False, None), (8, 3, 1, True, "t0")]
    c = memory.connection_rows(t("0x\tTCP\tfe80::1:445\t1.2.3.4:*\tLISTEN\tx\to\tt", "short\tline"))
    assert [(r.local_addr, r.local_port, r.foreign_port, r.pid) for r in c.collect()] == [("fe80::1", 445, 0, 0)]
    assert [r.name for r in memory.hive_rows(t("0x1\t\\REG ", "x\ty")).collect()] == ["\\REG"]
    assert memory.command_lines(t("Command line", "a: b", "Pid: 1234567", "none")).count() == 2
    assert [r.process for r in memory.signature_hits(t("r\t0x\t4", "r\t0x\t4\tp", "r\t0x")).collect()] == ["N/A", "p"]
    lines_ = spark.createDataFrame([("i", n, v) for n, v in enumerate(["noise", "PID: 1", "a", "b", "Process: 2", "c"])],
                                   "image_id string, line_no bigint, line string")
    recs = memory.injection_records(lines_).groupBy("record").count().orderBy("record").collect()
    assert [tuple(r) for r in recs] == [(1, 3), (2, 2)]


def test_evidence_and_cases(spark, write):
    reg = {"case_id": "C", "evidence_items": [{"evidence_id": "E", "case_id": "C", "custody_log": [
        {"timestamp": "t", "action": "acquired", "actor": "a", "location": "l", "notes": ""}], "tags": ["x"]}]}
    got = fl.read_evidence(spark, write("c.json", json.dumps(reg))).first()
    assert got.evidence_id == "E" and got.custody_log[0].action == "acquired"
    case = {"incident_id": "I", "severity": "high", "category": "malware", "current_phase": "containment",
            "affected_systems": ["h1", "h1"], "iocs": ["x"], "tasks": [{"task_id": "T", "status": "pending"}],
            "notes": [{"note_id": "N", "timestamp": "2024-01-02T03:04:05Z", "content": "c"}],
            "timeline_events": [{"timestamp": "2024-01-02T03:04:05Z", "event": "e"}]}
    tables = fl.read_cases(spark, write("case.json", json.dumps(case)))
    assert {k: v.count() for k, v in tables.items()} == {
        "cases": 1, "tasks": 1, "notes": 1, "log": 1, "indicators": 1, "systems": 1}


def test_host_files(spark, write):
    path = write("passwd", "root:x:0:0:r:/root:/bin/sh\nshort:x\n")
    assert [(r.username, r.home) for r in fl.read_accounts(spark, path).collect()] == [("root", "/root")]
    tasks = write("tasks.csv", '"A","B"\n"1","x, y"\n"2"\n"3","z"\n')
    assert [tuple(r) for r in fl.read_tasks_csv(spark, tasks).orderBy("A").collect()] == [("1", "x, y"), ("3", "z")]
    csv = write("case1/host1/01_processes.csv", "PID,ProcessName\n4,System\n")
    row = fl.read_bundle(spark, csv.rsplit("/", 3)[0], "processes").first()
    assert (row.host, row.case_id, row.ProcessName) == ("host1", "case1", "System")
    js = write("hostA/p.json", json.dumps([{"pid": 1, "name": "x"}]))
    assert fl.read_host_json(spark, js, "pid int, name string").first().host == "hostA"
    files = fl.read_files(spark, csv.rsplit("/", 3)[0])
    assert "content" in files.columns and files.count() >= 2
    auto = spark.createDataFrame([("h", "k", "  upd REG_SZ x "), ("h", "k", "none")], "host string, registry_key string, line string")
    assert fl.autorun_rows(auto).collect()[0].entry == "upd REG_SZ x"


def test_sandbox_reports(spark, write):
    from tracelake.operators.reputation import behaviours, sandbox_verdicts

    for name, score in (("a", 3.9), ("b", 4.0), ("c", 6.9), ("d", 7.0)):
        calls = [{"category": "file", "api": f"c{i}", "arguments": {"k": "v" * 200}} for i in range(51)]
        path = write(f"ck/{name}.json", json.dumps({
            "info": {"score": score}, "network": {"hosts": [{"ip": "198.51.100.7"}]}, "ttps": [{"ttp": "T1"}],
            "behavior": {"processes": [{"process_name": "p", "pid": 1, "calls": calls}]}}))
    folder = path.rsplit("/", 1)[0]
    got = {r.report_id: (r.verdict, r.score) for r in sandbox_verdicts(fl.read_sandbox(spark, folder, "cuckoo")).collect()}
    assert got == {"a": ("clean", 39), "b": ("suspicious", 40), "c": ("suspicious", 69), "d": ("malicious", 70)}
    calls = fl.read_sandbox_calls(spark, folder)
    assert calls.count() == 204 and calls.agg(F.max(F.length("detail"))).first()[0] > 200
    assert behaviours(calls, ["report_id", "process_no"], ["call_no"], 50).count() == 200
    for code in (1, 2, 3, 9):
        path = write(f"ar/{code}.json", json.dumps({"data": {"verdict": code, "scores": {"verdict": {"score": 5}}}}))
    got = {r.report_id: r.verdict for r in
           sandbox_verdicts(fl.read_sandbox(spark, path.rsplit("/", 1)[0], "anyrun")).collect()}
    assert got == {"1": "clean", "2": "suspicious", "3": "malicious", "9": "unknown"}
    for pct in (4, 5, 14, 15):
        path = write(f"sv/{pct}.json", json.dumps({"data": {"attributes": {"stats": {"malicious": pct, "harmless": 100 - pct}}}}))
    got = {r.report_id: (r.verdict, r.score) for r in
           sandbox_verdicts(fl.read_sandbox(spark, path.rsplit("/", 1)[0], "service")).collect()}
    assert got == {"4": ("clean", 4), "5": ("suspicious", 5), "14": ("suspicious", 14), "15": ("malicious", 15)}


def test_reputation_reports(spark, write):
    from tracelake.operators.reputation import file_reputation, network_reputation

    many = {f"e{i}": {"category": "malicious", "result": f"n{i:02d}"} for i in range(11)}
    rows = [{"id": "x", "data": {"attributes": {"last_analysis_stats": {"malicious": 2, "suspicious": 1, "harmless": 7},
                                               "last_analysis_results": many, "whois": "w" * 600}}},
            {"id": "y", "data": {"attributes": {"last_analysis_stats": {}}}}, {"id": "z", "error": "not_found"}]
    reports = fl.read_reputation(spark, write("r.json", lines(rows)), "hash")
    got = {r.hash: r for r in file_reputation(reports, names=10).collect()}
    assert got["x"].detection_ratio == "3/10" and len(got["x"].threat_names) == 10
    assert (got["y"].total_engines, got["y"].is_malicious) == (1, False)
    assert got["z"].found is False and got["z"].detections is None
    assert len(next(r for r in file_reputation(reports).collect() if r.hash == "x").threat_names) == 11
    net = {r.hash: r for r in network_reputation(reports, "hash", 500).collect()}
    assert net["x"].detections == 2 and len(net["x"].whois) == 500


@pytest.mark.parametrize("level,expect", [(0, "info"), (2, "info"), (3, "low"), (5, "low"), (6, "medium"), (8, "medium"),
                                          (9, "high"), (11, "high"), (12, "critical"), (None, "low")])
def test_levels(spark, level, expect):
    df = spark.createDataFrame([(level,)], "l int")
    assert df.select(normalize.level_severity("l")).first()[0] == expect


def test_packed_documents_read_like_files(spark, tmp_path):
    """Readers give the same rows for a file per document and for documents packed many to a file: objects, arrays, cut and empty ones."""
    from tracelake.sinks.writers import packed_files, text_files

    def both(name, documents, read):
        rows = spark.createDataFrame(documents, "name string, text string").repartition(2)
        text_files(rows, str(tmp_path / name)).count()
        packed_files(rows, str(tmp_path / f"{name}-packed"))
        one, many = read(str(tmp_path / name), False), read(str(tmp_path / f"{name}-packed"), True)
        assert one.columns == many.columns and sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
        return many

    cuckoo = [("r1.json", '{"info": {"score": 7.5},\n "behavior": {"processes": [{"process_name": "p", "calls": [{"api": "a"}, {"api": "b"}]}]}}'),
              ("r2.x.json", '[{"info": {"score": 1}}, {"target": null}]'), ("r3.json", '{"info": {"score": 7'), ("r4.json", ""), ("r5.json", "[]")]
    assert both("sandbox", cuckoo, lambda p, packed: fl.read_sandbox(spark, p, "cuckoo", packed)).count() == 4
    assert both("calls", cuckoo, lambda p, packed: fl.read_sandbox_calls(spark, p, packed)).count() == 2
    registry = [(f"{i}.json", json.dumps({"case_id": f"C{i}", "evidence_items": [{"evidence_id": f"E{i}", "custody_log": [{"actor": "é"}]}] * i})) for i in range(3)]
    assert both("registry", registry, lambda p, packed: fl.read_evidence(spark, p, packed)).count() == 3
    cases = [(f"{i}.json", json.dumps({"incident_id": f"I{i}", "tasks": [{"task_id": "a"}, {"task_id": "b"}]})) for i in range(3)]
    assert both("cases", cases, lambda p, packed: fl.read_cases(spark, p, packed)["tasks"]).count() == 6
    hosts = [(f"h{i}/processes.json", '[{"pid": 1, "name": "x"}, {"pid": 2}]') for i in range(3)]
    assert both("hosts", hosts, lambda p, packed: fl.read_host_json(spark, p if packed else p + "/*", "pid int, name string", packed=packed)).count() == 6
    bundle = [(f"c/pc{i}/01_processes.csv", 'PID,Process Name\r\n1,"a, ""b"""\n\n2,\n3,"",more\n4\n') for i in range(2)]
    bundle += [("c/pc9/05_services.csv", "x,y\n1,2\n"), ("c/pc8/01_processes.csv", "PID,Process Name\n"), ("c/pc7/01_processes.csv", "")]
    assert both("bundle", bundle, lambda p, packed: fl.read_bundle(spark, p, "processes", packed)).count() == 8
    malformed = both("malformed", bundle, lambda p, packed: fl.read_host_csv(spark, p if packed else f"{p}/*/*/01_processes.csv", True, "01_processes.csv" if packed else None))
    assert malformed.count() == 4
