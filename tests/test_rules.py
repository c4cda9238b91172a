"""Rules and hunts on hand-made rows: one positive and one negative per rule, and the traps."""

import pytest
from pyspark.sql import functions as F

from tracelake.content.alert_rules import ALERT_RULES
from tracelake.operators import hunts
from tracelake.plans.views import EVENT_FIELDS
from tracelake.rules import policy, sigma, signatures
from tracelake.rules.alerts import frequency_hits, load_alert_rules, scan_alerts, shipped_alert_rules
from tracelake.rules.predicates import Rule, all_of, catalogue, contains, coverage, ends, scan

SCHEMA = "event_id bigint, ts timestamp_ntz, host string, " + ", ".join(
    f"{f} {'int' if f in ('event_code', 'dst_port') else 'string'}" for f in EVENT_FIELDS)


def table(spark, *rows):
    import datetime as dt

    out = []
    for i, r in enumerate(rows):
        values = [r.get(f) for f in EVENT_FIELDS]
        out.append((i, r.get("ts", dt.datetime(2024, 1, 3, 12, 0)), r.get("host", "h"), *values))
    return spark.createDataFrame(out, SCHEMA)


def ev(channel, code, **kw):
    return {"channel": channel, "event_code": code, **kw}


PS = "C:\\WindowsPowerShell\\PowerShell.EXE"
CASES = {
    "100001": (ev("sysmon", 1, original_file_name="MIMIKATZ.exe"), ev("windows", 1, original_file_name="mimikatz.exe")),
    "100002": (ev("sysmon", 10, target_image="lsass.exe", source_image="x.exe"),
               ev("sysmon", 10, target_image="lsass.exe", source_image="C:\\System32\\x.exe")),
    "100010": (ev("sysmon", 8, target_image="winlogon.exe"), ev("sysmon", 10, target_image="winlogon.exe")),
    "100020": (ev("sysmon", 1, image="certutil.exe", cmdline="-DECODE"), ev("sysmon", 1, image="certutil.exe", cmdline="-dump")),
    "100021": (ev("sysmon", 1, image="regsvr32.exe", cmdline="scrobj.dll"), ev("sysmon", 1, image="regsvr32.exe", cmdline="a.dll")),
    "100022": (ev("sysmon", 1, image="mshta.exe", cmdline="x.hta"), ev("sysmon", 1, image="mshta.exe", cmdline="x.txt")),
    "100030": (ev("sysmon", 1, image=PS, cmdline="-e " + "A" * 20), ev("sysmon", 1, image=PS, cmdline="-e " + "A" * 19)),
    "100031": (ev("sysmon", 1, image=PS, cmdline="net.http"), ev("sysmon", 1, image=PS, cmdline="netxhttp")),
    "100032": (ev("sysmon", 1, image=PS, cmdline="Add-MpPreference -Exclusion"), ev("sysmon", 1, image=PS, cmdline="Get-MpPreference")),
    "100040": (ev("windows", 4698), ev("windows", 46980)),
    "100041": (ev("windows", 4698, task_content="C:\\TEMP\\x"), ev("windows", 4698, task_content="C:\\tempx")),
    "100042": (ev("sysmon", 13, registry_key="HKLM\\software\\microsoft\\windows\\currentversion\\RunOnce"),
               ev("sysmon", 13, registry_key="HKLM\\software\\x")),
    "100050": (ev("windows", 7045, service_name="PsExeSvc"), ev("windows", 7045, service_name="spool")),
    "100051": (ev("windows", 4776, status="0xC000006A"), ev("windows", 4776, status="0xc000006a")),
    "100060": (ev("windows", 104), ev("windows", 1040)),
    "100061": (ev("sysmon", 13, registry_key="x\\Windows Defender\\a\\DisableRealtimeMonitoring"),
               ev("sysmon", 12, registry_key="x\\Windows Defender\\a\\DisableRealtimeMonitoring")),
    "100070": (ev("sysmon", 22, query_name="a.XYZ"), ev("sysmon", 22, query_name="a.xyzzy")),
    "100071": (ev("sysmon", 3, dst_port=8080, initiated="true"), ev("sysmon", 3, dst_port=8081, initiated="true")),
    "100082": (ev("sysmon", 11, file_path="a.LOCKED"), ev("sysmon", 11, file_path="a.lockedx")),
    "100083": (ev("sysmon", 11, file_path="READme_to_DECRYPT.txt"), ev("sysmon", 11, file_path="readme.txt")),
}


@pytest.mark.parametrize("rule_id", sorted(CASES))
def test_alert_rule(spark, rule_id):
    hits = scan_alerts(table(spark, *CASES[rule_id]), ["event_id"]).where(F.col("rule_id") == rule_id)
    assert [r.event_id for r in hits.collect()] == [0]


def test_every_rule_has_a_case():
    assert sorted(CASES) == sorted(r[0] for r in ALERT_RULES)


def test_frequency_rule(spark):
    import datetime as dt

    def files(host, n, seconds):
        start = dt.datetime(2024, 1, 3, 12, 0)
        times = [start + dt.timedelta(seconds=seconds * i / (n - 1)) for i in range(n)]
        return [ev("sysmon", 11, file_path="a.locked", host=host, ts=t) for t in times]

    events = table(spark, *files("fires", 50, 30), *files("few", 49, 30), *files("slow", 50, 31))
    hits = frequency_hits(scan_alerts(events, ["event_id", "ts", "host"]))
    assert [(r.host, r.hits, r.rule_id, r.level) for r in hits.collect()] == [("fires", 50, "100080", 15)]


def test_rule_xml(spark, write):
    path = write("r.xml", """<group name="x"><rule id="1" level="12"><if_group>sysmon_event11</if_group>
      <field name="win.eventdata.targetFilename" type="pcre2">(?i)\\.tmp$</field>
      <field name="win.eventdata.image" type="pcre2" negate="yes">ok</field><description>t</description>
      <mitre><id>T1</id></mitre><group>a,b</group></rule>
      <rule id="2" level="15" frequency="3" timeframe="9"><if_matched_sid>1</if_matched_sid></rule></group>""")
    plain, frequent = load_alert_rules(path)
    rows = table(spark, ev("sysmon", 11, file_path="A.TMP", image="x"), ev("sysmon", 11, file_path="A.TMP", image="ok"))
    assert [(r.event_id, r.level, r.mitre) for r in scan(rows, plain, ["event_id"]).collect()] == [(0, 12, "T1")]
    assert frequent[0][4:7] == ("1", 3, 9)


# ---- Sigma ----------------------------------------------------------------

def sigma_hits(spark, detection, rows, compat=False, **kw):
    fields = sigma.Fields(event_text="cmdline", **kw)
    rule = sigma.sigma_rule({"id": "x", "title": "x", "detection": detection}, fields, compat)
    return [r.event_id for r in scan(table(spark, *rows), [rule], ["event_id"]).orderBy("event_id").collect()]


ROWS = [ev("s", 7045, service_name="PSEXESVC", cmdline="alpha"), ev("s", 1, service_name="psexesvc2", cmdline="beta"),
        ev("s", 7045, service_name="other", cmdline="alpha beta")]


@pytest.mark.parametrize("detection,default,compat", [
    ({"selection": {"EventID": 7045, "ServiceName": ["PSEXESVC"]}, "condition": "selection"}, [0], [0, 1]),
    ({"a": {"EventID": 7045}, "b": {"ServiceName": "psexesvc"}, "condition": "a and b"}, [0], [0, 1]),
    ({"a": {"ServiceName": "psexesvc"}, "b": {"ServiceName": "other"}, "condition": "a or b"}, [0, 1, 2], [0, 1, 2]),
    ({"a": {"ServiceName": "psexesvc"}, "condition": "not a"}, [2], [2]),
    ({"a": {"EventID": 7045}, "b": {"ServiceName": "other"}, "condition": "a and not b"}, [0], []),
    ({"brand": {"ServiceName": "other"}, "condition": "brand"}, [2], []),
    ({"selection": {"ServiceName|startswith": "psexe", "ServiceName|endswith": "2"}, "condition": "selection"}, [1], []),
    ({"selection": {"CommandLine|contains|all": ["alpha", "beta"]}, "condition": "selection"}, [2], []),
    ({"selection": {"ServiceName|re": "^o.*r$"}, "condition": "selection"}, [2], []),
    ({"selection": "beta", "condition": "selection"}, [1, 2], [1, 2]),
    ({"selection": ["beta", {"ServiceName": "PSEXESVC"}], "condition": "selection"}, [0, 1, 2], [0, 1, 2]),
    ({"a": {"EventID": 1}, "b": {"EventID": 7045}, "c": {"ServiceName": "other"}, "condition": "a or (b and not c)"}, [0, 1], []),
    ({"selection": {"Nope": "x"}, "condition": "selection"}, [], []),
])
def test_sigma(spark, detection, default, compat):
    assert sigma_hits(spark, detection, ROWS) == default
    assert sigma_hits(spark, detection, ROWS, compat=True) == compat


def test_shipped_sigma(spark):
    rows = [ev("s", 7045, service_name="psexesvc"), ev("s", 1, image="C:\\x\\reg.exe", cmdline="query \\\\srv\\HKLM"),
            ev("s", 1, image="C:\\x\\REG.exe", cmdline="query HKLM"), ev("s", 1, image="reg.exe", cmdline="\\\\srv"),
            ev("s", 1, image="C:\\x\\cmd.exe", parent_image="C:\\wbem\\WmiPrvSE.exe")]
    hits = scan(table(spark, *rows), sigma.shipped_sigma_rules(), ["event_id"]).orderBy("event_id").collect()
    assert [(r.event_id, r.mitre, r.level) for r in hits] == [(0, "T1021.002", 11), (1, "T1021.002", 8), (4, "T1047", 11)]


def test_sigma_yaml_reads_all_documents(spark, write):
    doc = "id: {0}\ntitle: t\nlevel: low\ndetection:\n  selection:\n    Image|endswith: '\\{0}.exe'\n  condition: selection\n"
    path = write("rules/r.yml", "---\n".join(doc.format(n) for n in ("a", "b", "c")))
    write("rules/bad.yml", "a: [1")
    rules, problems = sigma.load_sigma(path.rsplit("/", 1)[0])
    assert [r.rule_id for r in rules] == ["a", "b", "c"] and len(problems) == 1
    assert [r.rule_id for r in scan(table(spark, ev("s", 1, image="x\\b.exe")), rules, ["event_id"]).collect()] == ["b"]


# ---- signatures -----------------------------------------------------------

SIG = {
    "Mimikatz_Strings": (b"xx LSADUMP::sam", b"lsadump"),
    "PowerShell_Encoded_Download": (b"webclient and iex(", b"webclient only"),
    "Cobalt_Strike_Beacon_Artifacts": (b"\x01\xfc\x48\x83\xe4\xf0\xe8", b"\xfc\x48\x83"),
    "Ransomware_Common_Strings": (b"Bitcoin to x.onion", b"bitcoin"),
    "WMI_Persistence": (b"__EventFilter __EventConsumer", b"__EventFilter __eventconsumer"),
    "Suspicious_PE_Characteristics": (b"MZ VirtualAllocEx WriteProcessMemory", b"XX VirtualAllocEx WriteProcessMemory"),
    "Office_Macro_Dropper": (bytes.fromhex("D0CF11E0A1B11AE1") + b"AutoOpen Shell( https://x", b"AutoOpen Shell( https://x"),
}


@pytest.mark.parametrize("name", sorted(SIG))
def test_signature(spark, name):
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(SIG[name])], "id int, content binary")
    hits = signatures.scan_content(rows, ["id"], content="content").where(F.col("rule_id") == name)
    assert [r.id for r in hits.collect()] == [0]


def test_wide_strings_match_in_bytes_only(spark):
    wide = "mimikatz".encode("utf-16-le")
    rows = spark.createDataFrame([(1, bytearray(b"\x01" + wide)), (2, bytearray(b"mi\x00mi\x00katz"))], "id int, content binary")
    assert [r.id for r in signatures.scan_content(rows, ["id"], content="content").collect()] == [1]


def test_shellcode_counts_below_ten_megabytes_only(spark):
    rows = spark.range(2).select("id", F.concat(F.unhex(F.lit("FC4883E4F0E8")), F.encode(F.repeat(F.lit("x"), (10_485_753 + F.col("id")).cast("int")), "UTF-8")).alias("content"))
    hits = signatures.scan_content(rows, ["id"], content="content").where("rule_id = 'Cobalt_Strike_Beacon_Artifacts'")
    assert [r.id for r in hits.collect()] == [0]


def test_user_signature(spark):
    own = [{"id": "own", "severity": "low", "strings": [("a1", "One", "i"), ("a2", "Two", ""), ("b", "C:\\x's", "")],
            "condition": "{2 of a*} and {1 of b}"}]
    rows = spark.createDataFrame([(1, "ONE Two C:\\x's"), (2, "one two C:\\x's"), (3, "One Two")], "id int, text string")
    assert [r.id for r in signatures.scan_content(rows, ["id"], text="text", signatures=own).collect()] == [1]


# ---- policy ---------------------------------------------------------------

def test_policy(spark):
    rows = [ev("s", 1, image="C:\\x\\SVCHOST.exe"), ev("s", 1, image="a.exe"), ev("s", 3, dst_port=4444),
            ev("s", 3, dst_port=44440), ev("s", 10, target_image="x\\LSASS.exe", source_image="a"),
            ev("s", 10, target_image="x\\lsass.exe", source_image="d\\msmpeng.exe.bak"), ev("s", 10, target_image="a"),
            ev("s", 22, query_name="a.top"), ev("s", 22, query_name="a.top.example"), ev("s", 99)]
    got = {r.event_id: r.collected_as for r in policy.collected(table(spark, *rows)).collect()}
    assert got == {1: "ProcessCreate", 2: "NetworkConnect", 4: "ProcessAccess", 7: "DnsQuery"}


def test_policy_xml(write):
    path = write("p.xml", """<Sysmon><EventFiltering><RuleGroup><ProcessAccess onmatch="include">
      <TargetImage condition="end with">a.exe</TargetImage></ProcessAccess><ProcessAccess onmatch="exclude">
      <SourceImage condition="is">b</SourceImage></ProcessAccess></RuleGroup></EventFiltering></Sysmon>""")
    assert policy.load_policy(path) == {
        "ProcessAccess": ([10], [("TargetImage", "end with", "a.exe")], [("SourceImage", "is", "b")])}


# ---- hunts ----------------------------------------------------------------

def found(spark, rule, *rows, **kw):
    got = hunts.event_findings(table(spark, *rows), only=[rule], **kw)
    return [r.event_id for r in got.orderBy("event_id").collect()]


def test_lolbin(spark):
    rows = [ev("s", 1, image="CertUtil.exe", cmdline="HTTP"), ev("s", 1, image="mshta.exe", cmdline="c:\\TEMP\\x"),
            ev("s", 1, image="mshta.exe", cmdline="base64"), ev("s", 1, image="mshta.exe", cmdline="x"),
            ev("s", 1, image="c:\\mshta.exe\\cmstp.exe", cmdline="http"), ev("s", 1, image="other.exe", cmdline="http")]
    assert found(spark, "HYP-001", *rows) == [0, 1, 2, 4, 4]  # one finding per name


def test_lsass_traps(spark):
    rows = [ev("s", 10, target_image="lsass.exe", source_image="C:\\Windows\\System32\\evil.exe"),
            ev("s", 10, target_image="lsass.exe", source_image="C:\\x\\splunkd.exe"),
            ev("s", 10, target_image="lsass.exe", source_image="C:\\defender\\evil.exe"),
            ev("s", 10, target_image="lsass.exe", source_image="System"), ev("s", 10, target_image="x", source_image="evil")]
    assert found(spark, "HYP-002", *rows) == [0, 2]
    assert found(spark, "HYP-002", *rows, compat=True) == []


def test_encoded_shell(spark):
    rows = [ev("s", 1, image="powershell", cmdline="-EncodedCommand " + "A" * 20), ev("s", 1, image="powershell", cmdline="-e " + "A" * 19),
            ev("s", 1, image="cmd", cmdline="-e " + "A" * 20), ev("s", 1, image="POWERSHELL", cmdline="-E " + "A" * 20)]
    assert found(spark, "HYP-003", *rows) == [0, 3]


def test_off_hours(spark):
    import datetime as dt

    days = [dt.datetime(2024, 1, 3, 7, 59), dt.datetime(2024, 1, 3, 8, 0), dt.datetime(2024, 1, 3, 17, 59),
            dt.datetime(2024, 1, 3, 18, 0), dt.datetime(2024, 1, 6, 12, 0)]
    assert found(spark, "HYP-005", *[ev("windows", 4698, ts=t) for t in days]) == [0, 3, 4]


def test_generated_names(spark):
    names = (["abcdefghijklmnop.example.org"] * 3 + ["qrstuvwxyzabcdef.example.org"] * 2 + ["abcdefghijklm.example.org"] * 9
             + ["abcdefghijklmnop.microsoft.com"] * 5 + ["abcdefghijklmnop.MICROSOFT.com"] * 3 + [None, ""])
    rows = spark.createDataFrame([(n,) for n in names], "query_name string")
    got = {r.query_name: r.queries for r in hunts.generated_names(rows).collect()}
    assert got == {"abcdefghijklmnop.example.org": 3, "abcdefghijklmnop.MICROSOFT.com": 3}


def test_custom_hunt_and_union(spark):
    events = table(spark, ev("s", 1, image="a"))
    own = hunts.custom_hunt(events, "title", lambda e: e.select(F.col("image").alias("what")), "T1", "low",
                            F.lit("2024-01-01").cast("timestamp_ntz"))
    row = own.first()
    assert (row.host, row.description, row.evidence, row.mitre) == ("unknown", "title", {"what": "a"}, "T1")
    assert hunts.all_findings(own, hunts.event_findings(events)).count() == 1


# ---- catalogue and plans --------------------------------------------------

def test_catalogue_and_coverage(spark):
    rules = shipped_alert_rules() + sigma.shipped_sigma_rules()
    cat = catalogue(spark, rules)
    assert cat.count() == len(rules)
    text = cat.where(F.col("rule_id") == "100040").first().predicate
    assert table(spark, ev("windows", 4698), ev("windows", 1)).where(F.expr(text)).count() == 1
    hits = scan_alerts(table(spark, ev("windows", 4698)), ["event_id"])
    got = {r.mitre: (r.rules, r.max_level, r.hits) for r in coverage(cat, hits).collect()}
    assert got["T1053.005"] == (2, 14, 1) and got["T1486"][2] == 0


def test_one_scan_for_all_rules_without_python(spark, tmp_path):
    table(spark, ev("windows", 4698)).write.parquet(f"{tmp_path}/events")
    events = spark.read.parquet(f"{tmp_path}/events")
    df = scan(events, shipped_alert_rules() + sigma.shipped_sigma_rules(), ["event_id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert "analyst" not in plan and "task_content" in plan


def test_gates_change_no_result(spark):
    """The same rules with and without gates, null gate values included; a column named like a prepared one stays itself."""
    rows = spark.createDataFrame(
        [(1, 1, "A.EXE", "x"), (2, 1, "b.dll", "low"), (3, 2, "A.exe", None), (4, None, "a.exe", "x"), (5, 2, None, "x")],
        "event_id int, code int, image string, _low0 string")
    body = {"exe": ends("image", ".exe"), "a": contains("image", "A."), "low": contains("_low0", "LOW")}
    plain = [Rule(f"{n}{code}", n, "low", all_of([f"(code = {code})", test])) for n, test in body.items() for code in (1, 2)]
    gated = [Rule(r.rule_id, r.title, r.severity, r.predicate, gate=f"(code = {r.rule_id[-1]})") for r in plain]
    got = [sorted((r.event_id, r.rule_id, r._low0) for r in scan(rows, rules, ["event_id", "_low0"]).collect()) for rules in (plain, gated)]
    assert got[0] == got[1] == [(1, "a1", "x"), (1, "exe1", "x"), (2, "low1", "low"), (3, "a2", None), (3, "exe2", None)]
    with pytest.raises(ValueError, match="at least one rule"):
        scan(rows, [], ["event_id"])


def test_policy_rules_scan_as_the_policy_collects(spark):
    rows = table(spark, ev("s", 1, image="a.exe"), ev("s", 3, dst_port=4444), ev("s", 10, target_image="x\\LSASS.exe"), ev("s", 99))
    hits = scan(rows, policy.policy_rules(rows.columns), ["event_id"]).collect()
    kept = policy.collected(rows).collect()
    assert sorted((r.event_id, r.rule_id) for r in hits) == sorted((r.event_id, r.collected_as) for r in kept) != []


SELECTORS = {"sel_a": "a = 1", "sel_b": "b = 1", "other": "c = 1"}


@pytest.mark.parametrize("condition, sql", [
    ("sel_a and not other", "(a = 1 and not c = 1)"), ("1 of sel_*", "((a = 1 or b = 1))"), ("all of them", "((a = 1 and b = 1 and c = 1))"),
    ("(sel_a or sel_b) and other", "(( a = 1 or b = 1 ) and c = 1)"), ("unknown", "(false)"),
])
def test_sigma_conditions(condition, sql):
    assert sigma._condition(condition, SELECTORS).replace("( ", "(").replace(" )", ")") == sql.replace("( ", "(").replace(" )", ")")


@pytest.mark.parametrize("condition", ["1 of", "1 of none*", "sel_a and", "(sel_a", "sel_a sel_b", "sel_a; drop", "1", "", "sel_a | count() > 5"])
def test_bad_sigma_conditions_are_named(condition):
    with pytest.raises(ValueError):
        sigma._condition(condition, SELECTORS)


def test_one_bad_rule_leaves_the_others(write):
    good = "id: g\ntitle: t\ndetection:\n  s:\n    Image: x\n  condition: 1 of them\n"
    bad = "id: b\ntitle: t\ndetection:\n  s:\n    Image: x\n  condition: 1 of\n"
    rules, problems = sigma.load_sigma(write("r.yml", f"{good}---\n{bad}"))
    assert [r.rule_id for r in rules] == ["g"] and len(problems) == 1 and ": b: " in problems[0]


def test_broken_xml_is_named(write):
    path = write("broken.xml", "<a><b>")
    for load in (policy.load_policy, load_alert_rules):
        with pytest.raises(ValueError, match="broken.xml"):
            load(path)
    with pytest.raises(ValueError, match="unknown condition"):
        policy.kept([1], [("Image", "nope", "x")], [])
