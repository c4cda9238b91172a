"""Queries on hosts, memory snapshots and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import paths
from tracelake.operators import files as fs
from tracelake.operators import hosts, memory
from tracelake.plans.registry import query
from tracelake.plans.views import FILES_SQL, files, load, pick, pick_sql, with_sql

# ---- host snapshots -------------------------------------------------------

NAMES = ["powershell.exe", "explorer.exe", "Cmd.exe", "winword.exe", "svchost.exe", "chrome.exe", "outlook.exe",
         "teams.exe", "code.exe", "python.exe", "reg.exe"]
SNAP_SQL = f"""
snap AS (SELECT event_id, ts, 'host-' || user_id AS host, event_type, CAST(props ->> '$.k' AS INT) AS k FROM events),
proc AS (SELECT event_id, host, ts AS create_time, k AS pid, (k * 7) % 100 AS ppid,
  {pick_sql(NAMES, f'k % {len(NAMES)}')} AS name FROM snap),
sock AS (SELECT event_id, host, k AS pid, '198.51.100.' || k || ':' ||
  {pick_sql([443, 80, 4444, 8080, 22, 53, 9001], 'k % 7')} AS remote FROM snap),
sess AS (SELECT host, event_id FROM snap WHERE event_type = 'signup')"""


def snapshots(spark, d):
    e = load(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    snap = e.select("event_id", "ts", F.concat(F.lit("host-"), F.col("user_id").cast("string")).alias("host"),
                    "event_type", k.alias("k"))
    proc = snap.select("event_id", "host", F.col("ts").alias("create_time"), F.col("k").alias("pid"),
                       F.pmod(F.col("k") * 7, F.lit(100)).alias("ppid"),
                       pick(NAMES, F.pmod("k", F.lit(len(NAMES)))).alias("name"))
    remote = F.concat(F.lit("198.51.100."), F.col("k").cast("string"), F.lit(":"),
                      pick([443, 80, 4444, 8080, 22, 53, 9001], F.pmod("k", F.lit(7))).cast("string"))
    sock = snap.select("event_id", "host", F.col("k").alias("pid"), remote.alias("remote"))
    sess = snap.where(F.col("event_type") == "signup").select("host", "event_id")
    return proc, sock, sess


@query("host_risk_score", with_sql(SNAP_SQL, """
p AS (SELECT host, count(*) FILTER (lower(name) IN ('powershell.exe', 'cmd.exe', 'reg.exe')) AS bad,
  string_agg(DISTINCT lower(name), ', ' ORDER BY lower(name)) FILTER (lower(name) IN
    ('powershell.exe', 'cmd.exe', 'reg.exe')) AS names FROM proc GROUP BY host)""", """
s AS (SELECT host, count(*) FILTER (split_part(remote, ':', 2) IN ('4444', '9001')) AS bad FROM sock GROUP BY host)""", """
u AS (SELECT host, count(*) AS n FROM sess GROUP BY host)""", """
r AS (SELECT host, coalesce(p.bad, 0) AS bp, coalesce(s.bad, 0) AS bs, coalesce(u.n, 0) AS un, names
  FROM p FULL JOIN s USING (host) FULL JOIN u USING (host))""", """
t AS (SELECT *, CASE WHEN bp > 0 THEN 20 ELSE 0 END + CASE WHEN bs > 0 THEN 30 ELSE 0 END
  + CASE WHEN un > 3 THEN 15 ELSE 0 END AS score FROM r)""", body="""
SELECT host, score, CASE WHEN score >= 70 THEN 'critical' WHEN score >= 40 THEN 'high' WHEN score >= 20 THEN 'medium'
  ELSE 'low' END AS rating, array_to_string(list_filter([
    CASE WHEN bp > 0 THEN 'Suspicious processes running: ' || names END,
    CASE WHEN bs > 0 THEN 'Suspicious network connections: ' || bs END,
    CASE WHEN un > 3 THEN 'Multiple active sessions: ' || un || ' users logged in' END], lambda x: x IS NOT NULL), '|')
  AS indicators, array_to_string(CASE WHEN score < 20 AND bs = 0 AND un <= 3 THEN ['LOW: Continue normal monitoring cadence'] ELSE
    list_filter([CASE WHEN score >= 70 THEN 'CRITICAL: Isolate host immediately, escalate to senior analyst'
      WHEN score >= 40 THEN 'HIGH: Initiate containment procedures, notify IR lead'
      WHEN score >= 20 THEN 'MEDIUM: Continue monitoring, gather additional artifacts' END,
    CASE WHEN bs > 0 THEN 'Isolate host from network immediately' END,
    CASE WHEN un > 3 THEN 'Investigate concurrent user sessions for unauthorized access' END], lambda x: x IS NOT NULL) END, '|') AS actions FROM t"""))
def _(spark, d):
    r = hosts.host_risk(*snapshots(spark, d))
    return r.select("host", "score", "rating", F.array_join("indicators", "|").alias("indicators"),
                    F.array_join("actions", "|").alias("actions"))


@query("host_risk_with_files", with_sql(SNAP_SQL, FILES_SQL, body="""
SELECT host, CAST(CASE WHEN bool_or(kind = 'p') THEN 20 ELSE 0 END + CASE WHEN bool_or(kind = 's') THEN 30 ELSE 0 END
  + CASE WHEN count(*) FILTER (kind = 'u') > 3 THEN 15 ELSE 0 END + CASE WHEN bool_or(kind = 'f') THEN 25 ELSE 0 END
  AS INTEGER) AS score FROM (
  SELECT host, CASE WHEN lower(name) IN ('powershell.exe', 'cmd.exe', 'reg.exe') THEN 'p' END AS kind FROM proc
  UNION ALL SELECT host, CASE WHEN split_part(remote, ':', 2) IN ('4444', '9001') THEN 's' END FROM sock
  UNION ALL SELECT host, 'u' FROM sess
  UNION ALL SELECT 'host-' || (doc_id % 150), CASE WHEN suffix IN ('.exe', '.ps1', '.dll', '.pdf.exe') THEN 'f' END
    FROM files WHERE folder = '/tmp') GROUP BY host"""))
def _(spark, d):
    recent = files(spark, d).where(F.col("path").startswith("/tmp/")).select(
        F.concat(F.lit("host-"), F.pmod("doc_id", F.lit(150)).cast("string")).alias("host"),
        paths.suffix("name").alias("extension"))
    return hosts.host_risk(*snapshots(spark, d), recent).select("host", "score")


@query("sockets_with_process", with_sql(SNAP_SQL, body="""
SELECT s.event_id, s.host, s.pid, s.remote, coalesce(p.name, 'N/A') AS process FROM sock s
LEFT JOIN (SELECT host, pid, max(name) AS name FROM proc GROUP BY ALL) p USING (host, pid)"""))
def _(spark, d):
    proc, sock, _ = snapshots(spark, d)
    return hosts.sockets_with_process(sock, proc) \
        .select("event_id", "host", "pid", "remote", "process")


@query("suspicious_sockets", with_sql(SNAP_SQL, body="""
SELECT event_id, host, remote FROM sock WHERE split_part(remote, ':', 2) IN ('4444', '1337', '31337', '8888', '9001')"""))
def _(spark, d):
    _, sock, _ = snapshots(spark, d)
    return sock.where(hosts.suspicious_socket("remote")).select("event_id", "host", "remote")


@query("process_tree", with_sql(SNAP_SQL, """
starts AS (SELECT host, pid AS ppid, create_time AS started, max(name) AS parent_name FROM proc GROUP BY ALL)""", body="""
SELECT c.event_id, c.host, c.pid, c.ppid, s.parent_name FROM proc c
ASOF LEFT JOIN starts s ON c.host = s.host AND c.ppid = s.ppid AND c.create_time >= s.started"""))
def _(spark, d):
    proc, _, _ = snapshots(spark, d)
    return hosts.process_tree(proc).select("event_id", "host", "pid", "ppid", "parent_name")


# ---- memory ---------------------------------------------------------------

MEMORY_SQL = """
mem AS (SELECT event_id, user_id, event_type, CAST(props ->> '$.k' AS INT) AS k FROM events)"""


def process_lines(spark, d):
    """Plugin text of events: every tenth line is cut short, every fifth has no thread count."""
    e = load(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    s = lambda c: c.cast("string")
    line = F.when(F.pmod(k, F.lit(10)) == 0, F.concat_ws("\t", s(F.col("event_id")), s(k))) \
        .when(F.pmod(k, F.lit(10)) == 3, F.concat_ws("\t", F.lit("PID"), F.lit("PPID"), F.lit("Name"), F.lit("Offset"),
                                                     F.lit("Threads"), F.lit("Handles"), F.lit("Session"))) \
        .otherwise(F.concat_ws(
            "\t", s(F.col("event_id")), s(k), F.concat(F.col("event_type"), F.lit(".exe")), F.lit("0xff"),
            F.when(F.pmod(k, F.lit(5)) == 1, F.lit("-")).otherwise(s(k)), s(k + 1),
            F.when(F.pmod(k, F.lit(2)) == 1, F.lit("N/A")).otherwise(F.lit("1")), F.lit("True"), F.lit(" t0 ")))
    return e.select(F.concat(F.lit("img-"), s(F.pmod("user_id", F.lit(10)))).alias("image_id"), line.alias("line"))


@query("memory_processes", with_sql(MEMORY_SQL, body="""
SELECT 'img-' || (user_id % 10) AS image_id, CAST(event_id AS INTEGER) AS pid, k AS ppid, event_type || '.exe' AS name,
  CASE WHEN k % 5 = 1 THEN 0 ELSE k END AS threads, k + 1 AS handles, CASE WHEN k % 2 = 1 THEN NULL ELSE 1 END AS session_id,
  TRUE AS wow64, 't0' AS create_time FROM mem WHERE k % 10 NOT IN (0, 3)"""))
def _(spark, d):
    return memory.process_rows(process_lines(spark, d)).drop("offset", "exit_time")


@query("memory_connections", with_sql(MEMORY_SQL, body="""
SELECT 'img-' || (user_id % 10) AS image_id, CAST(event_id AS INTEGER) AS pid,
  CASE WHEN k % 2 = 0 THEN 'fe80::1' ELSE '10.0.0.' || k END AS local_addr, k AS local_port, '203.0.113.' || k AS foreign_addr,
  CASE WHEN k % 3 = 0 THEN 0 ELSE k * 10 END AS foreign_port, event_type AS state FROM mem"""))
def _(spark, d):
    e = load(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    s = lambda c: c.cast("string")
    local = F.concat(F.when(F.pmod(k, F.lit(2)) == 0, "fe80::1").otherwise(F.concat(F.lit("10.0.0."), s(k))), F.lit(":"), s(k))
    remote = F.concat(F.lit("203.0.113."), s(k), F.lit(":"),
                      F.when(F.pmod(k, F.lit(3)) == 0, "*").otherwise(s(k * 10)))
    line = F.concat_ws("\t", F.lit("0x1"), F.lit("TCPv4"), local, remote, F.col("event_type"), s(F.col("event_id")),
                       F.lit("owner"), F.lit("t"))
    lines = e.select(F.concat(F.lit("img-"), s(F.pmod("user_id", F.lit(10)))).alias("image_id"), line.alias("line"))
    return memory.connection_rows(lines).select("image_id", "pid", "local_addr", "local_port", "foreign_addr",
                                                "foreign_port", "state")


@query("memory_modules", """
SELECT image_id, pid, size, name FROM (
  SELECT CAST(conv_id AS VARCHAR) AS image_id, turn, role, CAST(length(text) AS BIGINT) AS size, 'm' || turn AS name,
    CAST(coalesce(last_value(CASE role WHEN 'user' THEN turn + 100 END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
      ROWS UNBOUNDED PRECEDING), 0) AS INTEGER) AS pid FROM conversations) WHERE role <> 'user'""")
def _(spark, d):
    c = load(spark, d, "conversations")
    s = lambda x: x.cast("string")
    size = F.when(F.pmod("turn", F.lit(2)) == 0, s(F.length("text"))) \
            .otherwise(F.concat(F.lit("0x"), F.lower(F.hex(F.length("text")))))
    line = F.when(F.col("role") == "user", F.concat(s(F.col("turn") + 100), F.lit("\tproc.exe"))) \
            .otherwise(F.concat_ws("\t", F.lit("0x7f00"), size, F.concat(F.lit("m"), s(F.col("turn"))), F.lit("C:\\m.dll")))
    lines = c.select(s(F.col("conv_id")).alias("image_id"), F.col("turn").alias("line_no"), line.alias("line"))
    return memory.dll_rows(lines).select("image_id", "pid", "size", "name")


@query("injection_records", """
SELECT image_id, record, count(*) AS lines FROM (SELECT CAST(conv_id AS VARCHAR) AS image_id, CAST(sum(CASE role WHEN 'user'
  THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS record FROM conversations) WHERE record > 0
GROUP BY ALL""")
def _(spark, d):
    c = load(spark, d, "conversations")
    line = F.when(F.col("role") == "user", F.concat(F.lit("PID: "), F.col("turn").cast("string"))).otherwise("detail")
    lines = c.select(F.col("conv_id").cast("string").alias("image_id"), F.col("turn").alias("line_no"), line.alias("line"))
    return memory.injection_records(lines).groupBy("image_id", "record").agg(F.count("*").alias("lines"))


@query("memory_command_lines", """
SELECT CAST(conv_id AS VARCHAR) AS image_id, trim(line) AS command FROM (SELECT conv_id, CASE role
  WHEN 'user' THEN 'Command line : ' || turn || ' ' WHEN 'system' THEN 'a: b' ELSE 'Pid: ' || turn || ' ' || left(text, 9) END
  AS line FROM conversations) WHERE contains(line, 'Command line') OR (contains(line, ': ') AND length(line) > 10)""")
def _(spark, d):
    c = load(spark, d, "conversations")
    turn = F.col("turn").cast("string")
    line = (F.when(F.col("role") == "user", F.concat(F.lit("Command line : "), turn, F.lit(" ")))
            .when(F.col("role") == "system", "a: b")
            .otherwise(F.concat(F.lit("Pid: "), turn, F.lit(" "), F.left("text", F.lit(9)))))
    return memory.command_lines(c.select(F.col("conv_id").cast("string").alias("image_id"), line.alias("line")))


LISTED_SQL = """
listed AS (SELECT DISTINCT l_orderkey % 10 AS image_id, l_orderkey AS pid FROM lineitem),
scanned AS (SELECT DISTINCT o_orderkey % 10 AS image_id, o_orderkey AS pid FROM orders)"""


def pid_sets(spark, d):
    image = lambda c: F.pmod(c, F.lit(10)).alias("image_id")
    return (load(spark, d, "lineitem").select(image("l_orderkey"), F.col("l_orderkey").alias("pid")),
            load(spark, d, "orders").select(image("o_orderkey"), F.col("o_orderkey").alias("pid")))


@query("hidden_processes", with_sql(LISTED_SQL, body="SELECT * FROM scanned EXCEPT SELECT * FROM listed"))
def _(spark, d):
    return memory.hidden_processes(*pid_sets(spark, d))


@query("hidden_summary", with_sql(LISTED_SQL, body="""
SELECT image_id, count(l) AS listed, count(s) AS scanned, count(*) FILTER (l IS NULL) AS hidden,
  count(*) FILTER (l IS NULL) > 0 AS tampering_suspected
FROM (SELECT image_id, pid, 1 AS l FROM listed) FULL JOIN (SELECT image_id, pid, 1 AS s FROM scanned)
  USING (image_id, pid) GROUP BY image_id"""))
def _(spark, d):
    return memory.hidden_summary(*pid_sets(spark, d))


# ---- files ----------------------------------------------------------------

KIND = """CASE WHEN starts_with(head, '4D5A') THEN 'DOS/PE Executable' WHEN starts_with(head, '7F454C46')
  THEN 'ELF Executable (Linux)' END"""
EXT = """CASE suffix WHEN '.pdf.exe' THEN '.exe' WHEN '.tar.gz' THEN '.gz' ELSE suffix END"""
REASONS = f"""list_filter([
  CASE WHEN {KIND} IS NOT NULL AND {EXT} NOT IN ('.exe', '.dll', '.com', '.scr')
    THEN 'Executable magic but extension is ''' || {EXT} || '''' END,
  CASE WHEN suffix = '.pdf.exe' THEN 'Double extension detected' END,
  CASE WHEN {EXT} IN ('.exe', '.dll', '.bat', '.ps1', '.vbs', '.js', '.hta', '.scr', '.com', '.pif')
    AND regexp_matches(path, '(?i)(temp|tmp|appdata|downloads)')
    THEN 'Executable/script in suspicious directory (' || folder || ')' END,
  CASE WHEN length(name) > 100 THEN 'Unusually long filename (' || length(name) || ' chars)' END], lambda x: x IS NOT NULL)"""


@query("file_inventory", with_sql(FILES_SQL, body=f"""
SELECT doc_id, path, name, {EXT} AS extension, size, md5(content) AS md5, sha256(content) AS sha256,
  '0o' || CASE mode WHEN 420 THEN '644' WHEN 493 THEN '755' WHEN 2541 THEN '4755' ELSE '2755' END AS permissions,
  array_to_string({REASONS}, '|') AS reasons, len({REASONS}) > 0 AS is_suspicious FROM files"""))
def _(spark, d):
    r = fs.inventory(files(spark, d))
    return r.select("doc_id", "path", "name", "extension", "size", "md5", "sha256", "permissions",
                    F.array_join("reasons", "|").alias("reasons"), "is_suspicious")


@query("suspicious_files", with_sql(FILES_SQL, body=f"SELECT doc_id FROM files WHERE len({REASONS}) > 0"))
def _(spark, d):
    return fs.suspicious_files(files(spark, d)).select("doc_id")


@query("mac_timeline", with_sql(FILES_SQL, body="""
SELECT mtime AS ts, 'modified' AS event_type, path, size FROM files
UNION ALL SELECT atime, 'accessed', path, size FROM files UNION ALL SELECT ctime, 'changed/created', path, size FROM files"""))
def _(spark, d):
    return fs.mac_timeline(files(spark, d))


@query("recent_files", with_sql(FILES_SQL, body="""
SELECT folder, path, mtime, CAST(rank AS INTEGER) AS rank FROM (SELECT folder, path, mtime,
  row_number() OVER (PARTITION BY folder ORDER BY path) AS rank FROM files
  WHERE folder IN ('/tmp', '/home/a/Downloads') AND mtime > TIMESTAMP '2024-01-30') WHERE rank <= 50"""))
def _(spark, d):
    r = fs.recent_files(files(spark, d), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), 24,
                        ["/tmp/", "/home/a/Downloads/"], per_folder=50)
    return r.select("folder", "path", "mtime", "rank")


@query("privileged_files", with_sql(FILES_SQL, body="SELECT doc_id, path FROM files WHERE mode IN (2541, 1517)"))
def _(spark, d):
    return fs.privileged_files(files(spark, d)).select("doc_id", "path")


@query("changed_system_files", with_sql(FILES_SQL, body="""
SELECT doc_id, path, mtime FROM files WHERE folder = '/usr/bin' AND mtime > TIMESTAMP '2024-01-29'"""))
def _(spark, d):
    return fs.changed_system_files(files(spark, d), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), 2) \
        .select("doc_id", "path", "mtime")


@query("prefetch_order", with_sql(FILES_SQL, body="SELECT name, mtime FROM files ORDER BY mtime DESC, name"))
def _(spark, d):
    return fs.prefetch_order(files(spark, d)).select("name", "mtime")


@query("carved_markers", with_sql(FILES_SQL, """
heads AS (SELECT unnest(['4D5A', '7F454C46', '504B0304', '25504446', 'D0CF11E0', '89504E47', 'FFD8FF', '1F8B',
  '377ABCAF', '52617221']) AS signature)""", body="""
SELECT signature, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(at_head) AS BIGINT) AS heads FROM (
  SELECT signature, starts_with(hex(content), signature)::INT AS at_head,
    len(list_filter(range(1, length(hex(content)), 2), lambda i: substr(hex(content), i, length(signature)) = signature)) AS hits
  FROM files, heads WHERE contains(hex(content), signature)) GROUP BY signature HAVING sum(hits) > 0"""))
def _(spark, d):
    found = fs.carve(files(spark, d).select("path", "content"))
    return found.groupBy("signature").agg(F.count("*").alias("hits"), F.count_if(F.col("offset") == 0).alias("heads"))
