"""Headline timings: one JSON line on standard output.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores; BENCH_RUNS (default 3) warm runs per query, the median counts.
Every query runs whole into the noop sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

# Query -> tables it reads, for rows per second.
HEADLINE = {
    "ioc_extract_documents": ["documents"],
    "ioc_match_documents_pages": ["documents", "pages"],
    "ioc_match_extended": ["documents"],
    "keyword_match_documents": ["documents", "benchmark"],
    "document_hashes": ["documents"],
    "byte_entropy": ["documents"],
    "signature_scan": ["documents"],
    "suspicious_strings": ["documents"],
    "sample_scores": ["documents"],
    "file_inventory": ["documents"],
    "flow_aggregate": ["lineitem"],
    "flow_suspicious": ["lineitem"],
    "flow_dns_names": ["lineitem", "orders"],
    "top_talkers": ["lineitem"],
    "capture_summary": ["lineitem", "orders"],
    "hidden_processes": ["lineitem", "orders"],
    "timeline_summary": ["events", "orders"],
    "timeline_ordered": ["events", "orders"],
    "rule_scan_multi": ["events"],
    "hunt_all": ["events"],
    "sigma_scan": ["events"],
    "technique_phases": ["events"],
    "burst_windows": ["events"],
    "interval_profile": ["events"],
    "activity_sessions": ["events"],
    "process_tree": ["events"],
    "host_risk_score": ["events"],
    "integrity_verify": ["documents", "labels"],
    "case_report": ["events", "documents"],
    "log_lines": ["events"],
}


def rule_scan(n: int):
    """n different rules in one scan: the cost should grow far slower than n scans.

    No rule is used twice, since Spark may evaluate equal predicates once.
    """
    from tracelake.content.lookups import FLOW_PORTS
    from tracelake.plans.views import telemetry
    from tracelake.rules.alerts import shipped_alert_rules
    from tracelake.rules.policy import policy_rules
    from tracelake.rules.predicates import Rule, equals, scan
    from tracelake.rules.sigma import shipped_sigma_rules

    def build(spark, d):
        events = telemetry(spark, d)
        rules = shipped_alert_rules() + shipped_sigma_rules()
        rules += policy_rules(events.columns)
        rules += [Rule(f"port_{p}", "port", "low", equals("dst_port", p)) for p in FLOW_PORTS]
        assert len({r.predicate for r in rules}) == len(rules) >= n
        return scan(events, rules[:n], ["event_id"])

    return build


def main() -> None:
    from tracelake.plans import registry
    from tracelake.session import build_session

    spark = build_session(f"local[{CPUS}]", int(CPUS), "tracelake-bench")
    spark.sparkContext.setLogLevel("ERROR")
    # The given tables are one row group each: without this, work on texts would be one task.
    spark.conf.set("tracelake.text.partitions", CPUS)
    registry.load_all()
    counts = {t: spark.read.parquet(f"{SF_DIR}/{t}.parquet").count() for ts in HEADLINE.values() for t in ts}
    work = {name: (registry.QUERIES[name], tables) for name, tables in HEADLINE.items()}
    work.update({f"rule_scan_{n}": (rule_scan(n), ["events"]) for n in (1, 10, 40)})
    seconds, rates = {}, {}
    for name, (build, tables) in work.items():
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            build(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        rates[name] = int(sum(counts[t] for t in tables) / seconds[name])
    print(json.dumps({
        "metric": "headline queries, sum of warm medians", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "rows_per_sec": rates, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": int(CPUS), "runs": RUNS, "spark": spark.version,
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")}))
    spark.stop()


if __name__ == "__main__":
    main()
