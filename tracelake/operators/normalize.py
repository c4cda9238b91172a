"""Canonical columns, severities, categories, descriptions and outgoing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.content import messages
from tracelake.content.lookups import (
    BUNDLE_OBSERVABLES, LEVEL_THRESHOLDS, SEVERITY_NUMBER, TELEMETRY_CATEGORY,
    TELEMETRY_DESCRIPTION,
)
from tracelake.functions.hashing import digest_kind, sha256_field
from tracelake.functions.text import cut, fill, filled
from tracelake.operators.ordered import first_per_group


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- raw events -----------------------------------------------------------

def variant_text(event, *paths: str) -> Column:
    """First non-empty text among the paths of a VARIANT event."""
    event = _col(event)
    return filled(*[F.try_variant_get(event, p, "string") for p in paths])


def _with_content(event, path: str) -> Column:
    """The nested object exists and has fields: {} counts as missing."""
    text = F.try_variant_get(_col(event), path, "string")
    return F.coalesce((text != "{}") & (text != ""), F.lit(False))


def process_field(event, names: list[str], nests=("process", "data", None)) -> Column:
    """A process field: the first nest that is present decides where to look."""
    branches = None
    for nest in nests:
        root = "$" if nest is None else f"$.{nest}"
        value = variant_text(event, *[f"{root}.{n}" for n in names])
        if nest is None:
            return value if branches is None else branches.otherwise(value)
        hit = _with_content(event, root)
        branches = F.when(hit, value) if branches is None else branches.when(hit, value)
    return branches


def event_host(event, agent_first: bool = True) -> Column:
    order = ["$.agent.name", "$.host"] if agent_first else ["$.host", "$.agent.name"]
    return F.coalesce(variant_text(event, *order), F.lit("unknown"))


def canonical_events(df: DataFrame, event: str = "event", ids: list[str] | None = None) -> DataFrame:
    """Typed columns of raw events, so that no detector coalesces names again."""
    e = F.col(event)
    text = lambda *p: variant_text(e, *p)
    return df.select(
        *(ids or []), F.col(event),
        F.coalesce(text("$.timestamp"), F.lit("")).alias("ts_text"),
        event_host(e).alias("host"),
        event_host(e, agent_first=False).alias("match_host"),
        F.coalesce(text("$.host"), F.lit("unknown")).alias("plain_host"),
        F.coalesce(process_field(e, ["Image", "exe", "process_name"]), F.lit("")).alias("image"),
        F.coalesce(process_field(e, ["CommandLine", "cmdline"]), F.lit("")).alias("cmdline"),
        F.coalesce(process_field(e, ["ParentImage", "parent_name"]), F.lit("")).alias("parent_image"),
        F.coalesce(process_field(e, ["Image", "exe"], ("data", None)), F.lit("")).alias("shell_image"),
        F.coalesce(process_field(e, ["CommandLine", "cmdline"], ("data", None)), F.lit("")).alias("shell_cmdline"),
        F.coalesce(text("$.TargetImage", "$.target_image"), F.lit("")).alias("target_image"),
        F.coalesce(text("$.SourceImage", "$.source_image"), F.lit("")).alias("source_image"),
        text("$.dns.question.name", "$.QueryName").alias("query_name"),
        text("$.EventID", "$.event_id").alias("event_code"),
        text("$.ServiceName").alias("service_name"),
    )


# ---- severities, categories, descriptions ---------------------------------

def level_severity(level, default: int = 3, lowest: str = "info") -> Column:
    """Severity of a rule level. lowest is 'info' for timelines, 'low' for cases and payloads."""
    level = F.coalesce(_col(level), F.lit(default))
    chain = None
    for least, name in LEVEL_THRESHOLDS:
        if name == lowest:
            continue
        chain = F.when(level >= least, name) if chain is None else chain.when(level >= least, name)
    return chain.otherwise(lowest)


def severity_number(severity) -> Column:
    low = F.lower(_col(severity))
    chain = None
    for name, number in SEVERITY_NUMBER.items():
        chain = F.when(low == name, number) if chain is None else chain.when(low == name, number)
    return chain.otherwise(2)


def telemetry_category(code) -> Column:
    pairs = [x for c, name in TELEMETRY_CATEGORY.items() for x in (F.lit(c), F.lit(name))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _col(code).cast("int")), F.lit("other"))


def telemetry_description(code, fields: dict[str, Column]) -> Column:
    """Description of an event code. Fields that a source lacks print as empty text."""
    code = _col(code)
    chain = None
    for number, template in TELEMETRY_DESCRIPTION.items():
        parts = []
        for piece in template.split("{"):
            name, brace, rest = piece.partition("}")
            if brace:
                value = fields.get(name)
                if value is not None:
                    parts.append(F.coalesce(value.cast("string"), F.lit("")))
                parts.append(F.lit(rest))
            else:
                parts.append(F.lit(piece))
        text = F.concat(*parts)
        chain = F.when(code == number, text) if chain is None else chain.when(code == number, text)
    return chain.otherwise(F.concat(F.lit("Sysmon Event "), code.cast("string")))


# ---- outgoing rows --------------------------------------------------------

def case_alerts(alerts: DataFrame, alert_width: int | None = None) -> DataFrame:
    """Alerts as rows of the case system.

    Input columns: alert_id, timestamp, rule_id, rule_description, rule_level,
    rule_groups, agent_name, agent_ip, srcip, dstip, src_ip, dst_ip, sha256, hash,
    file_hash, and raw, the whole alert as text (missing ones are NULL).
    alert_width: characters of raw in the description; None keeps all.
    """
    have = set(alerts.columns)
    get = lambda n: F.col(n) if n in have else F.lit(None).cast("string")
    known = lambda n, default: F.coalesce(get(n).cast("string"), F.lit(default))

    def observable(kind, name, message=None):
        value = F.nullif(get(name), F.lit(""))
        return F.when(value.isNotNull(), F.struct(
            F.lit(kind).alias("data_type"), value.alias("data"), F.lit(message).cast("string").alias("message")))

    found = [observable("ip", "agent_ip", messages.OBSERVABLE_MESSAGE)]
    found += [observable("ip", n) for n in ("srcip", "dstip", "src_ip", "dst_ip")]
    found += [observable("hash", n) for n in ("sha256", "hash", "file_hash")]
    severity = level_severity("rule_level", default=5, lowest="low")
    groups = F.coalesce(get("rule_groups") if "rule_groups" in have else F.array(), F.array().cast("array<string>"))
    description = fill(
        messages.ALERT_TEXT, known("agent_name", "unknown"), known("agent_ip", "unknown"), known("rule_id", "N/A"),
        known("rule_description", "N/A"), known("rule_level", "5"), F.array_join(groups, ", "), known("timestamp", "N/A"),
        cut(known("raw", ""), alert_width))
    return alerts.select(
        "alert_id",
        fill(messages.ALERT_TITLE, known("rule_description", messages.ALERT_TITLE_DEFAULT)).alias("title"),
        description.alias("description"), F.lit(messages.ALERT_TYPE).alias("type"),
        F.lit(messages.ALERT_SOURCE).alias("source"),
        fill(messages.ALERT_REFERENCE, F.col("alert_id")).alias("source_ref"),
        severity.alias("severity_name"),
        severity_number(severity).alias("severity"),
        F.concat(groups, F.array(F.lit(messages.ALERT_TAG))).alias("tags"),
        F.array_compact(F.array(*found)).alias("observables"),
    )


def alert_payload(alerts: DataFrame) -> DataFrame:
    """Flat automation payload, one JSON text per alert; raw, where given, is the whole alert."""
    whole = F.col("raw") if "raw" in alerts.columns else F.lit(None).cast("string")
    return alerts.select("alert_id", F.to_json(F.struct(
        F.lit(messages.ALERT_TAG).alias("source"), F.col("alert_id"), F.col("timestamp"),
        F.col("rule_id"), F.col("rule_level"), F.col("rule_description"),
        F.coalesce("rule_groups", F.array().cast("array<string>")).alias("rule_groups"),
        F.col("agent_id"), F.col("agent_name"), F.col("agent_ip"), F.try_parse_json(whole).alias("full_alert"),
    ), {"ignoreNullFields": "false"}).alias("payload"))


def file_hash(event_hashes, plain_hash, sha256) -> Column:
    """Hash of an alert: event data first, then hash, then sha256; SHA256 part where tagged."""
    return sha256_field(F.coalesce(filled(event_hashes, plain_hash, sha256), F.lit("")))


def automation_rows(alerts: DataFrame) -> DataFrame:
    """Nested automation row: pipeline, steps, alert, enrichment and case data."""
    groups = F.coalesce("rule_groups", F.array().cast("array<string>"))
    return alerts.select(
        "alert_id",
        F.lit(messages.PIPELINE_NAME).alias("pipeline"),
        F.array(*[F.lit(s) for s in messages.PIPELINE_STEPS]).alias("steps"),
        F.struct(F.col("alert_id").alias("id"), "timestamp", "rule_id", "rule_level", "rule_description", "agent_name",
                 "agent_ip").alias("alert"),
        F.struct(
            file_hash("event_hashes", "hash", "sha256").alias("file_hash"),
            F.coalesce(filled("srcip"), F.col("agent_ip"), F.lit("")).alias("source_ip"),
            F.coalesce("dstip", F.lit("")).alias("destination_ip"),
        ).alias("enrichment"),
        F.struct(
            F.concat(F.lit("["), F.coalesce("rule_level", F.lit(0)).cast("string"), F.lit("] "),
                     F.coalesce("rule_description", F.lit(messages.ALERT_TITLE_DEFAULT))).alias("title"),
            level_severity("rule_level", default=3, lowest="low").alias("severity"),
            F.concat(groups, F.array(*[F.lit(t) for t in messages.PIPELINE_TAGS])).alias("tags"),
        ).alias("case_data"),
    )


def _sent(as_of) -> Column:
    """Time of an action: given, so that a rerun gives the same row; NULL without one."""
    return (F.lit(None) if as_of is None else as_of).cast("timestamp_ntz").alias("timestamp")


def lookup_actions(rows: DataFrame, value: str, context: Column | None = None, as_of: Column | None = None) -> DataFrame:
    """Reputation lookup request per digest."""
    return rows.select(F.lit(messages.ACTION_LOOKUP).alias("action"), F.col(value).alias("hash"),
                       digest_kind(value).alias("hash_type"), _sent(as_of),
                       (F.create_map().cast("map<string,string>") if context is None else context).alias("context"))


def case_creation_rows(case_alert_rows: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Case creation request per row of case_alerts."""
    return case_alert_rows.select(
        F.lit(messages.ACTION_CASE).alias("action"), "title", F.col("severity_name").alias("severity"), "description",
        "observables", "tags", _sent(as_of))


def notification_rows(rows: DataFrame, recipient, subject, body, priority: str = "normal",
                      as_of: Column | None = None) -> DataFrame:
    return rows.select(F.lit(messages.ACTION_NOTIFICATION).alias("action"), _col(recipient).alias("recipient"),
                       _col(subject).alias("subject"), _col(body).alias("body"), F.lit(priority).alias("priority"), _sent(as_of))


def bundle_observables(indicators: DataFrame, case: str, per_type: int | None = None) -> DataFrame:
    """Distinct values of each bundle list as case observables: the first per_type, or all."""
    kinds = {"ip": "ips", "domain": "domains", "url": "urls", "hash_md5": "md5s",
             "hash_sha1": "sha1s", "hash_sha256": "sha256s", "email": "emails"}
    chain = None
    for kind, bundle in kinds.items():
        target = BUNDLE_OBSERVABLES[bundle]
        hit = F.col("ioc_type") == kind
        chain = F.when(hit, target) if chain is None else chain.when(hit, target)
    rows = indicators.select(case, "ioc_type", "value").where(F.col("ioc_type").isin(*kinds)).distinct()
    ranked = first_per_group(rows, [case, "ioc_type"], ["value"], per_type)
    return ranked.select(case, "ioc_type", chain.alias("data_type"), F.col("value").alias("data"), "rank")
