"""Case workflow values."""

# ---------------------------------------------------------------------------
# Fixed values.
# ---------------------------------------------------------------------------
PHASES = [
    "preparation", "identification", "containment", "eradication",
    "recovery", "lessons_learned", "closed",
]
CASE_SEVERITIES = ["low", "medium", "high", "critical"]
CASE_CATEGORIES = [
    "malware", "ransomware", "data_breach", "insider_threat", "phishing",
    "unauthorized_access", "dos_ddos", "supply_chain", "other",
]

# (phase, order in phase, title, priority, description)
TASK_TEMPLATES = [
    ("identification", 1, "Validate alert / confirm incident", "critical",
     "Determine if alert is true positive. Gather initial evidence."),
    ("identification", 2, "Determine scope of compromise", "high",
     "Identify affected systems, accounts, and data."),
    ("identification", 3, "Classify incident type and severity", "high",
     "Assign category and severity level using CVSS/risk matrix."),
    ("identification", 4, "Notify stakeholders", "high",
     "Alert management, legal, and affected business units as required."),
    ("identification", 5, "Open case in TheHive", "medium",
     "Create structured case with initial IOCs and evidence."),
    ("containment", 1, "Short-term containment", "critical",
     "Isolate affected systems from network while preserving evidence."),
    ("containment", 2, "Evidence preservation", "critical",
     "Take memory dumps and disk images before remediation changes."),
    ("containment", 3, "Block malicious IOCs", "high",
     "Add IPs/domains/hashes to firewall, DNS sinkhole, and AV blocklists."),
    ("containment", 4, "Preserve authentication artifacts", "high",
     "Export relevant event logs, credential cache artifacts."),
    ("containment", 5, "Long-term containment", "medium",
     "Implement compensating controls to allow business continuity."),
    ("eradication", 1, "Identify root cause", "critical",
     "Determine initial access vector and attacker dwell time."),
    ("eradication", 2, "Remove malware/backdoors", "critical",
     "Delete malicious files, scheduled tasks, and persistence mechanisms."),
    ("eradication", 3, "Reset compromised credentials", "critical",
     "Force password resets for affected accounts. Revoke tokens."),
    ("eradication", 4, "Patch exploited vulnerabilities", "high",
     "Apply patches/mitigations for the exploited vulnerability."),
    ("eradication", 5, "Validate removal", "high",
     "Re-scan cleaned systems with AV, YARA, and EDR tools."),
    ("recovery", 1, "Restore systems from clean backup", "high",
     "Restore from last known good backup, verify integrity."),
    ("recovery", 2, "Verify system integrity", "high",
     "Hash comparison, AV scan, and EDR validation post-restoration."),
    ("recovery", 3, "Restore network access", "medium",
     "Gradually re-enable network access with enhanced monitoring."),
    ("recovery", 4, "Monitor for re-infection", "medium",
     "Increase alert sensitivity for 30 days post-recovery."),
    ("recovery", 5, "Confirm business operations restored", "medium",
     "Validate with business stakeholders that operations are normal."),
    ("lessons_learned", 1, "Conduct post-incident review", "medium",
     "Schedule and facilitate lessons-learned meeting within 2 weeks."),
    ("lessons_learned", 2, "Document incident timeline", "medium",
     "Complete full attack timeline from initial access to remediation."),
    ("lessons_learned", 3, "Identify detection gaps", "medium",
     "Document what detection rules were missing or triggered too late."),
    ("lessons_learned", 4, "Update playbooks", "low",
     "Revise IR playbooks based on lessons learned."),
    ("lessons_learned", 5, "Draft final IR report", "high",
     "Write executive and technical summary of the incident."),
]

# Section caps of the case report: (timeline, ips, domains, sha256s, urls, evidence)
REPORT_CAPS = {
    "timeline": 50, "ip": 20, "domain": 20, "hash_sha256": 20, "url": 10, "evidence": 20,
}
