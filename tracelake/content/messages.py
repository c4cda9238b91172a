"""Texts that results carry."""

# ---------------------------------------------------------------------------
# Result texts, {} marks the value that is filled in.
# ---------------------------------------------------------------------------
# Names that consumers of outgoing rows filter on.
ALERT_SOURCE = "Wazuh"
ALERT_TAG = "wazuh"
ALERT_TITLE = "[Wazuh] {}"
ALERT_TYPE = "wazuh"
ALERT_REFERENCE = "WAZUH-{}"
ALERT_DESCRIPTION_DEFAULT = "Wazuh Alert"
ALERT_TITLE_DEFAULT = "Security Alert"
OBSERVABLE_MESSAGE = "Source agent IP"
ALERT_TEXT = """
**Wazuh Alert**

- **Agent**: {} ({})
- **Rule ID**: {}
- **Rule Description**: {}
- **Level**: {}
- **Groups**: {}
- **Timestamp**: {}

**Full Alert**:
```json
{}
```
"""
PIPELINE_NAME = "full_soc_automation"
PIPELINE_STEPS = ["wazuh_alert", "virustotal_lookup", "thehive_case", "email_notification"]
PIPELINE_TAGS = ["wazuh", "automated"]
ACTION_LOOKUP = "virustotal_lookup"
ACTION_CASE = "create_thehive_case"
ACTION_NOTIFICATION = "send_email"

FILE_WRONG_KIND = "Executable magic but extension is '{}'"
FILE_DOUBLE_EXTENSION = "Double extension detected"
FILE_RISKY_FOLDER = "Executable/script in suspicious directory ({})"
FILE_LONG_NAME = "Unusually long filename ({} chars)"

FLOW_PORT = "Known C2/malware port: {}"
FLOW_VOLUME = "Large data transfer: {} MB"

HOST_PROCESSES = "Suspicious processes running: {}"
HOST_SOCKETS = "Suspicious network connections: {}"
HOST_SESSIONS = "Multiple active sessions: {} users logged in"
HOST_FILES = "Executable files found in temp directories"
HOST_ACTION_CRITICAL = "CRITICAL: Isolate host immediately, escalate to senior analyst"
HOST_ACTION_HIGH = "HIGH: Initiate containment procedures, notify IR lead"
HOST_ACTION_MEDIUM = "MEDIUM: Continue monitoring, gather additional artifacts"
HOST_ACTION_LOW = "LOW: Continue normal monitoring cadence"
HOST_ACTION_SOCKETS = "Isolate host from network immediately"
HOST_ACTION_SESSIONS = "Investigate concurrent user sessions for unauthorized access"
HOST_ACTION_FILES = "Collect and analyze executables found in temp paths"

SAMPLE_VERY_HIGH_ENTROPY = "Very high entropy ({}) - possible encryption/packing"
SAMPLE_HIGH_ENTROPY = "High entropy ({})"
SAMPLE_PACKER = "Packer detected: {}"
SAMPLE_INJECTION = "Process injection APIs: {}"
SAMPLE_SECTIONS = "High entropy sections: {}"
SAMPLE_STRINGS = "Suspicious strings: {}"
SAMPLE_NETWORK = "Embedded network IOCs: {} IPs, {} domains"

HUNT_LOLBIN = "LOLBin abuse detected: {} with suspicious cmdline"
HUNT_LSASS = "LSASS access by unexpected process: {}"
HUNT_ENCODED_SHELL = "Suspicious encoded PowerShell command"
HUNT_LOGIN_TIME = "Login of {} at hour {}, {} of {} logins"
HUNT_GENERATED_NAME = "Potential DGA domain: {} (entropy={}, queries={})"
