"""Hunt hypotheses and their parameters."""

# ---------------------------------------------------------------------------
# Fixed values.
# ---------------------------------------------------------------------------

# (id, title, technique, severity)
HYPOTHESES = [
    ("HYP-001", "Living-off-the-Land Binary Abuse", "T1218", "high"),
    ("HYP-002", "Credential Dumping via LSASS", "T1003.001", "critical"),
    ("HYP-003", "Suspicious PowerShell Encoded Commands", "T1059.001", "high"),
    ("HYP-004", "Lateral Movement via PsExec/WMI", "T1021", "high"),
    ("HYP-005", "Scheduled Task Persistence", "T1053.005", "medium"),
    ("HYP-006", "DNS Beaconing Pattern", "T1071.004", "high"),
    ("HYP-007", "Anomalous User Login Times", "T1078", "medium"),
]

LOLBINS = [
    "certutil.exe", "mshta.exe", "regsvr32.exe", "rundll32.exe",
    "wscript.exe", "cscript.exe", "msiexec.exe", "installutil.exe",
    "cmstp.exe", "xwizard.exe", "syncappvpublishingserver.exe",
    "appsyncpublishingserver.exe", "odbcconf.exe",
]
LOLBIN_ARGUMENTS = ["http", "\\temp\\", "base64"]

# Substrings that clear a process reading LSASS memory.
LSASS_SAFE_WORDS = ["antimalware", "defender", "antivirus", "splunk", "sysmon", "system"]

ENCODED_COMMAND = r"(?i)-[Ee](?:nc(?:oded)?|xecutionpolicy)?(?:Command)?\s+[A-Za-z0-9+/=]{20,}"

TRUSTED_DNS_SUFFIXES = [".microsoft.com", ".windows.com", ".google.com"]
DGA_MIN_LABEL = 6
DGA_MIN_ENTROPY = 3.8
DGA_MIN_QUERIES = 3

# ---------------------------------------------------------------------------
# Ours: base names that may read LSASS memory in the default mode. They replace
# the word "system", which would clear everything below System32.
# ---------------------------------------------------------------------------
LSASS_SAFE_BASENAMES = ["system", "csrss.exe", "wininit.exe", "services.exe", "svchost.exe"]
