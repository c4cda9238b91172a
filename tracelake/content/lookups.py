"""Lookup values shared by the operators."""

# ---------------------------------------------------------------------------
# Fixed values. They decide results, so they are written out as they must be.
# ---------------------------------------------------------------------------

# Rule level -> severity, highest threshold first.
LEVEL_THRESHOLDS = [(12, "critical"), (9, "high"), (6, "medium"), (3, "low")]

# Severity name -> case-system number (2 when unknown).
SEVERITY_NUMBER = {"low": 1, "medium": 2, "high": 3, "critical": 4}

# Endpoint telemetry event code -> timeline category.
TELEMETRY_CATEGORY = {
    1: "process", 2: "file", 3: "network", 4: "service", 5: "process",
    6: "service", 7: "service", 8: "process", 9: "file", 10: "process",
    11: "file", 12: "registry", 13: "registry", 14: "registry", 15: "file",
    16: "service", 17: "network", 18: "network", 19: "persistence",
    20: "persistence", 21: "persistence", 22: "network", 23: "file",
    25: "process", 26: "file",
}

# Endpoint telemetry event code -> description template, {Field} placeholders.
TELEMETRY_DESCRIPTION = {
    1: "Process Created: {Image} (PID:{ProcessId}) Parent:{ParentImage}",
    3: "Network Connection: {Image} -> {DestinationIp}:{DestinationPort}",
    7: "DLL Loaded: {ImageLoaded} by {Image}",
    11: "File Created: {TargetFilename} by {Image}",
    12: "Registry Create/Delete: {TargetObject}",
    13: "Registry Set: {TargetObject} = {Details}",
    15: "File Stream Created: {TargetFilename}",
    22: "DNS Query: {QueryName} by {Image}",
}

# Windows event ids that map to the auth / process categories (others: service).
WINDOWS_AUTH_IDS = [4624, 4625, 4648]
WINDOWS_PROCESS_IDS = [4688]

# Windows event ids worth collecting, with labels.
HIGH_VALUE_WINDOWS_EVENTS = {
    4624: "Successful Logon",
    4625: "Failed Logon",
    4648: "Logon with Explicit Credentials",
    4672: "Special Privileges Assigned",
    4688: "New Process Created",
    4697: "Service Installed",
    4698: "Scheduled Task Created",
    4720: "User Account Created",
    4722: "User Account Enabled",
    4732: "Member Added to Security Group",
    4776: "NTLM Authentication",
    7045: "New Service Installed",
}

# The ids the Windows triage bundle asks for (a different list).
TRIAGE_BUNDLE_EVENT_IDS = [
    4624, 4625, 4648, 4672, 4688, 4697, 4698, 4720, 4732, 7045, 1102,
]

# ATT&CK technique id -> short name.
TECHNIQUE_NAMES = {
    "T1059": "Command and Scripting Interpreter",
    "T1055": "Process Injection",
    "T1003": "Credential Dumping",
    "T1083": "File and Directory Discovery",
    "T1021": "Remote Services",
    "T1071": "Application Layer Protocol (C2)",
    "T1547": "Boot/Logon Autostart Execution",
    "T1053": "Scheduled Task/Job",
    "T1078": "Valid Accounts",
    "T1486": "Data Encrypted for Impact (Ransomware)",
    "T1041": "Exfiltration Over C2 Channel",
    "T1190": "Exploit Public-Facing Application",
    "T1566": "Phishing",
}

# Indicator types a feed may hold.
INDICATOR_TYPES = [
    "ip", "domain", "hash_md5", "hash_sha1", "hash_sha256", "url", "email", "cve",
]

# Event-export attribute type -> indicator type.
EVENT_EXPORT_TYPES = {
    "ip-src": "ip", "ip-dst": "ip", "ip-src|port": "ip", "ip-dst|port": "ip",
    "domain": "domain", "hostname": "domain", "domain|ip": "domain",
    "md5": "hash_md5", "sha1": "hash_sha1", "sha256": "hash_sha256",
    "url": "url", "email-src": "email", "email-dst": "email",
    "vulnerability": "cve",
}

# Pulse indicator type -> indicator type.
PULSE_TYPES = {
    "IPv4": "ip", "IPv6": "ip",
    "domain": "domain", "hostname": "domain",
    "FileHash-MD5": "hash_md5", "FileHash-SHA1": "hash_sha1",
    "FileHash-SHA256": "hash_sha256",
    "URL": "url", "email": "email", "CVE": "cve",
}

# Indicator-bundle list -> observable type of the case system.
BUNDLE_OBSERVABLES = {
    "ips": "ip", "domains": "domain", "urls": "url",
    "md5s": "hash", "sha1s": "hash", "sha256s": "hash", "emails": "mail",
}

# Ports: flows, and the smaller set used for live sockets.
FLOW_PORTS = [4444, 1337, 31337, 8888, 9001, 9030, 6667, 6666]
SOCKET_PORTS = [4444, 1337, 31337, 8888, 9001]
LARGE_FLOW_BYTES = 100 * 1024 * 1024
BEACON_INTERVALS = [60, 120, 300, 600]

# Process names that raise the host score (whole-name match).
SUSPICIOUS_PROCESSES = [
    "powershell.exe", "cmd.exe", "wscript.exe", "cscript.exe",
    "mshta.exe", "regsvr32.exe", "rundll32.exe", "certutil.exe",
    "bitsadmin.exe", "msiexec.exe", "wmic.exe", "net.exe",
    "schtasks.exe", "at.exe", "sc.exe", "reg.exe",
]

# File checks.
EXECUTABLE_EXTENSIONS = [".exe", ".dll", ".com", ".scr"]
SCRIPT_EXTENSIONS = [
    ".exe", ".dll", ".bat", ".ps1", ".vbs", ".js", ".hta", ".scr", ".com", ".pif",
]
DOUBLE_EXTENSION = r"(?i)\.[a-zA-Z]{2,4}\.(exe|dll|bat|ps1|vbs|js|hta|scr|com)$"
TEMP_PATH = r"(?i)(temp|tmp|appdata|downloads)"
LONG_NAME = 100

# Leading bytes (hex) -> file kind, in match order: file inventory.
FILE_MAGIC = [
    ("4D5A", "DOS/PE Executable"),
    ("7F454C46", "ELF Executable (Linux)"),
    ("504B0304", "ZIP Archive"),
    ("25504446", "PDF Document"),
    ("D0CF11E0", "OLE2 Compound File (Office)"),
    ("89504E47", "PNG Image"),
    ("FFD8FF", "JPEG Image"),
    ("1F8B", "GZIP Archive"),
    ("377ABCAF", "7-Zip Archive"),
    ("52617221", "RAR Archive"),
]

# Leading bytes (hex) -> file kind, in match order: sample analysis.
SAMPLE_MAGIC = [
    ("4D5A", "PE Executable"),
    ("7F454C46", "ELF Executable"),
    ("504B0304", "ZIP Archive"),
    ("25504446", "PDF"),
    ("D0CF11E0", "OLE2 (Office)"),
    ("1F8B", "GZIP"),
    ("2321", "Script (shebang)"),
    ("3C3F786D6C", "XML"),
    ("3C68746D6C", "HTML"),
]

# Packer marker in the first 2048 bytes, in match order.
PACKER_MARKERS = [
    ("UPX!", "UPX Packer"),
    ("MPRESS", "MPRESS Packer"),
    ("NSP0", "NSIS Packer"),
    ("PEC2", "PECompact"),
]
PACKER_SEARCH_BYTES = 2048

# Suspicious string pattern -> reason, first match wins.
SUSPICIOUS_STRINGS = [
    (r"(?i)cmd\.exe|powershell|wscript|cscript", "Shell execution"),
    (r"(?i)http[s]?://\S+", "HTTP URL"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "IP Address"),
    (r"(?i)VirtualAlloc|VirtualProtect|WriteProcessMemory|CreateRemoteThread", "Process injection API"),
    (r"(?i)RegCreateKey|RegSetValue|RegOpenKey", "Registry manipulation"),
    (r"(?i)WinExec|ShellExecute|CreateProcess|CreateService", "Execution API"),
    (r"(?i)InternetOpen|HttpSendRequest|WinHttpOpen|URLDownloadToFile", "Network API"),
    (r"(?i)CryptEncrypt|CryptDecrypt|CryptGenKey|BCryptEncrypt", "Crypto API"),
    (r"(?i)SetWindowsHook|GetAsyncKeyState|keylog", "Keylogger indicator"),
    (r"(?i)mimikatz|sekurlsa|lsadump", "Credential dumping tool"),
    (r"(?i)base64_decode|FromBase64String|base64,", "Base64 encoded content"),
    (r"(?i)\\\\[A-Za-z0-9]+\\[A-Za-z$]+", "UNC path (lateral movement)"),
]

INJECTION_IMPORTS = [
    "VirtualAlloc", "WriteProcessMemory", "CreateRemoteThread", "NtUnmapViewOfSection",
]
NORMAL_SECTIONS = [".text", ".data", ".rdata", ".rsrc", ".reloc"]

# Breach notification deadline by regime, in hours, and who is notified.
NOTIFICATION_DEADLINES = [
    ("GDPR", 72, "Supervisory authority"),
    ("HIPAA", 60 * 24, "HHS + affected individuals"),
    ("PCI-DSS", 0, "Card brands + acquiring bank"),
    ("CCPA", 72, "CA AG (if >500 CA residents)"),
    ("NY SHIELD", 30 * 24, "NY AG"),
]
