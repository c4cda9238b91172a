"""The shipped Sigma rules, as parsed documents."""

# ---------------------------------------------------------------------------
# Selectors, ids, tags and levels.
# ---------------------------------------------------------------------------
SIGMA_DOCS = [
    {
        "id": "42afa7b3-0c2e-4c5b-b23e-aa6f58a7c8e1",
        "title": "PsExec Lateral Movement Detection",
        "level": "high",
        "tags": ["attack.lateral_movement", "attack.t1021.002"],
        "detection": {
            "selection": {"EventID": 7045, "ServiceName": ["PSEXESVC", "psexesvc"]},
            "condition": "selection",
        },
    },
    {
        "id": "bc5cb6c7-0e1b-4d78-ace2-0e5c1a7a4b21",
        "title": "Remote Registry Access for Lateral Movement",
        "level": "medium",
        "tags": ["attack.lateral_movement", "attack.t1021.002"],
        "detection": {
            "selection": {"Image|endswith": ["\\reg.exe"], "CommandLine|contains": ["\\\\\\\\"]},
            "condition": "selection",
        },
    },
    {
        "id": "d7c50c2a-1f34-4e88-b9a7-3c8d4f1e9b02",
        "title": "WMI Remote Execution",
        "level": "high",
        "tags": ["attack.lateral_movement", "attack.t1047"],
        "detection": {
            "selection": {
                "ParentImage|endswith": ["\\WmiPrvSE.exe"],
                "Image|endswith": ["\\cmd.exe", "\\powershell.exe", "\\cscript.exe",
                                   "\\wscript.exe", "\\mshta.exe"],
            },
            "condition": "selection",
        },
    },
]

# Sigma level -> alert level (5 when unknown).
SIGMA_LEVELS = {"informational": 3, "low": 5, "medium": 8, "high": 11, "critical": 14}

# Sigma field names -> columns of the canonical event.
SIGMA_FIELDS = {
    "EventID": "event_code",
    "ServiceName": "service_name",
    "Image": "image",
    "ParentImage": "parent_image",
    "CommandLine": "cmdline",
    "TargetImage": "target_image",
    "SourceImage": "source_image",
    "TargetFilename": "file_path",
    "TargetObject": "registry_key",
    "QueryName": "query_name",
    "DestinationIp": "dst_ip",
    "DestinationPort": "dst_port",
    "OriginalFileName": "original_file_name",
}
