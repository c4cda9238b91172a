"""The shipped telemetry collection policy."""

# ---------------------------------------------------------------------------
# Fixed values. event kind -> (event codes, include conditions, exclude
# conditions); a condition is (field, operator, value). An event kind without
# include conditions keeps everything that is not excluded.
# ---------------------------------------------------------------------------
COLLECTION_POLICY = {
    "ProcessCreate": ([1], [], [
        ("Image", "is", "C:\\Windows\\System32\\conhost.exe"),
        ("Image", "end with", "svchost.exe"),
        ("CommandLine", "contains", "C:\\Windows\\system32\\DllHost.exe /Processid"),
    ]),
    "FileCreateTime": ([2], [
        ("TargetFilename", "contains", "C:\\Windows\\System32"),
        ("TargetFilename", "contains", "C:\\Windows\\SysWOW64"),
        ("TargetFilename", "end with", ".exe"),
        ("TargetFilename", "end with", ".dll"),
    ], []),
    "NetworkConnect": ([3], [
        ("DestinationPort", "is", "4444"),
        ("DestinationPort", "is", "1337"),
        ("DestinationPort", "is", "31337"),
        ("DestinationPort", "is", "8888"),
        ("DestinationPort", "is", "9001"),
        ("DestinationPort", "is", "9030"),
        ("Image", "end with", "powershell.exe"),
        ("Image", "end with", "cmd.exe"),
        ("Image", "end with", "mshta.exe"),
        ("Image", "end with", "wscript.exe"),
        ("Image", "end with", "cscript.exe"),
        ("Image", "end with", "regsvr32.exe"),
        ("Image", "end with", "rundll32.exe"),
        ("Image", "end with", "certutil.exe"),
        ("Image", "end with", "bitsadmin.exe"),
    ], []),
    "ProcessTerminate": ([5], [
        ("Image", "contains", "MsMpEng"),
        ("Image", "contains", "SecurityHealthService"),
        ("Image", "contains", "WinDefend"),
    ], []),
    "DriverLoad": ([6], [("Signed", "is", "false")], []),
    "ImageLoad": ([7], [
        ("ImageLoaded", "contains", "C:\\Users\\"),
        ("ImageLoaded", "contains", "C:\\Windows\\Temp"),
        ("ImageLoaded", "contains", "\\AppData\\"),
        ("ImageLoaded", "end with", "wdigest.dll"),
        ("ImageLoaded", "end with", "kerberos.dll"),
        ("ImageLoaded", "end with", "cryptdll.dll"),
    ], []),
    "CreateRemoteThread": ([8], [
        ("TargetImage", "contains", "lsass.exe"),
        ("TargetImage", "contains", "explorer.exe"),
        ("TargetImage", "contains", "svchost.exe"),
        ("TargetImage", "contains", "winlogon.exe"),
        ("TargetImage", "contains", "spoolsv.exe"),
        ("StartFunction", "contains", "LoadLibraryA"),
        ("StartFunction", "contains", "CreateThread"),
    ], []),
    "ProcessAccess": ([10], [
        ("TargetImage", "end with", "lsass.exe"),
        ("TargetImage", "end with", "sam.exe"),
        ("TargetImage", "end with", "ntds.dit"),
    ], [
        ("SourceImage", "is", "C:\\Windows\\System32\\wininit.exe"),
        ("SourceImage", "is", "C:\\Windows\\System32\\csrss.exe"),
        ("SourceImage", "contains", "MsMpEng.exe"),
    ]),
    "FileCreate": ([11], [
        ("TargetFilename", "contains", "\\AppData\\"),
        ("TargetFilename", "contains", "C:\\Windows\\Temp"),
        ("TargetFilename", "contains", "C:\\Users\\Public"),
        ("TargetFilename", "contains", "C:\\ProgramData"),
        ("TargetFilename", "end with", ".locked"),
        ("TargetFilename", "end with", ".encrypted"),
        ("TargetFilename", "end with", ".crypt"),
        ("TargetFilename", "end with", ".wnry"),
        ("TargetFilename", "contains", "README_DECRYPT"),
        ("TargetFilename", "contains", "HOW_TO_DECRYPT"),
        ("TargetFilename", "end with", ".ps1"),
        ("TargetFilename", "end with", ".vbs"),
        ("TargetFilename", "end with", ".bat"),
        ("TargetFilename", "end with", ".hta"),
    ], []),
    "RegistryEvent": ([12, 13, 14], [
        ("TargetObject", "contains", "SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Run"),
        ("TargetObject", "contains", "SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\Winlogon"),
        ("TargetObject", "contains", "SYSTEM\\CurrentControlSet\\Services"),
        ("TargetObject", "contains",
         "SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\Windows\\AppInit_DLLs"),
        ("TargetObject", "contains", "Windows Defender"),
        ("TargetObject", "contains", "Software\\Classes\\CLSID"),
    ], []),
    "PipeEvent": ([17, 18], [
        ("PipeName", "contains", "msagent_"),
        ("PipeName", "contains", "mojo."),
        ("PipeName", "contains", "postex_"),
        ("PipeName", "contains", "status_"),
        ("PipeName", "contains", "MSSE-"),
        ("PipeName", "contains", "ntsvcs"),
        ("PipeName", "contains", "scerpc"),
    ], []),
    "DnsQuery": ([22], [
        ("Image", "end with", "powershell.exe"),
        ("Image", "end with", "cmd.exe"),
        ("Image", "end with", "wscript.exe"),
        ("Image", "end with", "mshta.exe"),
        ("Image", "end with", "certutil.exe"),
        ("QueryName", "end with", ".top"),
        ("QueryName", "end with", ".xyz"),
        ("QueryName", "end with", ".pw"),
        ("QueryName", "end with", ".tk"),
        ("QueryName", "end with", ".ml"),
    ], []),
}

# Field names of the policy -> columns of the canonical event.
POLICY_FIELDS = {
    "Image": "image",
    "CommandLine": "cmdline",
    "TargetFilename": "file_path",
    "DestinationPort": "dst_port",
    "ImageLoaded": "image_loaded",
    "Signed": "signed",
    "TargetImage": "target_image",
    "SourceImage": "source_image",
    "StartFunction": "start_function",
    "TargetObject": "registry_key",
    "PipeName": "pipe_name",
    "QueryName": "query_name",
}
