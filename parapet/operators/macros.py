"""Signs in the source of macros: keywords by one automaton over word edges, their risk, and families of behaviour with weights."""

from __future__ import annotations

from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entry points that run by themselves, and capabilities that macros of documents rarely need.
AUTO_EXEC = (
    "AutoExec AutoOpen AutoClose AutoExit AutoNew Document_Open Document_Close Document_BeforeClose Document_New DocumentOpen Workbook_Open Workbook_Activate Workbook_Close "
    "Workbook_BeforeClose Auto_Open Auto_Close App_WorkbookOpen Worksheet_Activate Worksheet_Change Worksheet_SelectionChange AutoRun Auto_Exec"
).split()
SUSPICIOUS = (
    "Shell WScript.Shell Run ShellExecute CreateObject GetObject Win32_Process powershell cmd.exe mshta rundll32 regsvr32 URLDownloadToFile XMLHTTP WinHttpRequest ServerXMLHTTP ADODB.Stream SaveToFile "
    "FileSystemObject Scripting.FileSystemObject Open Write Binary Environ RegWrite RegRead Call Declare CallByName VirtualAlloc RtlMoveMemory CreateThread SetTimer Chr ChrW StrReverse Xor Base64Decode "
    "Execute ExecuteGlobal Eval Vba.Interaction"
).split()
#: Families of behaviour and their weights; words with edges, texts anywhere, and shapes that only a pattern can tell.
FAMILIES = {
    "autorun": (2.0, "", "", [r"\bSub\s+(?:AutoOpen|AutoClose|Auto_Open|Document_Open|Document_Close|Workbook_Open|\w*_(?:Paint|Layout|Activate|Startup|Change))\b"]),
    "execution": (
        *(3.0, "powershell pwsh mshta rundll32 regsvr32 certutil ShellExecute ShellExecuteA ShellExecuteW", "WScript.Shell winmgmts: Win32_Process VBA.CreateObject"),
        [r"\b(?:Shell|CreateObject|GetObject)\s*\(", r"\bcmd(?:\.exe)?\s*/[ck]\b", r"\bDeclare\s+(?:PtrSafe\s+)?(?:Sub|Function)\b[^\n]*\bLib\b"],
    ),
    "network": (
        *(3.0, "URLDownloadToFile URLDownloadToFileA URLDownloadToFileW bitsadmin iwr"),
        "XMLHTTP WinHttp.WinHttpRequest InternetExplorer.Application ADODB.Stream \"http:// \"https:// BackgroundCopyManager DownloadString DownloadFile Invoke-WebRequest Scripting.FileSystemObject",
        [r'Environ\s*\(\s*"(?:TEMP|APPDATA|TMP|USERPROFILE)"'],
    ),
    "obfuscation": (
        *(2.5, "CallByName", "FromBase64String MSXML2.DOMDocument bin.base64"),
        [
            *(r"(?:Chr[W$]?\s*\(\s*\d+\s*\)\s*&\s*){4,}", r"\b(?:StrReverse|Execute|ExecuteGlobal|Eval)\s*\(", r"\bXor\b[^\n]{0,40}\bAsc\b|\bAsc\b[^\n]{0,40}\bXor\b"),
            *(r"(?-i)(?:&H[0-9A-Fa-f]{2}\s*,?\s*){8,}", r"(?:Replace\s*\([^\n]{0,60}){3,}", r'"[A-Za-z0-9+/=]{300,}"'),
        ],
    ),
    "evasion": (
        *(2.0, "VirtualBox VMware QEMU Sandboxie wireshark SbieDll GetCursorPos Application.Wait", "RecentFiles.Count Application.MouseAvailable AutomationSecurity AccessVBOM VBAWarnings"),
        [r"\bSleep\s+\d{4,}", r"(?:EnableEvents|DisplayAlerts)\s*=\s*False", r"Kill\s+(?:ThisDocument|Application)\.FullName"],
    ),
    "persistence": (1.5, "schtasks Normal.dot Normal.dotm", r"RegWrite HKEY_CURRENT_USER HKEY_LOCAL_MACHINE \Startup\ Schedule.Service", []),
}
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


@cache
def _automaton():
    """Over all words and texts, lower-cased: each leads to the names it stands for and whether it needs edges."""
    import ahocorasick

    names: dict[str, list[tuple[str, bool]]] = {}
    for word in AUTO_EXEC + SUSPICIOUS:
        names.setdefault(word.lower(), []).append((f"k:{word}", True))
    for family, (_, words, anywhere, _) in FAMILIES.items():
        for texts, edged in ((words, True), (anywhere, False)):
            for x in texts.split():
                names.setdefault(x.lower(), []).append((f"f:{family}", edged))
    out = ahocorasick.Automaton()
    for word, held in names.items():
        out.add_word(word, (len(word), held))
    out.make_automaton()
    return out


def _signs(text: str | None) -> list[str] | None:
    if text is None:
        return None
    low, found = text.translate(_LOWER), set()
    for end, (n, held) in _automaton().iter(low):
        start, after = end - n + 1, end + 1
        edges = not ((start and low[start - 1] in _WORD) or (after < len(low) and low[after] in _WORD))
        found.update(name for name, edged in held if edges or not edged)
    return sorted(found)


@F.pandas_udf(T.ArrayType(T.StringType()))
def signs(source: pd.Series) -> pd.Series:
    """What the automaton finds in each source: k:keyword and f:family, sorted; null for null."""
    return source.map(_signs)


def keywords(found: Column) -> Column:
    """array of struct(type, keyword), in the order of the lists, from `signs`."""
    every = F.array(*[F.struct(F.lit(kind).alias("type"), F.lit(w).alias("keyword")) for kind, words in (("AutoExec", AUTO_EXEC), ("Suspicious", SUSPICIOUS)) for w in words])
    return F.when(found.isNotNull(), F.filter(every, lambda k: F.array_contains(found, F.concat(F.lit("k:"), k["keyword"]))))


def risk(words: Column) -> Column:
    """none, medium or high, from `keywords`: what runs by itself and can do something is high, and so are three capabilities."""
    auto, able = (F.size(F.filter(words, lambda k: k["type"] == kind)) for kind in ("AutoExec", "Suspicious"))
    return F.when(words.isNotNull(), F.when(((auto > 0) & (able > 0)) | (able >= 3), "high").when((auto > 0) | (able > 0), "medium").otherwise("none"))


def behaviour(source: Column, found: Column) -> Column:
    """struct(families, score, malicious, confidence): three families that weigh 7 are high, two that weigh 5 medium; one says little."""
    held = {}
    for family, (_, _, _, shapes) in FAMILIES.items():
        parts = [F.array_contains(found, f"f:{family}"), *[F.rlike(source, F.lit("(?i)" + s)) for s in shapes]]
        held[family] = F.coalesce(reduce(lambda a, b: a | b, parts), F.lit(False))
    n = reduce(lambda a, b: a + b, [h.cast("int") for h in held.values()])
    score = reduce(lambda a, b: a + b, [F.when(h, F.lit(FAMILIES[k][0])).otherwise(F.lit(0.0)) for k, h in held.items()])
    high, medium = (n >= 3) & (score >= 7), (n >= 2) & (score >= 5)
    names = F.array_compact(F.array(*[F.when(h, F.lit(k)) for k, h in held.items()]))
    return F.struct(names.alias("families"), score.alias("score"), (high | medium).alias("malicious"), F.when(high, "high").when(medium, "medium").otherwise("low").alias("confidence"))
