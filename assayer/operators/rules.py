"""Rules over text or bytes: needles with offsets, all-of capabilities, N-of string rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import arrays
from assayer.operators import patterns as P


@dataclass(frozen=True)
class Rule:
    """Strings, of which at least `least` must occur; `regex` must match too, if given. wide: also with a NUL after each character."""

    name: str
    category: str
    severity: str
    strings: tuple[str, ...]
    least: int
    regex: str | None = None
    nocase: tuple[str, ...] = ()
    wide: tuple[str, ...] = ()


# The bundled rules.
RULES = (
    Rule("ProcessInjection", "process_injection", "high", ("CreateRemoteThread", "WriteProcessMemory", "VirtualAllocEx", "NtMapViewOfSection"), 2, wide=("CreateRemoteThread", "WriteProcessMemory", "VirtualAllocEx", "NtMapViewOfSection")),
    Rule("ShellExecution", "script_exec", "medium", ("powershell", "cmd.exe", "WScript.Shell", "/bin/sh", "/bin/bash"), 2, nocase=("powershell", "cmd.exe"), wide=("powershell", "cmd.exe", "WScript.Shell")),
    Rule("SuspiciousNetwork", "network", "medium", ("WSAStartup", "InternetOpenA"), 1, regex=r"https?://[a-zA-Z0-9\-\.]+\.[a-zA-Z]{2,}(/\S*)?", wide=("WSAStartup", "InternetOpenA")),
    Rule("AntiAnalysis", "anti_analysis", "high", ("IsDebuggerPresent", "CheckRemoteDebuggerPresent", "NtQueryInformationProcess", "VMwareVMware", "VBoxGuest", "ptrace"), 2, wide=("IsDebuggerPresent", "CheckRemoteDebuggerPresent", "NtQueryInformationProcess")),
    Rule("MemoryManipulation", "memory_exec", "high", ("VirtualAlloc", "VirtualProtect", "RtlMoveMemory", "mach_vm_write", "mprotect"), 2, wide=("VirtualAlloc", "VirtualProtect", "RtlMoveMemory")),
)


def has_string(text: Column, rule: Rule, string: str) -> Column:
    source, needle = (F.lower(text), string.lower()) if string in rule.nocase else (text, string)
    found = source.contains(needle)
    if string in rule.wide:
        found = found | source.contains("".join(c + "\0" for c in needle))
    return found


def rule_cells(text: Column, rules: tuple[Rule, ...] = RULES) -> list[Column]:
    """For each rule a struct of rule, category, severity and n_strings where it holds, else null."""
    cells = []
    for r in rules:
        n = sum(has_string(text, r, s).cast("int") for s in r.strings)
        holds = (n >= r.least) & (text.rlike(r.regex) if r.regex else F.lit(True))
        cells.append(F.when(holds, F.struct(F.lit(r.name).alias("rule"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), n.alias("n_strings"))))
    return cells


def matches(files: DataFrame, rules: tuple[Rule, ...] = RULES, *, text: str = "text") -> DataFrame:
    """The columns of `files` but the text, with rule, category, severity and n_strings for each rule that holds."""
    others = [c for c in files.columns if c != text]
    return files.select(*others, F.explode(F.array_compact(F.array(*rule_cells(F.col(text), rules)))).alias("_m")).select(*others, "_m.*")


def capability_cells(text: Column, table=P.CAPABILITIES) -> list[Column]:
    """For each entry a struct of capability and severity where all of its words occur, else null."""
    cells = []
    for words, name, severity in table:
        holds = F.lit(True)
        for w in words:
            holds = holds & text.contains(w)
        cells.append(F.when(holds, F.struct(F.lit(name).alias("capability"), F.lit(severity).alias("severity"))))
    return cells


def capabilities(files: DataFrame, table=P.CAPABILITIES, *, text: str = "text") -> DataFrame:
    """The columns of `files` but the text, with capability and severity for each entry all of whose words occur."""
    others = [c for c in files.columns if c != text]
    return files.select(*others, F.explode(F.array_compact(F.array(*capability_cells(F.col(text), table)))).alias("_m")).select(*others, "_m.*")


def needle_offsets(files: DataFrame, needles=P.NEEDLES, *, text: str = "text") -> DataFrame:
    """(…, needle, category, at) for every occurrence, `at` from 0; needles in lower case are found in any case of ASCII letters.

    No needle overlaps itself, so splitting at it finds every occurrence; offsets are sums of the lengths between. Only ASCII letters are
    folded: other letters may change their length.
    """
    others = [c for c in files.columns if c != text]
    return files.select(*others, F.explode(needle_list(F.col(text), needles)).alias("_m")).select(*others, "_m.*")


def needle_list(text: Column, needles=P.NEEDLES) -> Column:
    """The same occurrences in one array, needle by needle."""
    cells = []
    for needle, category in needles:
        if any(needle.startswith(needle[k:]) for k in range(1, len(needle))):
            raise ValueError(f"{needle!r} overlaps itself")
        pattern = ("(?i)" if needle == needle.lower() else "") + r"\Q" + needle + r"\E"
        parts = F.split(text, pattern)
        sizes = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.length(p) + len(needle))  # noqa: B023
        cells.append(F.when(text.rlike(pattern), F.transform(arrays.running(sizes), _occurrence(needle, category))))
    return F.flatten(F.array_compact(F.array(*cells)))


def _occurrence(needle: str, category: str):
    return lambda end: F.struct(F.lit(needle).alias("needle"), F.lit(category).alias("category"), (end - len(needle)).alias("at"))
