"""Predicates and classes of file paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.operators import patterns as P


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def extension(path: Column) -> Column:
    """Last dot of the base name and what follows, lower case; empty for none and for names that begin with their only dot."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def ends_with_any(value: Column, ends: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for e in ends:
        found = found | value.endswith(e)
    return found


def is_test_path(path: Column) -> Column:
    """A segment of the path names tests or fixtures, or the path begins with `test`."""
    low = F.lower(path)
    return F.arrays_overlap(F.split(F.replace(low, F.lit("\\"), F.lit("/")), "/"), F.array(*map(F.lit, P.TEST_SEGMENTS))) | low.startswith("test")


def is_data_file(path: Column) -> Column:
    return ends_with_any(F.lower(path), P.DATA_EXTENSIONS)


def is_install_script(path: Column) -> Column:
    return F.lower(basename(path)) == "setup.py"


def classify(path: Column, content: Column | None = None) -> Column:
    """binary, source, config, script or unknown: by extension, then name, then the first bytes if given."""
    ext, name = extension(path), basename(path)
    out = (
        F.when(ext.isin(*P.BINARY_EXTENSIONS), "binary")
        .when(ext.isin(*P.SOURCE_EXTENSIONS) | name.isin(*P.SOURCE_FILENAMES), "source")
        .when(ext.isin(*P.CONFIG_EXTENSIONS), "config")
        .when(ext.isin(*P.SCRIPT_EXTENSIONS), "script")
    )
    if content is not None:
        out = out.when(F.hex(F.substring(content, 1, 2)).isin("4D5A") | (F.hex(F.substring(content, 1, 4)) == "7F454C46"), "binary").when(
            F.hex(F.substring(content, 1, 2)) == "2321", "script"
        )
    return out.otherwise("unknown")


def is_private_address(text: Column) -> Column:
    """Whether the first dotted quad begins with a private, loopback or link-local prefix (prefix test, as strings)."""
    quad = F.regexp_extract(text, r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})", 1)
    found = F.lit(False)
    for p in P.PRIVATE_PREFIXES:
        found = found | quad.startswith(p)
    return found


def is_metadata_address(text: Column) -> Column:
    return text.contains(P.METADATA_ADDRESSES[0]) | text.contains(P.METADATA_ADDRESSES[1])


def severity_rank(severity: Column) -> Column:
    """0 for critical to 4 for info."""
    out = F.lit(None).cast("int")
    for rank, name in reversed(list(enumerate(P.SEVERITIES))):
        out = F.when(severity == name, rank).otherwise(out)
    return out
