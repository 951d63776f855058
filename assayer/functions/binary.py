"""Functions of bytes and text: hashes, entropy, printable runs, chunks, formats, packers, the heuristic score."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.operators import patterns as P

PRINTABLE = r"[\x20-\x7e]{4,}"
MAX_STRINGS, CHUNK = 256, 4096
PACKER_BYTES, HEAD_BYTES, SECTION = 8192, 4096, 1024


def latin(content: Column) -> Column:
    """Bytes as text, one character a byte, so that offsets stay."""
    return F.decode(content, "ISO-8859-1")


def hashes(content: Column) -> list[Column]:
    return [F.sha2(content, 256).alias("sha256"), F.sha1(content).alias("sha1"), F.md5(content).alias("md5")]


def printable_runs(content: Column, most: int = MAX_STRINGS) -> Column:
    """The first runs of four or more printable ASCII characters."""
    return F.slice(F.regexp_extract_all(latin(content), F.lit(PRINTABLE), 0), 1, most)


def chunk_hash_list(content: Column, size: int = CHUNK) -> Column:
    """sha256 of each run of `size` bytes, in order; empty for no bytes."""
    last = F.floor((F.length(content) - 1) / size).cast("int")
    found = F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.substring(content, i * size + 1, size), 256))
    return F.when(F.length(content) == 0, F.array().cast("array<string>")).otherwise(found)


@F.pandas_udf(T.DoubleType())
def text_entropy(text: pd.Series) -> pd.Series:
    """Shannon entropy of the characters, in bits, in Arrow batches: a count of code points, no shuffle."""

    def bits(t):
        if not t:
            return 0.0
        _, n = np.unique(np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32), return_counts=True)
        p = n / n.sum()
        return float(-(p * np.log2(p)).sum()) + 0.0

    return text.map(bits)


def _entropy(data: np.ndarray) -> float:
    p = np.bincount(data, minlength=256) / max(len(data), 1)
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum()) if len(p) else 0.0


@F.pandas_udf(T.DoubleType())
def byte_entropy(content: pd.Series) -> pd.Series:
    return content.map(lambda b: _entropy(np.frombuffer(b or b"", np.uint8)))


_COMPONENTS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("entropy_ratio", "nonprintable_ratio", "packer_detected", "high_entropy_sections")])


@F.pandas_udf(_COMPONENTS)
def score_components(content: pd.Series) -> pd.DataFrame:
    """The four parts of the heuristic score, rounded to four places."""
    rows = []
    for b in content:
        data = np.frombuffer(b or b"", np.uint8)
        head = data[:HEAD_BYTES]
        odd = int(((head < 0x20) | (head > 0x7E)).sum())
        whole = len(data) // SECTION
        high = sum(_entropy(data[i * SECTION : (i + 1) * SECTION]) > 7.0 for i in range(whole))
        packed = any(sig in (b or b"")[:PACKER_BYTES] for sig, _ in P.PACKERS)
        rows.append((round(max(0.0, (_entropy(data) - 5.0) / 3.0), 4), round(odd / max(len(head), 1), 4), float(packed), round(high / whole, 4) if whole else 0.0))
    return pd.DataFrame(rows, columns=_COMPONENTS.names)


def heuristic_score(parts: Column, content: Column) -> Column:
    total = parts["entropy_ratio"] * 0.35 + parts["nonprintable_ratio"] * 0.15 + parts["packer_detected"] * 0.30 + parts["high_entropy_sections"] * 0.20
    return F.when(F.length(content) == 0, F.lit(0.0)).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def score_severity(score: Column) -> Column:
    """Severity of a score, null below the least threshold."""
    return F.when(score >= 0.95, "critical").when(score >= 0.9, "high").when(score >= 0.7, "medium").when(score >= 0.3, "low")


def packer(content: Column) -> Column:
    """The first known packer whose mark is in the first 8 KiB."""
    head, out = latin(F.substring(content, 1, PACKER_BYTES)), None
    for sig, name in P.PACKERS:
        here = head.contains(sig.decode("latin-1"))
        out = F.when(here, name) if out is None else out.when(here, name)
    return out


def file_format(filename: Column, content: Column) -> Column:
    """Format by magic bytes, then name; tar by its header mark."""
    low, head = F.lower(filename), F.hex(F.substring(content, 1, 4))
    library = low.endswith(".dll") | low.endswith(".pyd") | low.endswith(".exe") | low.endswith(".so")
    return (
        F.when(head.startswith("4D5A"), "pe")
        .when(head == "7F454C46", "elf")
        .when(head.isin("FEEDFACE", "FEEDFACF", "CFFAEDFE", "CAFEBABE"), "mach-o")
        .when((head == "504B0304") & ~library, "zip")
        .when(low.endswith(".zip"), "zip")
        .when(F.substring(content, 258, 5) == F.lit(b"ustar"), "tar")
        .when(head.startswith("1F8B") & (low.endswith(".tar.gz") | low.endswith(".tgz")), "tar")
        .when(head.startswith("1F8B") | low.endswith(".gz"), "gzip")
        .otherwise("unknown")
    )


def region(offset: Column) -> Column:
    """The window around an offset, as hexadecimal bounds."""
    text = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c)))
    return F.struct(text(F.greatest(offset - 0x80, F.lit(0))).alias("start"), text(offset + 0x180).alias("end"))


def artifacts(files: DataFrame) -> DataFrame:
    """Artifact rows of files (path, content): hashes, size, format, entropy, strings, chunk hashes."""
    c = F.col("content")
    return files.select("path", *hashes(c), F.length(c).cast("long").alias("size"), file_format(F.col("path"), c).alias("format"), byte_entropy(c).alias("entropy"), printable_runs(c).alias("strings"), chunk_hash_list(c).alias("chunk_hashes"))
