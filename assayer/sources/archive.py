"""Members of archives as rows, with caps on what is unpacked and lineage to the parent."""

from __future__ import annotations

import gzip
import hashlib
import io
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The mark and layout of self-extracting Python bundles.
BUNDLE_MAGIC = b"MEI\014\013\012\013\016"
COOKIE_BYTES, LEAST_MEMBER = 88, 16
ENTRY = struct.Struct("!IIIbb")
TOTAL_BYTES = 512 << 20
SKIPPED = ("..", ".", "")


def clean_name(name: str) -> str:
    """The name without parent, current and empty segments."""
    return "/".join(p for p in name.replace("\\", "/").split("/") if p not in SKIPPED) or "member"


class Stopped(Exception):
    """What follows in an archive is not unpacked."""


def _zip(data: bytes, cap: int) -> Iterator[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            if not info.is_dir():
                if info.file_size > cap:  # declared size first: nothing of a bomb is unpacked
                    raise Stopped(f"member of {info.file_size} bytes")
                with z.open(info) as f:
                    yield info.filename, f.read(cap + 1)


def _tar(data: bytes, cap: int) -> Iterator[tuple[str, bytes]]:
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        for member in t:
            if member.isfile():
                if member.size > cap:
                    raise Stopped(f"member of {member.size} bytes")
                yield member.name, t.extractfile(member).read()


def _gzip(name: str, data: bytes, cap: int) -> Iterator[tuple[str, bytes]]:
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as g:
        yield name.removesuffix(".gz"), g.read(cap + 1)


def _bundle(data: bytes, cap: int) -> Iterator[tuple[str, bytes]]:
    at = data.rfind(BUNDLE_MAGIC)
    if at < 0 or at + COOKIE_BYTES > len(data):
        return
    size, toc, toc_size = struct.unpack_from("!III", data, at + 8)
    base = at + COOKIE_BYTES - size
    if base < 0 or toc > size:
        return
    place, count = base + toc, 0
    while place < base + toc + toc_size and place + ENTRY.size <= len(data):
        length, offset, stored, packed, _ = ENTRY.unpack_from(data, place)
        if not ENTRY.size <= length <= 4096:
            return
        name = data[place + ENTRY.size : place + length].rstrip(b"\0").decode("utf-8", "replace") or f"entry_{count}"
        raw = data[base + offset : base + offset + stored]
        place += length
        if stored and len(raw) == stored:
            if packed == 1:
                unpack = zlib.decompressobj()
                try:
                    raw = unpack.decompress(raw, cap + 1)
                except zlib.error:
                    pass
            if len(raw) > LEAST_MEMBER:
                count += 1
            yield name, raw


def members(name: str, data: bytes, cap: int = TOTAL_BYTES, gaps: list | None = None) -> Iterator[tuple[str, bytes]]:
    """Members of an archive until `cap` bytes together; none for other files. Where an archive is left before its end, (members, bytes, why) is added to `gaps`."""
    total = seen = 0
    try:
        if BUNDLE_MAGIC in data:
            found = ((n, d) for n, d in _bundle(data, cap))
        elif data[:4] == b"PK\3\4" or (name.lower().endswith(".zip") and data[:2] != b"MZ"):
            found = _zip(data, cap)
        elif data[257:262] == b"ustar" or name.lower().endswith((".tar", ".tar.gz", ".tgz")):
            found = _tar(data, cap)
        elif data[:2] == b"\x1f\x8b":
            found = _gzip(name, data, cap)
        else:
            return
        bundle = BUNDLE_MAGIC in data
        for n, d in found:
            if total + len(d) > cap:
                raise Stopped(f"over {cap} bytes")
            total += len(d)
            seen += 1
            if not bundle or len(d) > LEAST_MEMBER:
                yield clean_name(n), d
    except (Stopped, zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, zlib.error, RuntimeError, NotImplementedError) as e:
        if gaps is not None:
            gaps.append((seen, total, str(e) if isinstance(e, Stopped) else "broken archive"))


def _inside(path: str, data: bytes, parent: str | None, level: int, depth: int, cap: int) -> Iterator[tuple]:
    """A file and what it holds, outer ones first; one member of each level is in memory at a time. After an archive that was left early a row without content says so."""
    yield path, data, parent, level, None, None, None
    if level < depth:
        digest, gaps = hashlib.sha256(data).hexdigest(), []
        for name, member in members(path.rsplit("!", 1)[-1], data, cap, gaps):
            yield from _inside(f"{path}!{name}", member, digest, level + 1, depth, cap)
        for seen, total, why in gaps:
            yield path, None, digest, level, why, seen, total


OUT_BYTES = 4 << 20
_KINDS = {"path": pa.string(), "content": pa.binary(), "parent_sha256": pa.string(), "depth": pa.int32(), "gap": pa.string(), "n_members": pa.int64(), "n_bytes": pa.int64()}


def scanned(files: DataFrame, *, depth: int = 2, cap: int = TOTAL_BYTES) -> DataFrame:
    """Files (path, content) and what they hold, down to `depth` archives within archives, each opened once: path, content, parent_sha256, depth, gap, n_members, n_bytes.

    Rows with a gap (why) tell of an archive (path, its hash as parent_sha256) that was left before its end, after n_members members of n_bytes together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS.values())], names=list(_KINDS))
        for batch in batches:
            for i in range(batch.num_rows):
                for row in _inside(batch.column("path")[i].as_py(), batch.column("content")[i].as_py() or b"", None, 0, depth, cap):
                    rows.append(row)
                    held += len(row[1] or b"")
                    if held >= OUT_BYTES or len(rows) >= 1024:
                        yield flush()
                        rows, held = [], 0
        if rows:
            yield flush()

    return files.select("path", "content").mapInArrow(run, "path string, content binary, parent_sha256 string, depth int, gap string, n_members long, n_bytes long")


def unpacked(files: DataFrame, *, depth: int = 2, cap: int = TOTAL_BYTES) -> DataFrame:
    """(path, content, parent_sha256, depth) of files and of what they hold, without the rows of gaps."""
    return scanned(files, depth=depth, cap=cap).filter("gap IS NULL").select("path", "content", "parent_sha256", "depth")


def coverage_gaps(found: DataFrame) -> DataFrame:
    """(path, source, category, severity, message): a finding for each archive of `scanned` rows that was left before its end."""
    said = F.concat(F.lit("left after "), F.col("n_members").cast("string"), F.lit(" members of "), F.col("n_bytes").cast("string"), F.lit(" bytes: "), "gap")
    return found.filter("gap IS NOT NULL").select("path", F.lit("ingest").alias("source"), F.lit("coverage_gap").alias("category"), F.lit("info").alias("severity"), said.alias("message"))


def expand(files: DataFrame, *, cap: int = TOTAL_BYTES) -> DataFrame:
    """(path, content, parent_sha256) of the members of each archive among `files` (path, content)."""
    return unpacked(files, depth=1, cap=cap).filter("depth = 1").drop("depth")


def encrypted_payloads(entries: DataFrame) -> DataFrame:
    """Parents with more than two members of over 50 bytes, other than libraries, of entropy over 7.8 (parent, path, size, entropy)."""
    odd = entries.filter(~F.lower("path").endswith(".dll") & (F.col("size") >= 50) & (F.col("entropy") > 7.8))
    return odd.groupBy("parent").agg(F.count("*").alias("n")).filter("n > 2")
