"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, plus signs, digits, "://" and words that announce
an account. At each anchor a local parser expands to the boundaries of an e-mail address, an IP address, a card or phone
number, an address with a login, or an account identifier, and validates it. Base kinds (email, ip, card, phone)
have the leftmost non-overlapping matches of their patterns; a match that fails validation is consumed, not retried.

Spans are code points, end exclusive. Defined results: a null text is as an empty one: no spans. Spans of different kinds may
overlap, and of equal starts the order of KINDS counts; `redact` replaces a run of overlapping spans once, under the kind that starts first.
Repeated rows are each scanned. `find` reads doc_id and text only; `redact` keeps all columns, whatever their names. Empty tables give empty
tables. A long text is scanned in one pass, whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "account")
#: Words that announce an account identifier, each also found capitalised and in capitals.
CUES = ("account", "acct", "iban", "user id", "userid", "customer id", "member id", "passport", "ssn")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOGIN = re.compile(r"://[^\s/?#@:]+(?::[^\s/?#@]*)?@[A-Za-z0-9.-]+(?::[0-9]+)?")
_ACCOUNT = re.compile(r"(?: (?:number|no\.?|id))?[ ]?[:=#][ ]*([A-Za-z0-9](?:[A-Za-z0-9_-]| (?=[0-9]{2,4}\b)){4,40})", re.ASCII)
_IBAN = re.compile(r"(?: (?:number|no\.?))?[ ]?[:=#]?[ ]*([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}){3,8})")


def luhn(digits: str) -> bool:
    """Whether the digits, every second one from the right doubled, sum to a multiple of ten."""
    total = sum(map(int, digits[-1::-2])) + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def valid_iban(s: str) -> bool:
    s = s.replace(" ", "").upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


class Finder:
    def __init__(self):
        import ahocorasick

        self.anchors = ahocorasick.Automaton()
        for word, kind in (("@", "@"), ("+", "+"), ("://", "/"), *((d, "0") for d in "0123456789")):
            self.anchors.add_word(word, (kind, len(word)))
        for cue in CUES:
            for word in {cue, cue.capitalize(), cue.title(), cue.upper()}:
                self.anchors.add_word(word, ("iban" if cue == "iban" else "cue", len(word)))
        self.anchors.make_automaton()

    def spans(self, text: str) -> list[tuple[int, str, int]]:
        """(start, kind, end) of all spans, by start, then kind in the order of KINDS."""
        found: list[tuple[int, int, int]] = []
        email = ip = card = phone = login = account = 0  # where the next match of a kind may start
        for last, (kind, size) in self.anchors.iter(text):
            if kind == "0":
                if last >= ip:
                    if m := _IP.match(text, last):
                        ip = m.end()
                        if all(map(_byte, m[0].split("."))):
                            found.append((last, 1, ip))
                    else:
                        ip = _DIGITS.match(text, last).end()
                if last >= card:
                    if m := _CARD.match(text, last):
                        card = m.end()
                        digits = m[0].replace(" ", "").replace("-", "")
                        if 12 <= len(digits) <= 19 and luhn(digits):
                            found.append((last, 2, card))
                    else:
                        card = last + 1
            elif kind == "@":
                start = last
                while start > email and text[start - 1] in _LOCAL:
                    start -= 1
                if start < last and (m := _DOMAIN.match(text, last + 1)):
                    email = m.end()
                    found.append((start, 0, email))
            elif kind == "+":
                if last >= phone and (m := _PHONE.match(text, last)):
                    phone = m.end()
                    if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                        found.append((last, 3, phone))
            elif kind == "/":
                start = at = last - 2
                while start > login and text[start - 1] in _SCHEME:
                    start -= 1
                if start < at and (m := _LOGIN.match(text, at)):
                    login = m.end()
                    found.append((start, 4, login))
            elif last + 1 >= account and (m := (_IBAN if kind == "iban" else _ACCOUNT).match(text, last + 1)):
                known = m[1].rstrip(" -_")
                begin = last + 1 - size
                alone = begin == 0 or not text[begin - 1].isalnum()
                if alone and (valid_iban(known) if kind == "iban" else sum(c.isdigit() for c in known) >= 4):
                    account = m.start(1) + len(known)
                    found.append((m.start(1), 5, account))
        found.sort()
        return [(a, KINDS[k], b) for a, k, b in found]


_SPANS = "array<struct<kind: string, start: int, end: int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end) of every row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            cells = [[{"kind": k, "start": a, "end": b} for a, k, b in finder.spans(t or "")] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cells, _ARROW)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, spans {_SPANS}")


def redacted(text: str, spans: list[tuple[int, str, int]]) -> str:
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every span in `text` replaced by its kind in angle brackets; other columns as they are."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            texts = [t and redacted(t, finder.spans(t)) for t in batch.column("text").to_pylist()]
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_pii(spark, sf_dir: str) -> DataFrame:
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    found = find(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count("login").alias("n_login"),
        count("account").alias("n_account"),
    )
