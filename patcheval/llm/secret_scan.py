"""Secrets: single patterns, and credentials whose parts stand near each other.

Some parts are secrets only together: an access identifier, a random-looking string and the endpoint both are for. Parts of
each sort are found alone; each weak one is then joined to the parts of other sorts whose intervals
lie within a scope around it, and reported only if complementary ones are there: an identifier and material are a credential,
with or without an endpoint. An endpoint and material without an identifier are listed apart, as less sure.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patcheval.llm.common import text_of

KINDS = ("assign", "access", "hex", "identifier", "material", "endpoint")
# fixed values: the base patterns of the contract
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
# parts that are weak alone
_IDENTIFIER = re.compile(r"(?<![A-Za-z0-9_])(?:(?:client|user|account|access)[_-]?(?:id|name|key)|login|username)[\"']?\x20{0,4}[:=]\x20{0,4}[\"']?([A-Za-z0-9_.@-]{3,128})", re.I | re.A)
_MATERIAL = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}", re.A)
_ENDPOINT = re.compile(r"(?<![a-z0-9+.-])(?:https?|s3|amqps?|mongodb|postgres(?:ql)?|mysql|redis|jdbc:[a-z]{2,12})://[^\s\"'<>]{3,400}", re.A)
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")


def _entropy(s: str) -> float:
    from math import log2

    n = len(s)
    return -sum(c / n * log2(c / n) for c in Counter(s).values())


def _random_looking(s: str) -> bool:
    """Spread evenly, and of letters of both cases and digits; or of fewer sorts that change more often than in words, names and
    numbers; or capitals alone without marks between."""
    if _entropy(s) < 3.5:
        return False
    digit, lower, upper = any(map(str.isdigit, s)), any(map(str.islower, s)), any(map(str.isupper, s))
    if digit and lower and upper:
        return True
    sorts = ["d" if c.isdigit() else "l" if c.islower() else "u" for c in s if c.isalnum()]
    changes = sum(map(str.__ne__, sorts, sorts[1:]))
    if digit:
        return 6 * changes >= len(s)
    return 3 * changes > len(s) if lower else upper and len(sorts) == len(s)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of assignments, access keys and long hexadecimal strings, each kind leftmost without overlap."""
    out = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    # a run of hexadecimal digits has 24 exactly if it matches here, and then as a whole
    out += [(*m.span(), "hex") for m in _LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


class _Intervals:
    """Intervals by start, to ask whether any lies in a scope."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = sorted(spans)
        self.starts = [s for s, _ in self.spans]
        self.ends = sorted(e for _, e in spans)

    def count(self, start: int, end: int) -> int:
        """How many intervals overlap [start, end): those that have begun before its end without those that ended before its start."""
        return bisect_left(self.starts, end) - bisect_right(self.ends, start)

    def meets(self, start: int, end: int) -> bool:
        return self.count(start, end) > 0


def linked_spans(text: str, base: list[tuple[int, int, str]], scope: int = 200) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Weak parts within ``scope`` characters of others, sure ones and less sure ones.

    An identifier is an access key or a user or client name; material is an assignment, long hex, or a random-looking
    string; an endpoint is a URL of a service. Sure are an identifier and material near each other that are not the same string,
    and each part with both other sorts near; less sure are an endpoint and material otherwise. Parts that overlap a base span are not
    reported again.
    """
    ends = [m.span() for m in _ENDPOINT.finditer(text)]
    names = [m.span(1) for m in _IDENTIFIER.finditer(text)]
    if not (ends or names or base):
        return [], []
    stuff = [m.span() for m in _MATERIAL.finditer(text) if _random_looking(m[0])]
    whole = _Intervals([(s, e) for s, e, _ in base])
    urls = _Intervals(ends)
    stuff = [s for s in stuff if not whole.meets(*s) and not urls.meets(*s)]
    sorts = {
        "identifier": _Intervals(names + [(s, e) for s, e, k in base if k == "access"]),
        "material": _Intervals(stuff + [(s, e) for s, e, k in base if k != "access"]),
        "endpoint": urls,
    }
    sure, unsure = [], []
    for kind, spans in (("identifier", names), ("material", stuff), ("endpoint", ends)):
        others = [k for k in sorts if k != kind]
        for start, end in spans:
            if whole.meets(start, end):
                continue
            near = {k: sorts[k].meets(start - scope, end + scope) for k in others}
            mate = {"identifier": "material", "material": "identifier"}.get(kind)
            if all(near.values()) or mate and sorts[mate].count(start - scope, end + scope) > sorts[mate].count(start, end):
                sure.append((start, end, kind))
            elif near.get({"material": "endpoint", "endpoint": "material"}.get(kind)):
                unsure.append((start, end, kind))
    return sure, unsure


def _said(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _run(scope: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py()
                base = base_spans(text)
                sure, unsure = linked_spans(text, base, scope)
                every, less = (sorted(x, key=lambda s: (s[0], KINDS.index(s[2]))) for x in (base + sure, unsure))
                n = Counter(k for _, _, k in base)
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(_said(base).encode()).hexdigest(), _said(every), _said(less)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:3]], *[pa.array(c, pa.string()) for c in columns[3:]]],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "unsure_spans"],
            )

    return run


def scan_secrets(docs: DataFrame, scope: int = 200) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, unsure_spans) for every row; a null or empty text has no spans. Scopes lie within a
    text, so nothing is shuffled; all passes over a text are linear in it, the join in the number of its parts times its logarithm."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).mapInArrow(
        _run(scope), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, unsure_spans string"
    )


def span_rows(scanned: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end) for each span."""
    part = F.split("_s", ":")
    return (
        scanned.where("spans <> ''").select("doc_id", F.explode(F.split("spans", ",")).alias("_s"))
        .select("doc_id", part[0].alias("kind"), part[1].cast("long").alias("start"), part[2].cast("long").alias("end"))
    )
