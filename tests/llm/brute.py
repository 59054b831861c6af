"""Plain versions of the operators, and small tables with what operators must stand."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _k_hash string, name string"
LONG = " ".join(f"w{i % 977}é{i % 13}" for i in range(60_000))
PROSE = "The quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree tonight"
TEXTS = [
    (1, PROSE), (2, PROSE), (2, PROSE), (3, PROSE.replace(" ", "\n")), (4, None), (5, ""), (6, "  \t\n"), (7, LONG), (8, LONG + " "),
    (9, "x" * 30_000), (10, "é日本語 ▁▁ a  b c\x00d 'll <|endoftext|> </s>"), (None, PROSE), (None, None), (11, "one"), (12, PROSE + " and sleep"),
    (13, "Mr. John Smith (mail JOHN@x.example.com, john@x.example.com) called +1 (499) 555-6503.\nReleased under the MIT License.\npassword = 'hunter22'"),
]


def documents(spark, texts=None):
    """Documents with columns whose names operators might use themselves."""
    rows = [(i, t, None, "s", None if t is None else len(t), 0.5, "k", "n") for i, t in (TEXTS if texts is None else texts)]
    return spark.createDataFrame(rows, SCHEMA)


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def stripped(t) -> str:
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def lowered(t) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def fingerprint(t) -> int:
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
    s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = np.array([xxhash.xxh64_intdigest(x.encode(), 42) for x in s], dtype=np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(s))


def component_roots(fps: list[int], bits: int = 3) -> dict[int, int]:
    """Of each different fingerprint the smallest it reaches, comparing all with all."""
    ks = sorted(set(fps))
    a, parent = np.array(ks, dtype=np.uint64), list(range(len(ks)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(ks)):
        for y in np.flatnonzero(np.bitwise_count(a[x + 1 :] ^ a[x]) <= bits):
            r, s = find(x), find(x + 1 + int(y))
            parent[max(r, s)] = min(r, s)
    return {k: ks[find(i)] for i, k in enumerate(ks)}


def doc_words(t) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))


def contamination(text, items) -> tuple:
    w, hit, found = doc_words(text), set(), set()
    for item_id, item in items:
        x = doc_words(item)
        n = min(10, len(x))
        windows = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if x else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(item_id))
    return len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def pipeline(rows, items):
    """Rows left by exact dedup, near dedup and decontamination; nothing is toxic."""
    groups = {}
    for row in rows:
        groups.setdefault(stripped(row[1]), []).append(row)
    by_id = lambda r: (r[0] is None, r[0] or 0)
    left = [min(g, key=lambda r: (-len(r[1] or ""), *by_id(r))) for g in groups.values()]
    roots = component_roots([fingerprint(t) for _, t in left])
    near = {}
    for row in left:
        near.setdefault(roots[fingerprint(row[1])], []).append(row)
    left = [min(g, key=by_id) for g in near.values()]
    return Counter(r for r in left if not contamination(r[1], items)[4])
