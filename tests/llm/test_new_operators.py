"""Compression classifier, Merkle manifest and vector codes against plain versions."""

from __future__ import annotations

import os
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute as B  # noqa: E402

from patcheval.llm import exact_dedup, license_scan, merkle, quality, vector_codes  # noqa: E402


def counted(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# ---- 12

FIELDS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def _plain_leaf(row, text):
    return B.sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def plain_manifest(rows):
    """Rows of (doc_id, source, lang, n_chars, text), all with a known answer: equal rows may come in any order."""

    def tamper(r):
        return B.lowered(r[4]) if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[4]

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([B.sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
        return out

    def siblings(tree, at):
        path = []
        for level in tree[:-1]:
            i = at // 16 * 16
            path.append((level[i:at], level[at + 1 : i + 16]))
            at //= 16
        return path

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, _plain_leaf(r, r[4]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, (_, _, leaf, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            path = siblings(trees[s], at) + siblings(top, k)
            node = _plain_leaf(r, tamper(r))
            for left, right in path:
                node = B.sha("".join(left) + node + "".join(right))
            proof = B.sha("".join("".join(a) + "".join(b) for a, b in path))
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return Counter(out)


def test_manifest(spark):
    r = random.Random(5)
    rows = [(i, "hot", "en", 3, r.choice(["Abc", "abc", "", None, "É x"])) for i in range(700)]
    rows += [(1000 + i, f"s{i % 23}", None, None, "Text T") for i in range(60)]
    rows += [(3, "hot", "de", 3, "again"), (3, "hot", "de", 3, "again"), (None, "hot", None, None, None), (7, None, None, 1, "x"), (8, "", "", 0, "Z"), (9, "é", "", 0, "Z")]
    rows += [(5000 + i, "r16", "en", 1, "t") for i in range(16)] + [(6000 + i, "r17", "en", 1, "t") for i in range(17)]
    rows += [(7000 + i, "r256", "en", 1, "t") for i in range(256)] + [(8000 + i, "r257", "en", 1, "t") for i in range(257)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("digest", F.lit(1)).withColumn("_place", F.lit("x"))
    want = plain_manifest(rows)
    got = counted(merkle.manifest(docs, merkle.tampered_leaf()), *FIELDS)
    assert got == want and any(not x[6] for x in got) and any(x[6] for x in got)
    assert all(r.verified for r in merkle.manifest(docs).collect())
    one = docs.where("doc_id = 7 AND source IS NULL")
    assert [tuple(x) for x in merkle.manifest(one).select("proof_sha256", "verified").collect()] == [(B.sha(""), True)]
    assert merkle.manifest(docs.limit(0)).count() == 0


def test_manifest_of_many_levels(spark):
    docs = spark.range(0, 66_000, 1, 8).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).cast("long").alias("n_chars"), F.lit("t").alias("text"))
    got = merkle.manifest(docs, merkle.tampered_leaf())
    plain = plain_manifest([(i, "s", "en", 1, "t") for i in range(66_000)])
    assert counted(got, *FIELDS) == plain


# ---- 13


def plain_codes(rows):
    """Rows of (vec_id, vector, label), measured all with all in each round."""
    import hashlib
    import math

    kept = [(i, [math.floor(4096 * float(np.float32(c))) for c in v], n) for i, v, n in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    if not kept:
        return Counter()
    width = -(-max(len(v) for _, v, _ in kept) // 8)
    kept = [(i, np.array(v + [0] * (8 * width - len(v)), object).reshape(8, width), n) for i, v, n in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1].reshape(-1).tolist()))[:16]
    books = [[r[1][p].tolist() for r in first] for p in range(8)]

    def nearest(v, p):
        d = [sum((a - b) ** 2 for a, b in zip(v[p].tolist(), c, strict=True)) for c in books[p]]
        return min(range(len(d)), key=lambda j: (d[j], j)), min(d)

    for _ in range(6):
        found = [[nearest(v, p)[0] for p in range(8)] for _, v, _ in kept]
        for p in range(8):
            for j in range(len(first)):
                of = [kept[k][1][p].tolist() for k in range(len(kept)) if found[k][p] == j]
                if of:
                    books[p][j] = [sum(c) // len(of) for c in zip(*of, strict=True)]
    out, errors = [], Counter()
    for i, v, n in kept:
        near = [nearest(v, p) for p in range(8)]
        errors[n] += sum(d for _, d in near)
        out.append((i, "".join(f"{j:02x}" for j, _ in near), sum(d for _, d in near), n))
    books = B.sha(",".join(str(c) for p in books for e in p for c in e))
    return Counter((i, code, e, errors[n], books) for i, code, e, n in out)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1.5, "x") for r in rows], "vec_id long, embedding array<float>, label int, v double, state string")


CODES = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


@pytest.mark.parametrize("few", [True, False])
def test_vector_codes(spark, monkeypatch, few):
    r = np.random.default_rng(3)
    if not few:
        monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    centres = r.normal(0, 1, (30, 16))
    rows = [(int(i), (centres[i % 30] + r.normal(0, 0.1, 16)).tolist(), int(i % 4) if i % 5 else None) for i in r.permutation(500)]
    rows += [(7, [0.5] * 16, 1)] * 40 + [(None, [0.25] * 16, None)] * 3 + [(900, None, 1), (901, [1.0, None] * 8, 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] + [0.0] * 15, 1)]
    want = plain_codes(rows)
    assert counted(vector_codes.compress(vectors(spark, rows)), *CODES) == want


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [0.1] * 8, 1)], [(2, [0.1, -0.1, 3.0], 1), (1, [], 2), (1, [], 2)], [(1, [], 1)], [(i, [float(i % 3)] * 16, 1) for i in range(60)]])
def test_small_vector_tables(spark, rows):
    assert counted(vector_codes.compress(vectors(spark, rows)), *CODES) == plain_codes(rows)


def test_large_components_are_an_error():
    import pyarrow as pa

    with pytest.raises(ValueError):
        vector_codes._integers(pa.array([[1e9] * 8], pa.list_(pa.float64())), 1, 8)


def test_bounds_save_scans():
    r = np.random.default_rng(1)
    x = (r.normal(0, 1, (40, 8, 4))[r.integers(0, 40, 4000)] * 4096 + r.normal(0, 60, (4000, 8, 4))).astype(np.int64)
    history, state, scans = [x[:16].transpose(1, 0, 2).copy()], None, []
    for _ in range(10):
        state, n = vector_codes.assign(x, history, state)
        scans.append(n)
        for p in range(8):
            d = ((x[:, p, None, :] - history[-1][p][None]) ** 2).sum(2)
            assert (state.entry[:, p] == d.argmin(1)).all()
        sums = vector_codes.totals(x, state.entry, 16).reshape(-1).tolist()
        history.append(vector_codes.moved_book(history[-1], sums))
    assert scans[0] == 32_000 and max(scans[2:]) < 16_000 and scans[-1] < 3000


# ---- 11


def test_quality(spark):
    r = random.Random(2)
    words = ["".join(r.choice(["la", "re", "ton", "mi", "sov"]) for _ in range(3)) for _ in range(400)]
    rows, labels = [], []
    for i in range(500):
        good = i % 4 > 0
        text = " ".join(r.choice(words) for _ in range(r.randint(20, 200)))
        rows.append((i, text if good else (text.upper().replace(" ", "!! ") if i % 8 else " ".join(w + r.choice(["&&&", "$$$"]) for w in text.split()))))
        if i < 450:
            labels.append((i, int(good)))
    rows += [(1000, None), (1001, ""), (None, "x"), (3, rows[3][1]), (1002, "ton " * 100_000)]
    docs = B.documents(spark, rows)
    known = spark.createDataFrame([*labels, (1, None), (2, 7), (9999, 1), (None, 1)], "doc_id long, quality int").withColumn("x", F.lit(1))
    model = quality.train(docs, known, quality.Settings(sample=120, dictionary=1 << 14))
    got = quality.score_documents(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.7) for g in got)
    held = [g for g in got if g.held_out and g.doc_id is not None and g.doc_id < 500]
    right = [g.predicted == int(g.doc_id % 4 > 0) for g in held]
    assert len(held) > 80 and sum(right) > 0.95 * len(right)
    # the score against the plain rule
    import zstandard

    both = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.good, model.bad)]
    texts = {i: (t or "").encode() for i, t in rows}
    for g in got:
        t = texts[g.doc_id]
        sizes = [sum(len(c.compress(t[k : k + 2048])) for k in range(0, len(t), 2048)) for c in both]
        assert abs(g.score - 1 / (1 + np.exp(-np.clip(model.slope * (sizes[1] - sizes[0]) / (len(t) + 1) + model.offset, -30, 30)))) < 1e-9
    again = quality.train(docs.repartition(5), known, quality.Settings(sample=120, dictionary=1 << 14))
    assert again == model
    assert quality.score_documents(docs.limit(0), model).count() == 0


def test_quality_learns_nothing_held_out(spark):
    rows = [(i, f"text {i} " * 5) for i in range(300)]
    docs, labels = B.documents(spark, rows), spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    sample, counts = quality._chosen(docs, labels, quality.Settings(sample=1000))
    assert {r._l for r in sample.collect()} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 4 != 2} and sum(counts.values()) == sample.count()


def test_quality_without_labels(spark):
    docs = B.documents(spark, [(1, "a"), (2, None)])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score_documents(docs, quality.train(docs, labels)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    got = {r.score for r in quality.score_documents(docs, quality.train(docs, one)).collect()}
    assert len(got) == 1 and got.pop() > 0.5


# ---- edges of earlier operators


def test_documents_with_maps(spark):
    docs = B.documents(spark, [(1, "a b"), (1, "a b"), (2, "ab"), (3, None)]).withColumn("facts", F.create_map(F.lit("k"), F.col("doc_id")))
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns and sorted((r.doc_id, r.facts["k"]) for r in left.collect()) == [(1, 1), (3, 3)]


def test_no_templates(spark):
    assert {r.license_id for r in license_scan.scan_licenses(B.documents(spark), ()).collect()} == {None}
