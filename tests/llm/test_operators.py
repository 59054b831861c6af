"""Each operator against a plain version, over nulls, empty and very long texts, repeated rows and clashing columns."""

from __future__ import annotations

import os
import random
import re
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute as B  # noqa: E402

from patcheval.llm import decontaminate, exact_dedup, license_scan, pii, secret_scan, simhash, token_file, token_lengths, toxicity  # noqa: E402
from patcheval.llm import pieces as P  # noqa: E402
from patcheval.llm.common import tokenizer_file  # noqa: E402
from patcheval.llm.word_cache import WordEncoder  # noqa: E402


def counted(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def docs(spark):
    return B.documents(spark)


@pytest.fixture(scope="module")
def no_docs(spark):
    return B.documents(spark, [])


def random_texts(n, seed=3):
    r = random.Random(seed)
    bits = [" ", "a", "th", "é", "▁", "\n", "  ", "<|endoftext|>", "①", "日本", "'s", "1", "\x00", "tion", "́", "\x1c", "　", "😀", "<s>"]
    return ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(n)]


# ---- 3, 4, 9


def test_pieces_like_the_library():
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = random_texts(3000) + [t or "" for _, t in B.TEXTS] + [("ab " * 400_000) + "end", "z" * 5000 + "é"]

    def want(t):
        ids = sp.encode(t, add_eos=True)
        return len(ids), B.sha(" ".join(map(str, ids))), B.sha(sp.decode(ids))

    encoder = P.PieceEncoder(path, entries=50)  # tables are dropped many times
    assert list(encoder.rows(texts)) == [want(t) for t in texts]
    m = encoder.model
    for t in texts[:300]:
        assert m.decode(sp.encode(t, add_eos=True)) == sp.decode(sp.encode(t, add_eos=True))


def test_encode_and_decode(spark, docs, no_docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    want = Counter()
    for i, t in B.TEXTS:
        ids = sp.encode(t or "", add_eos=True)
        want[i, len(ids), B.sha(" ".join(map(str, ids))), B.sha(sp.decode(ids))] += 1
    assert counted(P.encode_and_decode(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert P.encode_and_decode(no_docs).count() == 0


def test_word_encoder_like_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    texts = random_texts(3000, 4) + [t or "" for _, t in B.TEXTS] + ["ab " * 400_000]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)]
    e = WordEncoder(path, entries=50)
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(texts)] == want


def test_codes():
    r = np.random.default_rng(1)
    for counts in (np.zeros(5, int), np.array([0, 7]), np.array([3, 3]), r.integers(0, 9, 300), 2 ** np.arange(40), r.zipf(1.3, 5000)):
        n = token_file.code_lengths(np.asarray(counts, np.int64), 16)
        used = n[n > 0]
        assert (n > 0).tolist() == (np.asarray(counts) > 0).tolist()
        assert len(used) < 2 or (0.5**used).sum() == 1 and used.max() <= 16
        if len(used):
            ids = r.choice(np.flatnonzero(n), 3001)
            bits, marks = token_file.pack(ids, token_file.canonical_codes(n), n, 64)
            assert token_file.Decoder(n).block(bits, marks, len(ids), 64).tolist() == ids.tolist()
            # from a checkpoint on, without what is before it
            assert token_file.Decoder(n).block(bits, marks[5:], len(ids) - 320, 64).tolist() == ids[320:].tolist()


def test_best_lengths_without_limit():
    import heapq

    counts = np.random.default_rng(2).integers(1, 1000, 64)
    heap, total = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        total += x
        heapq.heappush(heap, x)
    assert (token_file.code_lengths(counts, 30) * counts).sum() == total


def test_token_files(spark, docs, no_docs, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    path = str(tmp_path / "a")
    token_file.write_token_files(docs, path, tokenizer_file("byte_bpe_50k.json"), 0, parts=3, block_ids=40, step=16)
    rows = [tuple(r) for r in token_file.read_token_files(spark, path, 16).orderBy("start").collect()]
    ids = {i: [] for i, _ in B.TEXTS}
    for i, x in B.TEXTS:
        ids[i].append(tuple([*t.encode(x or "", add_special_tokens=False).ids, 0]))
    at, want = 0, []
    for i in sorted(ids, key=lambda i: (i is not None, i)):
        for x in sorted(ids[i], key=lambda x: np.array(x, "<u2").tobytes()):
            want.append((i, at, len(x), B.crc(x)))
            at += len(x)
    assert rows == want
    assert token_file.token_file_report(no_docs).count() == 0
    assert spark.read.parquet(f"{path}/blocks").count() > 3


def test_length_limits(spark, docs, no_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    n = [len(t.encode(x or "", add_special_tokens=False).ids) for _, x in B.TEXTS]
    got = token_lengths.limit_table(token_lengths.length_histogram(docs)).cache()
    want = [
        (x, n.count(x), sum(y <= x for y in n), sum(y > x for y in n), sum(y for y in n if y <= x), sum(min(x, y) for y in n), sum(max(0, y - x) for y in n), sum(y <= x for y in n) / len(n))
        for x in sorted(set(n))
    ]
    assert [tuple(r) for r in got.orderBy("n_tokens").collect()] == want
    limits = [0, 1, 5, 20, 4096, 10**7]
    assert [tuple(r) for r in token_lengths.at_limits(got, limits).orderBy("context_limit").collect()] == [(x, sum(min(x, y) for y in n), sum(y > x for y in n)) for x in limits]
    assert token_lengths.limit_table(token_lengths.length_histogram(no_docs)).count() == 0


# ---- 5, 6


def test_exact_duplicates(spark, docs, no_docs):
    want, groups = Counter(), {}
    for i, t in B.TEXTS:
        groups.setdefault(B.stripped(t), []).append((-len(t or ""), i is None, i))
    for i, t in B.TEXTS:
        g = groups[B.stripped(t)]
        best = min(g, key=lambda x: (x[0], x[1], x[2] or 0))
        want[i, best[2], len(g), B.sha(B.stripped(t))] += 1
    for block in (3, 4096):
        got = exact_dedup.exact_duplicates(docs if block > 3 else docs.where("n_chars is null or n_chars < 1000"), block)
        if block > 3:
            assert counted(got, "doc_id", "keep_id", "group_size", "text_sha256") == want
        kept = got.where("kept").collect()
        assert len(kept) == got.select("text_sha256").distinct().count() and all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup.exact_duplicates(no_docs).count() == 0
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len(groups)


def test_names_follow_the_order(spark):
    keys = spark.range(500).select(F.xxhash64("id").alias("_h"), F.col("id").alias("_a"))
    got = [r["name"] for r in exact_dedup.sorted_names(keys, ["_h", "_a"], 16).orderBy("_h", "_a").collect()]
    assert got == list(range(1, 501))


def test_fingerprints():
    for _, t in B.TEXTS:
        assert simhash.fingerprint(t or "") % 2**64 == B.fingerprint(t)


@pytest.mark.parametrize("group", [2, 10_000])
def test_links_are_all_found(spark, group):
    r = random.Random(5)
    fps = {0, 1, -1}
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(25):
            y = x
            for _ in range(r.randint(0, 4)):
                y ^= 1 << r.randrange(64)
            fps.add(y - 2**64 if y >= 2**63 else y)
    fps = sorted(fps)
    rows = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) % 2**64).bit_count() <= 3}
    got = simhash.links(rows, 3, group)
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)
    roots = {x.fp: x.root for x in simhash.components(got).collect()}
    plain = B.component_roots([x % 2**64 for x in fps])
    assert {frozenset(k for k in roots if roots[k] == v) for v in roots.values()} == {
        s for v in plain.values() if len(s := frozenset(k - 2**64 if k >= 2**63 else k for k in plain if plain[k] == v)) > 1
    }


def test_long_chains(spark):
    pairs = spark.range(300).select(F.col("id").alias("fp"), (F.col("id") + 1).alias("fp2"))
    assert {r.root for r in simhash.components(pairs).collect()} == {0}


def test_near_duplicates(spark, docs, no_docs):
    roots = B.component_roots([B.fingerprint(t) for _, t in B.TEXTS])
    ids = {}
    for i, t in B.TEXTS:
        ids.setdefault(roots[B.fingerprint(t)], []).append(i)
    want = Counter()
    for i, t in B.TEXTS:
        own = [x for x in ids[roots[B.fingerprint(t)]] if x is not None]
        want[i, f"{B.fingerprint(t):016x}", min(own, default=None)] += 1
    assert counted(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len(set(roots.values()))
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.drop_near_duplicates(no_docs).count() == 0


# ---- 10


def items_of(spark):
    w = B.PROSE.split()
    rows = [(1, " ".join(w[:12])), (2, "Quick BROWN fox"), (3, None), (4, "!! ..."), (5, " ".join(w[3:18]) + " x"), (6, "one"), (10, " ".join(w[:12])), (7, "of of of of of of of of of of of of")]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("rows", [0, 500_000])
def test_contamination(spark, docs, no_docs, rows):
    listed, items = items_of(spark)
    texts = [*B.TEXTS, (20, "of " * 30), (21, B.PROSE + " . " + B.PROSE)]
    want = Counter((i, *B.contamination(t, listed)) for i, t in texts)
    got = decontaminate.contamination(B.documents(spark, texts), items, broadcast_rows=rows)
    assert counted(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    if rows:
        assert decontaminate.contamination(docs, items.limit(0)).where("contaminated").count() == 0
        assert decontaminate.contamination(no_docs, items).count() == 0
        left = decontaminate.drop_contaminated(docs, items)
        assert left.columns == docs.columns and left.count() == sum(not B.contamination(t, listed)[4] for _, t in B.TEXTS)


# ---- 1


def test_toxicity(spark, no_docs):
    r = random.Random(9)
    words = ["".join(r.choice("lare ton mi sov".split(" ")) for _ in range(3)) for _ in range(300)]
    bad = ["wretchling", "foulmouth", "dreckhead"]
    rows, labels = [], []
    for i in range(1200):
        t = [r.choice(words) for _ in range(r.choice((8, 60, 300)))]
        toxic = i % 3 == 0
        if toxic:
            t.insert(r.randrange(len(t)), r.choice(bad))
        rows.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    rows += [(5000, None), (5001, ""), (None, "wretchlinng " + " ".join(words[:9])), (5002, B.LONG), (0, rows[0][1])]
    labels += [(None, 1), (7, None), (9999, 1), (3, 1)]
    docs, table = B.documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, table, toxicity.Settings(buckets=1 << 14, sample=400))
    got = toxicity.score_documents(docs, model)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    known = {i: int(x) for i, x in labels[:1200]}
    scored = got.collect()
    held = [x for x in scored if x.held_out and x.doc_id in known]
    assert len(scored) == len(rows) and 200 < len(held) < 400
    assert sum(x.predicted == known[x.doc_id] for x in held) / len(held) > 0.97
    assert all(0 <= x.score <= 1 for x in scored)
    by_id = {x.doc_id: x for x in scored}
    assert by_id[5000].score == by_id[5001].score and by_id[None].predicted == 1 and by_id[None].held_out is False
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns and left.count() == sum(x.predicted == 0 for x in scored)
    assert toxicity.score_documents(no_docs, model).count() == 0
    # without labels, or texts, everything gets the same
    assert {x.score for x in toxicity.score_documents(docs, toxicity.train(docs, table.limit(0))).collect()}.__len__() == 1


def test_an_id_of_many_rows_leaves_others_in_the_sample(spark):
    s = toxicity.Settings(buckets=1 << 10, sample=20)
    ids = [i for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    learned = [r.i for r in spark.createDataFrame([(i,) for i in ids], "i long").where(~toxicity.held_out(F.col("i"))).orderBy(F.xxhash64(F.lit(s.seed), "i")).collect()]
    hot = learned[0]  # the first of the sample, with more rows than the sample has
    rows = [(i, "vile dreck words" if i % 2 else "some mild words") for i in ids if i != hot] + [(hot, f"row {k}") for k in range(200)]
    model = toxicity.train(B.documents(spark, rows), labels, s)
    assert model.softmax.any()  # both classes were there


def test_every_part_of_long_words_counts():
    s = toxicity.Settings()
    r = random.Random(2)
    for n in (79, 80, 81, 85, 86, 87, 126, 127, 1000):
        w = "".join(r.choice("abcdefghij") for _ in range(n))
        parts = toxicity.words_of(w, s)
        assert max(map(len, parts)) <= 80
        for k in s.grams:
            assert all(any(w[i : i + k] in p for p in parts) for i in range(n - k + 1))
    clean = ["".join(r.choice(("la", "re", "to", "mi")) for _ in range(3)) for _ in range(200)]
    texts = [" ".join(r.choice(clean) for _ in range(30)) for _ in range(300)]
    texts = [t + " wretchling foulmouth" if i % 2 else t for i, t in enumerate(texts)]
    model = toxicity.fit(texts, [i % 2 for i in range(300)], (150, 150), toxicity.Settings(buckets=1 << 14))
    for mark in ("_", "\u200b", ""):
        ends = [mark.join(r.choice(clean) for _ in range(60)) for _ in range(2)]
        good, bad = toxicity.Scorer(model).probability([mark.join(ends), mark.join([ends[0], "wretchling", "foulmouth", ends[1]])])
        assert good < 0.5 < bad and bad > good + 0.2, (mark, good, bad)


def test_held_out_rule(spark):
    import zlib

    got = spark.range(400).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


# ---- 7


def test_base_spans():
    text = "éé API_KEY: 'abcdef' token=abc pasſwd=abcdefg AKIA" + "A" * 15 + " AKIA" + "B" * 20 + " " + "0" * 23 + "g" + "a" * 24 + "secret\" = \"x.y=z/w+1"
    got = [(text[s:e], k) for s, e, k in secret_scan.base_spans(text)]
    assert got == [("API_KEY: 'abcdef", "assign"), ("AKIA" + "B" * 20, "access"), ("a" * 24, "hex"), ('secret" = "x.y=z/w+1', "assign")]


def test_linked_spans(spark, docs, no_docs):
    weak = "user_id: backup-bot, aB3dE5fG7hJ9kL1mN3pQ5rS7 for https://store.example.com/api"
    alone = ["user_id: backup-bot is all", "aB3dE5fG7hJ9kL1mN3pQ5rS7", "see https://store.example.com/api", "user_id: backup-bot" + " far" * 200 + " aB3dE5fG7hJ9kL1mN3pQ5rS7 https://store.example.com/api"]
    rows = [(100 + i, t) for i, t in enumerate([weak, *alone])]
    got = {r.doc_id: r.spans for r in secret_scan.scan_secrets(B.documents(spark, rows)).collect()}
    kinds = [s.split(":")[0] for s in got[100].split(",")]
    assert kinds == ["identifier", "material", "endpoint"] and all(got[100 + i] == "" for i in range(1, 5))
    all_rows = secret_scan.scan_secrets(docs)
    assert all_rows.count() == len(B.TEXTS) and secret_scan.scan_secrets(no_docs).count() == 0
    one = all_rows.where("doc_id = 13").first()
    text = dict(B.TEXTS)[13]
    (span,) = secret_scan.span_rows(all_rows.where("doc_id = 13 and n_assign = 1")).where("kind = 'assign'").collect()
    assert text[span.start : span.end] == "password = 'hunter22" and one.base_sha256 == B.sha(f"assign:{span.start}:{span.end}")
    assert all_rows.where("doc_id = 4").first().base_sha256 == B.sha("")


def test_pairs_of_parts(spark):
    key, long = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "aB3dE5fG7hJ9kL1mN3pQ5rS7" * 20
    texts = [
        f"aws_access_key_id = AKIA{'ABCDEFGH23456789'}\naws_secret_access_key = {key}",  # no endpoint
        f"client_id: web-frontend\nprivate: {long}",  # a run of 480 characters
        "login = bob value QmFzZVdpdGhvdXREaWdpdHNPZlJhbkRvTVh", "login = bob value JBSWY3DPEHPK3PXPQ2TNOA4W", "login = bob value QWXZRTPLKJHGFDSAMNBVCY",
        f"{key} at https://store.example.com/api", f"user_id: {key}", "login = bob getUserAccountInformationFromServer", "login = bob see 2024-01-01/some-long-title-of-a-page",
    ]
    got = {r.doc_id: r for r in secret_scan.scan_secrets(B.documents(spark, list(enumerate(texts)))).collect()}
    kinds = [[x.split(":")[0] for x in got[i].spans.split(",") if x] for i in range(len(texts))]
    assert kinds == [["access", "material"], *[["identifier", "material"]] * 4, [], [], [], []]
    assert got[0].spans.endswith(f"material:{texts[0].index(key)}:{len(texts[0])}") and got[1].spans.endswith(f":{len(texts[1])}")
    assert [x.split(":")[0] for x in got[5].unsure_spans.split(",")] == ["material", "endpoint"] and not any(got[i].unsure_spans for i in (0, 1, 2, 3, 4, 6, 7, 8))


# ---- 2


def test_licenses(spark, docs, no_docs):
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert got[13].license_id == "MIT" and got[13].dice == 1.0 and got[1].license_id is None and got[4].license_ids == ""
    wrapped = dict(license_scan.TEMPLATES)["ISC"].replace(" ", "\n", 12)
    rows = [(1, "intro\n\n" + wrapped + "\n\nmore"), (2, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."), (3, "License License License"), (4, "MIT")]
    got = {r.doc_id: (r.license_id, r.license_ids) for r in license_scan.scan_licenses(B.documents(spark, rows)).collect()}
    assert got == {1: ("ISC", "ISC"), 2: ("Apache-2.0", "Apache-2.0,CC-BY-NC-4.0"), 3: (None, ""), 4: (None, "")}
    assert license_scan.scan_licenses(docs).count() == len(B.TEXTS) and license_scan.scan_licenses(no_docs).count() == 0


def test_licenses_inside_texts(spark, monkeypatch):
    """Notices in the middle of a line, behind comment marks, with words taken out and put in, across segments."""
    monkeypatch.setattr(license_scan, "SEGMENT", 64)
    known = dict(license_scan.TEMPLATES)  # the last of an identifier is its long text
    mit, filler = known["MIT"], " ".join(f"word{i}" for i in range(300))
    words = mit.split(" ")
    commented = "\n".join("# " + " ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    longer = " ".join(words[:40] + ["any", "more", "words", "here", "that", "were", "put", "in"] + words[40:])
    shorter = " ".join(words[:30] + words[42:])
    half = " ".join(words[: len(words) // 2])
    rows = [
        (1, 'x = f(y)  # Released under the MIT License. see z'), (2, f"{commented}\nimport os\n{filler}"), (3, f"{filler}\n// SPDX-License-Identifier: Apache-2.0\n{filler}"),
        (4, f"{filler} {longer} {filler}"), (5, f"{filler} {shorter} {filler}"), (6, f"{filler} {half} {filler}"), (7, filler), (8, known["BSD-2-Clause"].replace("1.", "").replace("2.", "")),
        (9, "spdx license identifier"), (10, f"{filler} {mit} " * 4),
    ]
    got = {r.doc_id: (r.license_id, r.dice) for r in license_scan.scan_licenses(B.documents(spark, rows)).collect()}
    assert [got[i][0] for i in range(1, 11)] == ["MIT", "MIT", "Apache-2.0", "MIT", "MIT", None, None, "BSD-2-Clause", None, "MIT"]
    assert [got[i][1] for i in (1, 2, 3, 10)] == [1.0] * 4 and 0.8 < got[5][1] < 1 and 0.8 < got[4][1] < 1


def test_license_anchors_lose_nothing():
    """Any window that reaches the threshold holds an anchor."""
    rng = random.Random(9)
    for _ in range(3000):
        n = rng.randint(1, 12)
        grams = [f"{rng.choice('abcdef')} {rng.choice('xyz')}" for _ in range(n)]
        window = [rng.choice(grams) if rng.random() < 0.9 else "q q" for _ in range(rng.randint(1, 16))]
        shared = sum((Counter(grams) & Counter(window)).values())
        if 2 * shared / (n + len(window)) >= 0.8:
            assert {grams[q] for q in license_scan.anchors(grams, 0.8)} & set(window)


# ---- 8


def test_later_mentions_and_formats(spark):
    rows = [
        (1, "Mr. John Smith called. Later John Smith left, Smith said; SMITH's Anna. Card 3782 822463 10005."), (2, "John Smith is not titled here 1"),
        (3, "host 2001:db8::8a2e:370:7334 and 2001:0DB8:0000:0000:0000:8A2E:0370:7334, fe80::1; at 12:30:45 a::b std::x"), (4, "Mrs. Smith, Mr. O'Brien; O'Brien and Smith"),
    ]
    got = {r.doc_id: r for r in pii.replace_private(B.documents(spark, rows), "k").collect()}
    m = re.fullmatch(r"Mr\. (\w+) (\w+) called\. Later (\w+) (\w+) left, (\w+) said; (\w+)'s Anna\. Card (\d{4} \d{6} \d{5})\.", got[1].text)
    assert m[1] == m[3] != "John" and m[2] == m[4] == m[5] != "Smith" and m[6] == m[2].upper() and m[7] != "3782 822463 10005" and got[1].n_entities == 6
    assert got[2].text == rows[1][1] and got[2].n_entities == 0
    assert re.fullmatch(r"host [0-9a-f:]+ and [0-9a-f:]+, [0-9a-f]{4}::[0-9a-f]; at 12:30:45 a::b std::x", got[3].text) and got[3].n_entities == 3
    assert "2001" not in got[3].text and [len(x) for x in got[3].text.split(" ")] == [len(x) for x in rows[2][1].split(" ")]
    m = re.fullmatch(r"Mrs\. (\w+), Mr\. (\w+); (\w+) and (\w+)", got[4].text)
    assert m[1] == m[4] and m[2] == m[3] and got[4].n_entities == 4 and m[1] == re.match(r"Mr\. \w+ (\w+)", got[1].text)[1]


def test_surrogates(spark, docs, no_docs):
    cards = ["4111 1111 1111 1111", "4111111111111112"]
    rows = [
        (1, f"Mr. John Smith and Mrs. Anna SMITH, Frau Smith; {cards[0]}; 10.0.0.1 and 10.0.0.2"), (2, f"john@x.example.com JOHN@X.EXAMPLE.COM {cards[1]} 123-45-6789"),
        (2, f"john@x.example.com JOHN@X.EXAMPLE.COM {cards[1]} 123-45-6789"), (3, "господин Иванов +1 (499) 555-6503, 10.0.0.1"), (4, "nothing 12"), (5, None), (None, "10.0.0.2"), (6, "κύριος Ίων Νίκου"),
    ]
    got = pii.replace_private(B.documents(spark, rows), "k").collect()
    text = {r.doc_id: r.text for r in got}
    assert len(got) == len(rows) and text[4] == "nothing 12" and text[5] == ""
    m = re.match(r"Mr\. (\w+o?n) (\w+) and Mrs\. (\w+ra) ([A-Z]+), Frau (\w+); (\d{4} \d{4} \d{4} \d{4}); (\S+) and (\S+)$", text[1])
    assert m and m[2].upper() == m[4] and m[5] == m[2] and m[7] != m[8]  # one family, in its cases; two hosts

    def luhn(s):
        d = [int(c) for c in s if c.isdigit()][::-1]
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10

    a, b, card, ssn = text[2].split(" ")
    assert a.upper() == b and a.endswith(".com") and luhn(m[6]) == 0 and luhn(card) == luhn(cards[1]) and re.fullmatch(r"\d{3}-\d{2}-\d{4}", ssn)
    assert text[3].startswith("господин ") and text[3].endswith(m[7]) and text[None] == m[8] and "+1 (" in text[3]
    assert not any(x in " ".join(text.values()) for x in ("Smith", "SMITH", "John", "Иванов", "555", "10.0.0.1", "4111"))
    assert {r.text for r in pii.replace_private(B.documents(spark, rows[:1]), "other").collect()} != {text[1]}
    assert pii.replace_private(docs, "k").count() == len(B.TEXTS) and pii.replace_private(no_docs, "k").count() == 0


def test_surrogates_differ(spark):
    # so many short entities that first attempts collide
    rows = spark.range(400).select(F.lit("ip").alias("type"), F.concat(F.lit("1."), (F.col("id") % 20).cast("string"), F.lit("."), F.floor(F.col("id") / 20).cast("string"), F.lit(".9")).alias("entity"))
    names = spark.range(3000).select(F.lit("family").alias("type"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("entity"))
    got = pii.surrogates(rows.unionByName(names), "k").collect()
    assert len(got) == 3400 == len({(r.type, r.surrogate) for r in got}) and not {r.surrogate for r in got} & {r.entity for r in got}


# ---- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as pipeline

    sf = str(tmp_path)
    listed, items = items_of(spark)
    B.documents(spark).write.parquet(f"{sf}/documents.parquet")
    items.where("item_id < 6").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        before = docs.count()
        docs = spark.read.schema(docs.schema).parquet(_written(stage(spark, docs, sf), f"{sf}/{name}"))
        assert docs.columns == B.documents(spark, []).columns and docs.count() <= before
        if name == "toxicity":
            assert docs.count() == before  # nothing learned, nothing dropped
    assert Counter((r.doc_id, r.text) for r in docs.collect()) == B.pipeline(B.TEXTS, [x for x in listed if x[0] < 6])
    assert pipeline.run(spark, sf).count() == docs.count()
    empty = str(tmp_path / "empty")
    B.documents(spark, []).write.parquet(f"{empty}/documents.parquet")
    items.limit(0).write.parquet(f"{empty}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert pipeline.run(spark, empty).count() == 0


def _written(df, path):
    df.write.parquet(path)
    return path
