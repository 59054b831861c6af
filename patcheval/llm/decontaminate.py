"""Benchmark passages in documents: a prefix-filtered join of shingles, then exact windows.

Each window of an item is a set of shingles at known places. A document that has the window has all of them, so it is enough
to join on one, the rarest by its count over all documents; its place bounds where the window starts, and the words there
are compared one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patcheval.functions.stage import staged
from patcheval.llm.common import KEY, ascii_lower, keep_rows, row_key, text_of

WINDOW, SHINGLE = 10, 5
#: Rows of shingles that are broadcast, some 24 bytes each; beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), _BREAK), lambda w: w != "")


def _shingles(hashes: Column, k: int) -> Column:
    """A hash of each ``k`` neighbours, in order; the last ``k`` - 1 are of fewer, which the windows' bounds rule out."""
    if k == 1:
        return F.transform(hashes, lambda h: F.xxhash64(F.lit(1), h))
    shifted = [hashes] + [F.slice(hashes, F.lit(j + 1), F.greatest(F.size(hashes) - j, F.lit(0))) for j in range(1, k)]
    return F.transform(F.arrays_zip(*[s.alias(f"c{j}") for j, s in enumerate(shifted)]), lambda t: F.xxhash64(F.lit(k), *[t[f"c{j}"] for j in range(k)]))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(wid, words) of each different window, and (wid, item_id) of those that have it. Items of fewer words are one window; without words none."""
    w = items.select("item_id", words_of(text_of()).alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - window + 1, F.lit(1)))
    each = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("_w"), i, window))).alias("words")).distinct()
    # named by its words, joined: words hold no blank
    named = staged(each.select("item_id", F.array_join("words", " ").alias("wid"), "words"), "windows")
    return named.select("wid", "words").distinct(), named.select("wid", "item_id")


def _joined(docs: DataFrame, index: DataFrame, sizes: list[int], small: bool) -> DataFrame:
    """Places of the index's shingles in the documents: the documents' key, n_words, _at, _k, and the index's columns."""
    base = docs.select(*row_key(), _hashes(words_of(text_of())).alias("_h")).withColumn("n_words", F.size("_h").cast("long"))
    parts = []
    for k in sizes:
        p = base.select(*KEY, "n_words", F.posexplode(_shingles(F.col("_h"), k)).alias("_at", "_s"))
        of_size = index.where(F.col("_k") == k)
        parts.append(p.join(F.broadcast(of_size) if small else of_size.hint("merge"), "_s"))
    return reduce(DataFrame.unionByName, parts)


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(key, start, length, wid) of every window that occurs in a document, and the windows' items. No row twice."""
    windows, owners = benchmark_windows(items, window)
    k = F.least(F.size("words"), F.lit(shingle))
    every = reduce(
        DataFrame.unionByName,
        [
            windows.where(k == n).select("wid", "words", F.lit(n).alias("_k"), F.posexplode(F.slice(_shingles(_hashes(F.col("words")), n), F.lit(1), F.size("words") - n + 1)).alias("_off", "_s"))
            for n in range(1, shingle + 1)
        ],
    )
    every = staged(every, "window-shingles")
    kinds = every.groupBy("_k").agg(F.count_distinct("_s").alias("n")).collect()  # at most ``shingle`` rows
    sizes, rows = [r["_k"] for r in kinds], sum(r["n"] for r in kinds)
    if not sizes:
        sizes = [shingle]
    small = rows <= broadcast_rows
    # every place of a benchmark shingle in any document: few, as documents seldom quote benchmarks
    places = staged(_joined(docs, every.select("_k", "_s").distinct(), sizes, small), "shingle-places")
    # rarity over all documents; the first of equally rare ones
    often = places.groupBy("_k", "_s").agg(F.count(F.lit(1)).alias("_often"))
    prefix = every.join(often, ["_k", "_s"], "left").groupBy("wid").agg(
        F.min(F.struct(F.coalesce("_often", F.lit(0)).alias("n"), F.col("_off"), F.col("_s"), F.col("_k"))).alias("p"), F.first("words").alias("words")
    ).select("wid", "words", F.col("p._off").alias("_off"), F.col("p._s").alias("_s"), F.col("p._k").alias("_k"))
    length = F.size("words")
    candidates = (
        places.join(prefix, ["_k", "_s"]).withColumn("start", F.col("_at") - F.col("_off"))
        .where((F.col("start") >= 0) & (F.col("start") + length <= F.col("n_words")))
        .select(*KEY, "wid", "words", F.col("start").cast("int").alias("start")).distinct()
    )
    texts = docs.select(*row_key(), text_of().alias("_t")).join(candidates.select(*KEY).distinct(), KEY, "left_semi")
    # one copy of rows with the same key is enough to look into
    texts = texts.dropDuplicates(KEY).select(*KEY, words_of(F.col("_t")).alias("_w"))
    asked = candidates.groupBy(*KEY).agg(F.collect_list(F.struct("start", "wid", "words")).alias("_c"))  # windows of one document
    found = (
        texts.join(asked, KEY)
        .select(*KEY, F.explode(F.filter("_c", lambda c: F.slice(F.col("_w"), c["start"] + 1, F.size(c["words"])) == c["words"])).alias("c"))
        .select(*KEY, F.col("c.start").alias("start"), F.size("c.words").alias("length"), F.col("c.wid").alias("wid"))
    )
    return found, owners


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    A word inside any occurrence of a window is hit. Null and empty texts have no words and are clean, as is everything
    against an empty benchmark; items without words have no window. items_sha256 of no items is that of ''.
    """
    found, owners = hits(docs, items, window, shingle, broadcast_rows)
    found = staged(found, "hits")
    # words covered: of starts in order each covers up to its own end or to the next start
    spans = F.array_sort(F.collect_set(F.struct("start", "length")))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        "_spans", start,
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(a["end"], s["start"]))).cast("long").alias("n"),
            F.greatest(a["end"], s["start"] + s["length"]).alias("end"),
        ),
        lambda a: a["n"],
    )
    per = found.groupBy(*KEY).agg(spans.alias("_spans"), F.array_sort(F.collect_set("wid")).alias("_set")).select(*KEY, covered.alias("n_hit"), "_set")
    per = staged(per, "hit-documents")
    # documents with the same windows have the same items: these are joined once for each different set
    sets = per.select("_set").distinct()
    ids = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    of_set = sets.select("_set", F.explode("_set").alias("wid")).join(owners, "wid").groupBy("_set").agg(ids.alias("_ids"))
    of_set = of_set.select("_set", F.size("_ids").cast("long").alias("n_items"), F.array_join("_ids", ",").alias("_said"))
    facts = per.join(of_set, "_set", "left").select(*KEY, "n_hit", "n_items", "_said")
    rows = docs.select("doc_id", *row_key(), F.size(words_of(text_of())).cast("long").alias("n_words"))
    said = F.coalesce("_said", F.lit(""))
    return rows.join(facts, KEY, "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.sha2(said.cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The rows without any window of ``items``, with the columns of ``docs``."""
    found, _ = hits(docs, items, window, shingle)
    return keep_rows(docs, staged(found.select(*KEY).distinct(), "hit-keys"), "left_anti")
