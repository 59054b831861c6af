"""Exact duplicates by naming blocks: equal texts, and only these, end with the same integer.

A text is cut into blocks of fixed size. All different blocks are sorted, and a block's name is its place in that order. Names
of neighbours are paired, the different pairs sorted and named likewise, until each document has one name.
Sorting goes by a 128-bit key first, so that only ties need their texts; the texts of each key are compared, and
should two differ, the next seed is taken. So a name stands for one text for certain, not just likely.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patcheval.functions.stage import staged
from patcheval.llm.common import ASCII_SPACE, KEY, keep_rows, row_key, text_of

BLOCK = 4096
#: Ranges that one sort is dealt to.
RANGES = 4096


def normalised(text: Column) -> Column:
    """The text without its ASCII white space."""
    for c in ASCII_SPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _blocks(text: Column, block: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))


def _key(block: Column, seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * seed + k), block) for k in (0, 1)]


def sorted_names(keys: DataFrame, sort: list[str], ranges: int = RANGES) -> DataFrame:
    """``keys`` (no row twice) with ``name``: its place from 1 on in the order of ``sort``, whose first column is a 64-bit hash.
    Ranges of the hash are sorted each in a task, then counted."""
    by_range = keys.withColumn("_r", F.shiftright(F.col(sort[0]), 64 - (ranges - 1).bit_length()))
    sizes = by_range.groupBy("_r").agg(F.count(F.lit(1)).alias("_n"))
    # a row per range: at most ``ranges``
    before = sizes.select("_r", F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_at"))
    place = F.row_number().over(Window.partitionBy("_r").orderBy(*sort))
    return by_range.withColumn("_i", place).join(F.broadcast(before), "_r").withColumn("name", F.col("_at") + F.col("_i")).drop("_r", "_i", "_at")


def _keyed_documents(docs: DataFrame, block: int) -> tuple[DataFrame, int]:
    """Documents with the keys of their blocks, under the first seed with which a key stands for one text."""
    text = normalised(text_of())
    # two copies of a block's text leave a task for each key, next to each other, so they pack as one
    texts = docs.select(F.explode(_blocks(text, block)).alias("_b"))
    seed = 0
    while True:
        one = texts.groupBy(*[c.alias(n) for c, n in zip(_key(F.col("_b"), seed), ("_h1", "_h2"), strict=True)])
        if one.agg(F.min("_b").alias("_lo"), F.max("_b").alias("_hi")).where("_lo <> _hi").isEmpty():
            break
        seed += 1
    keys = F.transform(F.col("_blocks"), lambda b: F.struct(*[c.alias(n) for c, n in zip(_key(b, seed), ("_h1", "_h2"), strict=True)]))
    rows = docs.select("doc_id", *row_key(), F.length(text_of()).alias("_points"), text.alias("_norm")).select(
        "*", F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256"), _blocks(F.col("_norm"), block).alias("_blocks")
    )
    named = rows.select("doc_id", *KEY, "_points", "text_sha256", keys.alias("_keys"), F.monotonically_increasing_id().alias("_rid"))
    return staged(named.withColumn("_size", F.size("_keys")), "block-keys"), seed


def identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per row of ``docs``: doc_id, its key, _rid, _points, text_sha256, and (_size, _name), equal exactly for equal texts.

    A text without blocks has size 0 and name 0. Each level writes a table and halves the names of a
    document; levels grow with the logarithm of the longest text.
    """
    rows, _ = _keyed_documents(docs, block)
    places = rows.select("_rid", "_size", F.posexplode("_keys").alias("_pos", "_k")).select("_rid", "_size", "_pos", "_k._h1", "_k._h2")
    names = sorted_names(places.select("_h1", "_h2").distinct(), ["_h1", "_h2"])
    # Spark sizes rows by the files they come from, exploded ones too; unlike broadcasts, merges do not depend on that
    level = staged(
        places.join(names.hint("merge"), ["_h1", "_h2"]).select("_rid", "_size", F.col("_pos").cast("long").alias("_pos"), F.col("_size").alias("_left"), "name"),
        "block-names",
    )
    most = rows.agg(F.max("_size")).first()[0] or 0
    done = [level.where("_left = 1").select("_rid", "name")]
    while most > 1:
        odd = F.col("_pos") % 2 == 1
        pairs = (
            level.where("_left > 1").groupBy("_rid", F.floor(F.col("_pos") / 2).alias("_pos"))
            .agg(F.first("_size").alias("_size"), F.first("_left").alias("_left"), F.max(F.when(~odd, F.col("name"))).alias("_a"),
                 F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(0)).alias("_b"))
            .withColumn("_h", F.xxhash64("_a", "_b"))
        )
        names = sorted_names(pairs.select("_h", "_a", "_b").distinct(), ["_h", "_a", "_b"])
        left = F.floor((F.col("_left") + 1) / 2)
        level = staged(pairs.join(names, ["_h", "_a", "_b"]).select("_rid", "_size", "_pos", left.cast("int").alias("_left"), "name"), "pair-names")
        done.append(level.where("_left = 1").select("_rid", "name"))
        most = (most + 1) // 2
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    return rows.drop("_keys").join(found.hint("merge"), "_rid", "left").withColumn("_name", F.coalesce("name", F.lit(0))).drop("name")


def exact_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row, null texts counting as empty.

    Of equal texts the row with the most code points in its text as given stays, then the smallest doc_id
    (null last); of rows that agree in both, one.
    """
    return _decided(docs, block).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _decided(docs: DataFrame, block: int) -> DataFrame:
    rows = staged(identities(docs, block), "identities")
    order = F.struct((-F.col("_points")).alias("p"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("_rid").alias("r"))
    best = rows.groupBy("_size", "_name").agg(F.min(order).alias("_best"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(best, ["_size", "_name"]).select(
        "doc_id", *KEY, "text_sha256", F.col("_best.d").alias("keep_id"), "group_size", (F.col("_best.r") == F.col("_rid")).alias("kept")
    )


def drop_exact_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row of each group of equal texts, with the columns of ``docs``."""
    return keep_rows(docs, _decided(docs, block).where("kept"), once=True)
