"""Near duplicates by SimHash: fingerprints at 3 or fewer differing bits, found by one-wildcard segments.

Of two halves of a fingerprint one differs by at most one bit if all differ by at most three. Each half is therefore indexed as
it is and once for each of its bits with that bit left out; rows meet by equality on such a key and are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patcheval.functions.stage import staged
from patcheval.llm.common import KEY, each_freed, keep_rows, nothing_kept, row_key, text_of

MAX_BITS = 3
#: Fingerprints that share a half and are compared in one group; larger ones are cut by the other half, too.
GROUP = 256


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """64 bits, each set if it is set in over half of the hashes of the shingles; 0 without words."""
    import xxhash

    w = text.encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not w:
        return 0
    line = b" ".join(w)
    n = np.fromiter(map(len, w), np.int64, len(w)) + 1
    starts = np.cumsum(n) - n
    k = min(words, len(w))
    begin, end = starts[: len(w) - k + 1].tolist(), (starts + n - 1)[k - 1 :].tolist()
    hash_of, ones, count = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(begin)
    for at in range(0, count, 65536):
        h = np.array([hash_of(line[i:j], seed) for i, j in zip(begin[at : at + 65536], end[at : at + 65536], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > count).astype(np.uint8), bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column) -> Column:
    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        nothing_kept()
        yield from each_freed(batches, lambda batch: batch.map(fingerprint).astype("int64"))

    return simhash(text)


def _half(fp: Column, side: int) -> Column:
    return F.shiftrightunsigned(fp, 32) if side else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _variants(segment: Column, width: int, tag: Column) -> Column:
    """(key, bit) of a segment as it is (bit 2), and for each of its bits with that bit left out. A key holds the tag (from bit 40
    on), the place of the bit left out, and the rest of the segment."""

    def one(p):
        mask = F.when(p == width, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), p))
        key = F.shiftleft(tag.cast("long"), 40).bitwiseOR(F.shiftleft(p.cast("long"), width))
        bit = F.when(p == width, 2).when(segment.bitwiseAND(mask) != 0, 1).otherwise(0)
        return F.struct(key.bitwiseOR(segment.bitwiseAND(F.bitwise_not(mask))).alias("key"), bit.alias("bit"))

    return F.transform(F.sequence(F.lit(0), F.lit(width)), one)


def _near(bits: int) -> Column:
    return F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= bits


def _meet(left: DataFrame, right: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """Pairs of rows with equal keys: on different sides of a left-out bit, or any where none is left out."""
    other = right.select(*keys, F.col("fp").alias("fp2"), F.col("bit").alias("bit2"))
    apart = (F.col("bit") + F.col("bit2") == 1) | ((F.col("bit") == 2) & (F.col("fp") != F.col("fp2")))
    # Spark takes exploded rows for as small as what they come from, so without the hint it would broadcast 66 rows for each fingerprint
    return left.join(other.hint("merge"), keys).where(apart & _near(bits)).select("fp", "fp2")


def links(fps: DataFrame, bits: int = MAX_BITS, group: int = GROUP) -> DataFrame:
    """(fp, fp2), fp < fp2: all pairs of the different fingerprints in ``fps`` with at most ``bits`` <= 3 differing bits.

    A half that over ``group`` fingerprints share makes these hot. Others meet hot ones by one half; hot ones meet
    each other by the other half's segments as well, so that no group grows with the data: 46 of 64 bits agree there.
    """
    halves = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), _half(F.col("fp"), s).alias("half")) for s in (0, 1)])).alias("h"))
    halves = halves.select("fp", "h.side", "h.half")
    hot = halves.groupBy("side", "half").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > group).select("side", "half", F.lit(True).alias("hot"))
    rows = staged(halves.join(hot, ["side", "half"], "left").withColumn("hot", F.coalesce("hot", F.lit(False))), "halves")

    first = rows.select("fp", "hot", "side", F.explode(_variants(F.col("half"), 32, F.col("side"))).alias("v")).select("fp", "hot", "side", "v.key", "v.bit")
    cold = _meet(first, first.where("not hot"), ["key"], bits)
    inner = first.where("hot").withColumn("rest", F.when(F.col("side") == 0, _half(F.col("fp"), 1)).otherwise(_half(F.col("fp"), 0)))
    cut = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.shiftright("rest", 16 * s).bitwiseAND(F.lit(0xFFFF)).alias("x")) for s in (0, 1)])).alias("c")
    inner = inner.select("fp", "key", "bit", cut).select("fp", "key", "bit", F.col("c.s").alias("s"), F.explode(_variants(F.col("c.x"), 16, F.col("c.s"))).alias("w"))
    inner = inner.select("fp", "key", "bit", F.col("w.key").alias("key2"), F.col("w.bit").alias("inner"))
    other = inner.select("key", "key2", F.col("fp").alias("fp2"), F.col("bit").alias("bit2"), F.col("inner").alias("inner2"))
    apart = (F.col("bit") + F.col("bit2") == 1) | ((F.col("bit") == 2) & (F.col("fp") != F.col("fp2")))
    within = (F.col("inner") + F.col("inner2") == 1) | (F.col("inner") == 2)
    hots = inner.join(other.hint("merge"), ["key", "key2"]).where(apart & within & _near(bits)).select("fp", "fp2")
    both = cold.unionByName(hots)
    return both.select(F.least("fp", "fp2").alias("fp"), F.greatest("fp", "fp2").alias("fp2")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(fp, root): the smallest fingerprint that each linked one reaches. Each round hooks what a node points to
    below its neighbours' roots and halves the paths; rounds grow with the logarithm of the longest path. Tables are
    written between rounds; only counts come to the driver."""
    edges = staged(pairs.unionByName(pairs.select(F.col("fp2").alias("fp"), F.col("fp").alias("fp2"))), "links")
    state = staged(edges.groupBy("fp").agg(F.min("fp2").alias("m")).select("fp", F.least("fp", "m").alias("root")), "roots")
    while True:
        # what the neighbours point to, per node; hooked below the node and below what it points to
        low = edges.join(state.select(F.col("fp").alias("fp2"), F.col("root").alias("r2")), "fp2").groupBy("fp").agg(F.min("r2").alias("low"))
        near = state.join(low, "fp").select("fp", "root", F.least("root", "low").alias("low"))
        hooks = near.select("fp", F.col("low").alias("r")).unionByName(near.select(F.col("root").alias("fp"), F.col("low").alias("r")))
        hooked = hooks.groupBy("fp").agg(F.min("r").alias("root"))
        mid = staged(hooked, "hooked")
        jump = mid.join(mid.select(F.col("fp").alias("root"), F.col("root").alias("next")), "root").select("fp", F.least("root", "next").alias("root"))
        new = staged(jump, "roots")
        changed = not new.join(state.withColumnRenamed("root", "old"), "fp").where("root <> old").isEmpty()
        state = new
        if not changed:
            return state


def near_duplicates(docs: DataFrame, bits: int = MAX_BITS, group: int = GROUP) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row. Null texts count as empty; texts without words share the fingerprint
    zero. component_id is the smallest doc_id that is reachable over links, null only if all there are null."""
    return _grouped(docs, bits, group).select("doc_id", "fingerprint", "component_id")


def _grouped(docs: DataFrame, bits: int, group: int) -> DataFrame:
    rows = staged(docs.select("doc_id", *row_key(), fingerprint_column(text_of()).alias("fp")), "fingerprints")
    roots = components(links(rows.select("fp").distinct(), bits, group))
    each = rows.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = each.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(*KEY)).alias("_best"))
    return each.join(best, "root").withColumn("fingerprint", F.lower(F.lpad(F.hex("fp"), 16, "0")))


def drop_near_duplicates(docs: DataFrame, bits: int = MAX_BITS, group: int = GROUP) -> DataFrame:
    """One row of each component, that of the smallest doc_id (null last), with the columns of ``docs``."""
    best = _grouped(docs, bits, group).where(F.struct(*KEY) == F.col("_best"))
    return keep_rows(docs, best, once=True)
