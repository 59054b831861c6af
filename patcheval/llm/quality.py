"""Quality by compression: how much shorter a text gets with a dictionary of good texts than with one of bad texts.

Two zstandard dictionaries of one size are built from windows of a bounded sample of labelled rows. A text is
compressed with both in independent blocks, so that what it repeats itself counts little; the difference of
the sizes, divided by the bytes of the text, is turned into a probability by a logistic curve fitted on labelled rows that
no dictionary has seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patcheval.llm.common import held_out, logistic, text_of

THRESHOLD = 0.7


@dataclass(frozen=True)
class Settings:
    """``sample``: labelled rows of each class that a dictionary is built from, at most, and as many again for the curve.
    ``windows`` of ``window`` characters, spread evenly over the whole text, are taken of each. ``rows_per_id``: rows of one id."""

    sample: int = 2000
    windows: int = 8
    window: int = 512
    dictionary: int = 1 << 18
    block: int = 2048
    level: int = 3
    seed: int = 11
    rows_per_id: int = 2


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    settings: Settings

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.offset, -30, 30)))


def build_dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; of samples too few or too alike to train on, the samples themselves, the last ``size`` bytes."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(samples)[-size:]


class Comparer:
    """``difference`` of texts: (bytes with the bad dictionary - bytes with the good one) / bytes of the text."""

    def __init__(self, good: bytes, bad: bytes, s: Settings):
        import zstandard

        def compressor(raw: bytes):
            # whether the bytes are a trained dictionary or plain content follows from their first four bytes
            known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)
            known.precompute_compress(level=s.level)
            plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
            return zstandard.ZstdCompressor(dict_data=known, level=s.level, **plain).compress

        self.good, self.bad, self.block = compressor(good or b"\n"), compressor(bad or b"\n"), s.block

    def difference(self, text: bytes) -> float:
        apart = 0
        for i in range(0, len(text), self.block):
            part = text[i : i + self.block]
            apart += len(self.bad(part)) - len(self.good(part))
        return apart / (len(text) + 1)


# ---- Spark jobs


def _windows(text: Column, s: Settings) -> Column:
    """Up to ``s.windows`` windows of a text, the first at its start, the last at its end."""
    n = F.length(text)
    k = F.least(F.lit(s.windows), F.greatest(F.lit(1), F.ceil(n / s.window))).cast("int")
    step = F.greatest(F.lit(0), n - s.window) / F.greatest(F.lit(1), k - 1)
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.substring(text, F.floor(i * step).cast("int") + 1, F.lit(s.window)))


def _differences(good: bytes, bad: bytes, s: Settings, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comparer = Comparer(good, bad, s)
        for batch in batches:
            x = np.array([comparer.difference(t.as_buffer().to_pybytes()) for t in batch.column("_t")], np.float64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(x, pa.float64())], [*names, "x"])

    return run


def _chosen(docs: DataFrame, labels: DataFrame, s: Settings) -> tuple[DataFrame, dict[int, int]]:
    """(_l, _y, fit) of the sampled ids, and how many labelled ids of each class there are."""
    known = labels.select(F.col("doc_id").alias("_l"), F.col("quality").cast("int").alias("_y")).where("_y in (0, 1)")
    ids = docs.select(F.col("doc_id").alias("_d")).where(F.col("_d").isNotNull() & ~held_out(F.col("_d"))).distinct()
    known = known.groupBy("_l").agg(F.min("_y").alias("_y")).join(ids, F.col("_l") == F.col("_d"), "left_semi")
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    order = F.xxhash64(F.lit(s.seed), "_l")
    some = [known.where(F.col("_y") == y).orderBy(order, "_l").limit(2 * s.sample) for y in (0, 1)]
    side = F.pmod(F.xxhash64(F.lit(s.seed + 1), "_l"), F.lit(2)) == 0
    return some[0].union(some[1]).select("_l", "_y", side.alias("fit")), counts


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Learns from at most ``2 * s.sample`` ids of each label, chosen by a hash of the id from all labelled ids that are not held
    out: about half build the dictionaries, the others fit the curve, weighted to the share of each class. Of repeated
    labels the lower counts, of rows with one id the first ``s.rows_per_id`` by text. Rows without a label of 0 or 1 are not
    learned from. The driver gets windows of bounded size and one number per row. Without rows of both classes on both
    sides every text scores the share of label 1, or 0.5 without any label."""
    from pyspark.sql import Window

    sample, counts = _chosen(docs, labels, s)
    share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    flat = Model(b"", b"", 0.0, float(np.log(share / (1 - share))), s)
    first = Window.partitionBy("_l").orderBy("_t")
    rows = (
        docs.select(F.col("doc_id"), text_of().alias("_t")).join(F.broadcast(sample), F.col("doc_id") == F.col("_l"))  # at most 4 * sample rows
        .withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= s.rows_per_id)
    )
    windows = rows.where("fit").select("_l", "_n", "_y", F.posexplode(_windows(F.col("_t"), s)).alias("_i", "w")).where("w <> ''")
    parts: dict[int, list[bytes]] = {0: [], 1: []}
    for r in windows.orderBy(F.xxhash64("_l"), "_l", "_n", "_i").collect():  # of at most 2 * sample * rows_per_id texts, and bounded bytes of each
        parts[r["_y"]].append(r["w"].encode())
    if not parts[0] or not parts[1]:
        return flat
    good, bad = (build_dictionary(parts[y], s.dictionary) for y in (1, 0))
    found = rows.where("not fit").select("_y", "_t").mapInArrow(_differences(good, bad, s, ["_y"]), "_y int, x double").collect()
    y = np.array([r["_y"] for r in found], np.int64)
    if not len(y) or y.min() == y.max():
        return flat
    x = np.array([r["x"] for r in found])
    weight = np.array([counts[k] / max(1, (y == k).sum()) for k in (0, 1)])[y]
    by = np.lexsort((x, y))  # sums in one order, whatever order rows came in
    return Model(good, bad, *logistic(x[by], y[by], (weight / weight.sum() * len(y))[by]), s)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row and its whole text; null and empty texts score as texts without a difference.
    Rows repeat as they come; an empty table gives no rows; other columns are not read."""
    keyed = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text_of().alias("_t"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema if f.name != "_t")
    run = _differences(model.good, model.bad, model.settings, ["doc_id", "held_out"])
    slope, offset = model.slope, model.offset
    margin = F.least(F.lit(30.0), F.greatest(F.lit(-30.0), F.col("x") * slope + offset))
    scored = keyed.mapInArrow(run, f"{kinds}, x double").select("doc_id", "held_out", (1 / (1 + F.exp(-margin))).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
