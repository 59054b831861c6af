"""Token files: canonical, length-limited Huffman codes of token ids, in blocks that decode alone.

A file set is a folder of Parquet files under which each row is a block: whole documents, one behind the other
(``doc_ids``, ``lengths``), their ids as one bit string (``payload``), and the bit offset of every
``STEP``-th id (``checkpoints``), from which decoding may start. ``part`` and ``block`` order the blocks. The codebook beside
it has the code length of each id; canonical codes follow from the lengths alone.

Parquet carries the blocks because Spark's writers then commit them once, whichever executors are lost,
in any store that Spark writes to.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patcheval.functions.stage import new_path, staged
from patcheval.llm.common import text_of, tokenizer_file
from patcheval.llm.word_cache import word_encoder

#: Ids between two checkpoints, and ids after which a block ends with the document at hand.
STEP, BLOCK_IDS = 128, 1 << 18
MAX_BITS = 16


# ---- codes


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Best code lengths of at most ``max_bits`` bits for the symbols with a count (package-merge); 0 for
    the others. More symbols than fit are given the bits they need."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    max_bits = max(max_bits, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    merged, leaf, levels = weights, np.ones(len(weights), bool), []
    levels.append(leaf)
    for _ in range(max_bits - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, pairs])
        by = np.argsort(both, kind="stable")
        merged, leaf = both[by], by < len(weights)
        levels.append(leaf)
    need, depth = 2 * len(weights) - 2, np.zeros(len(weights), np.int64)
    for leaf in reversed(levels):
        leaves = int(leaf[:need].sum())
        depth[:leaves] += 1
        need = 2 * (need - leaves)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order (length, symbol): each is the one before plus one, shifted to its length."""
    codes = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    if len(order):
        bits = int(lengths[order[-1]])
        steps = np.left_shift(np.int64(1), bits - lengths[order])
        codes[order] = (np.cumsum(steps) - steps) >> (bits - lengths[order])
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, step: int = STEP) -> tuple[bytes, np.ndarray]:
    """The bit string of ``ids``, and the bit offset of every ``step``-th of them."""
    n = lengths[ids]
    ends = np.cumsum(n)
    starts = ends - n
    total = int(ends[-1]) if len(ends) else 0
    marks, code = starts[::step], codes[ids]
    if len(ids) % 2:
        code, n = np.append(code, 0), np.append(n, 0)
    # two codes of at most 20 bits each lie in six bytes; codes share no bit, so sums put them together
    both, starts = n[::2] + n[1::2], starts[::2]
    word = ((code[::2] << n[1::2]) | code[1::2]) << (48 - both - (starts & 7))
    size, at = (total + 7) // 8, starts >> 3
    out = np.zeros(size + 6)
    for k in range((int(both.max(initial=0)) + 14) // 8):
        out += np.bincount(at + k, weights=(word >> (40 - 8 * k)) & 255, minlength=size + 6)
    return out[:size].astype(np.uint8).tobytes(), marks


class Decoder:
    """Reads one code a step at all checkpoints of a block at once, from a table by the next bits."""

    def __init__(self, lengths: np.ndarray):
        codes, used = canonical_codes(lengths), np.flatnonzero(lengths)
        self.bits = int(lengths.max(initial=1))
        order = used[np.argsort(codes[used] << (self.bits - lengths[used]), kind="stable")]
        span = np.left_shift(1, self.bits - lengths[order])
        self.symbol = np.zeros(1 << self.bits, np.int64)
        self.length = np.ones(1 << self.bits, np.int64)
        self.symbol[: span.sum()] = np.repeat(order, span)
        self.length[: span.sum()] = np.repeat(lengths[order], span)

    def block(self, payload: bytes, checkpoints: np.ndarray, n: int, step: int = STEP) -> np.ndarray:
        raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.int64)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        at, last = checkpoints.astype(np.int64), len(raw) - 4
        out = np.empty((len(at), step), np.uint32)
        shift, mask = 32 - self.bits, (1 << self.bits) - 1
        for k in range(step):
            here = (window[np.minimum(at >> 3, last)] >> (shift - (at & 7))) & mask
            out[:, k] = self.symbol[here]
            at = at + self.length[here]
        return out.reshape(-1)[:n]


# ---- Spark jobs


def _parts(docs: DataFrame, parts: int) -> list[float]:
    """Bounds of ``parts`` ranges of doc_id with about as many rows."""
    if parts < 2:
        return []
    return sorted(set(docs.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts)))


def _encode(path: str, bounds: list[float], end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        end = pa.scalar(b"" if end_id is None else np.array([end_id], encoder.dtype).tobytes(), pa.large_binary())
        wide = encoder.dtype.itemsize
        for batch in batches:
            keys = batch.column("doc_id")
            part = np.searchsorted(bounds, np.asarray(keys.fill_null(0)), "left") if bounds else np.zeros(len(keys), int)
            part = pa.array(np.where(np.asarray(keys.is_null()), 0, part), pa.int32())
            at = 0
            for some in encoder.arrays(batch.column("text")):
                ids = pc.binary_join_element_wise(some, end, pa.scalar(b"", pa.large_binary()))
                n = pa.array(pc.binary_length(ids).to_numpy() // wide, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(at, len(ids)), part.slice(at, len(ids)), n, ids.cast(pa.binary())], ["doc_id", "part", "n", "ids"]
                )
                at += len(ids)

    return run


def _gather(block_ids: int):
    """Neighbouring documents of a sorted partition to blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ns, ids, total, block, part = [], [], [], 0, 0, None

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([keys], pa.list_(pa.int64())),
                 pa.array([ns], pa.list_(pa.int64())), pa.array([b"".join(ids)], pa.binary())],
                ["part", "block", "doc_ids", "lengths", "ids"],
            )

        for batch in batches:
            for key, p, n, x in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "n", "ids")), strict=True):
                if keys and (total >= block_ids or p != part):
                    yield row()
                    block = block + 1 if p == part else 0
                    keys, ns, ids, total = [], [], [], 0
                part = p
                keys.append(key)
                ns.append(n)
                ids.append(x)
                total += n
        if keys:
            yield row()

    return run


def _count(wide: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column("ids"):
                counts += np.bincount(np.frombuffer(x.as_buffer(), wide), minlength=size)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], ["id", "n"])

    return run


def _pack(wide: str, lengths: np.ndarray, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical_codes(lengths)
        for batch in batches:
            for i in range(len(batch)):
                one = batch.slice(i, 1)
                bits, marks = pack(np.frombuffer(one.column("ids")[0].as_buffer(), wide).astype(np.int64), codes, lengths, step)
                yield pa.RecordBatch.from_arrays(
                    [*(one.column(c) for c in ("part", "block", "doc_ids", "lengths")), pa.array([marks], pa.list_(pa.int64())), pa.array([bits], pa.binary())],
                    ["part", "block", "doc_ids", "lengths", "checkpoints", "payload"],
                )

    return run


def _read(lengths: np.ndarray, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for batch in batches:
            for i in range(len(batch)):
                one = batch.slice(i, 1).to_pydict()
                ns = np.array(one["lengths"][0], np.int64)
                ends = np.cumsum(ns)
                ids = decoder.block(one["payload"][0], np.array(one["checkpoints"][0], np.int64), int(ends[-1]), step).astype("<u4")
                k = len(ns)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one["part"] * k, pa.int32()), pa.array(one["block"] * k, pa.int64()), pa.array(one["doc_ids"][0], pa.int64()),
                     pa.array(ends - ns, pa.int64()), pa.array(ns, pa.int64()),
                     pa.array([zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), ns.tolist(), strict=True)], pa.int64())],
                    ["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    return run


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 0, parts: int | None = None,
    block_ids: int = BLOCK_IDS, step: int = STEP,
) -> None:
    """Encodes ``text`` (null: empty) of every row and writes the files to ``path``, ordered by ``doc_id``
    (null first; rows with the same id by their ids).

    An empty table gives files without blocks; an empty text a document of the end id alone, or of no ids.
    Texts are encoded once: ids are dealt to ranges of doc_id, sorted there, and written in uncoded blocks; a second
    pass counts, a third codes. What meets on the driver are range bounds and one count per vocabulary entry. A
    block is as large as its documents' ids, so a task holds one block, or one document if that is longer.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _parts(docs, parts)
    encoder = word_encoder(tokenizer)
    wide, size = encoder.dtype.str, max(encoder.size, (end_id or 0) + 1)
    ids = docs.mapInArrow(_encode(tokenizer, bounds, end_id), "doc_id long, part int, n long, ids binary")
    ordered = ids.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")
    plain = staged(
        ordered.mapInArrow(_gather(block_ids), "part int, block long, doc_ids array<long>, lengths array<long>, ids binary"), "token-ids"
    )
    counted = plain.select("ids").mapInArrow(_count(wide, size), "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(size, np.int64)
    for r in counted.collect():  # at most the vocabulary
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    book = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(book, "id int, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    plain.mapInArrow(
        _pack(wide, lengths, step),
        "part int, block long, doc_ids array<long>, lengths array<long>, checkpoints array<long>, payload binary",
    ).withColumn("step", F.lit(step)).write.parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str, step: int = STEP) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    book = spark.read.parquet(f"{path}/codebook").collect()  # at most the vocabulary
    lengths = np.zeros(max((r["id"] for r in book), default=0) + 1, np.int64)
    for r in book:
        lengths[r["id"]] = r["bits"]
    blocks = spark.read.schema(
        "part int, block long, doc_ids array<long>, lengths array<long>, checkpoints array<long>, payload binary"
    ).parquet(f"{path}/blocks")
    sizes = blocks.select("part", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n).alias("n"))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range of doc_id
    totals = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("_before"))
    offsets = (
        sizes.withColumn("_at", F.coalesce(F.sum("n").over(within), F.lit(0)))
        .join(before, "part")
        .select("part", "block", (F.col("_before") + F.col("_at")).alias("_offset"))
    )
    docs = blocks.mapInArrow(
        _read(lengths, step), "part int, block long, doc_id long, inside long, n_tokens long, ids_crc32 long"
    )
    return docs.join(offsets, ["part", "block"]).select(
        "doc_id", (F.col("_offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_file_report(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Writes the token files of ``docs`` in the shared folder and reads them back."""
    path = new_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer or tokenizer_file("byte_bpe_50k.json"), end_id)
    return read_token_files(docs.sparkSession, path)
