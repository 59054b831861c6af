"""Vectors as short codes: a codebook for each of eight parts, fitted to all vectors by exact integer rounds.

All codebooks of all rounds are kept. A vector's part keeps the entry it has, an upper bound of the distance to it and a lower
bound of the distance to every other one, each with the round it was measured in. In a later round the entries have moved
by the norm of their summed steps, which is at most, and mostly far less than, the sum of the steps' norms: that
true displacement since the bound's own round is added or taken off. Only where the bounds then meet are distances measured.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patcheval.functions.stage import remove, staged, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows of labels that are broadcast at most.
BROADCAST_LABELS = 500_000


# ---- one batch


@dataclass
class State:
    """Per vector and part: entry, bounds, and the rounds that these were measured in."""

    entry: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    upper_round: np.ndarray
    lower_round: np.ndarray

    KINDS = (("entry", "u1"), ("upper", "<f4"), ("lower", "<f4"), ("upper_round", "u1"), ("lower_round", "u1"))

    def pack(self) -> np.ndarray:
        """The state of each vector as bytes."""
        n = len(self.entry)
        return np.concatenate([np.ascontiguousarray(getattr(self, k), dtype).view(np.uint8).reshape(n, -1) for k, dtype in self.KINDS], axis=1)

    @classmethod
    def unpack(cls, rows: np.ndarray, parts: int) -> State:
        at, out = 0, {}
        for k, dtype in cls.KINDS:
            wide = np.dtype(dtype).itemsize * parts
            out[k] = rows[:, at : at + wide].copy().view(dtype)
            at += wide
        return cls(**out)


def _scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of the vectors ``x`` (the lower of equals), and the squared distances to it and to the next."""
    d = np.empty((len(x), len(book)), np.int64)
    for j, c in enumerate(book):
        d[:, j] = ((x - c) ** 2).sum(1)
    best = d.argmin(1)
    near = d[np.arange(len(x)), best]
    d[np.arange(len(x)), best] = np.iinfo(np.int64).max
    return best, near, d.min(1)


def _above(d: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(d.astype(np.float64)).astype(np.float32) * np.float32(1 + 1e-6), np.float32(np.inf))


def _below(d: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(d.astype(np.float64)).astype(np.float32) * np.float32(1 - 1e-6), np.float32(-np.inf))


def assign(x: np.ndarray, history: list[np.ndarray], state: State | None = None) -> tuple[State, int]:
    """The state after the round of the last codebook, and how many parts had to be scanned. ``x``: vectors x parts x
    components; a codebook: parts x entries x components."""
    n, parts, _ = x.shape
    now, book = len(history) - 1, history[-1]
    if state is None:
        kinds = dict(State.KINDS)
        state = State(**{k: np.zeros((n, parts), dtype) for k, dtype in kinds.items()})
        todo = np.ones((n, parts), bool)
    else:
        moved = np.sqrt(np.array([((book - h) ** 2).sum(2) for h in history], np.float64)) * (1 + 1e-9)  # rounds x parts x entries
        others = np.zeros_like(moved)
        for j in range(book.shape[1]):
            others[:, :, j] = np.delete(moved, j, axis=2).max(2, initial=0)
        part = np.arange(parts)[None, :]
        upper = state.upper + moved[state.upper_round, part, state.entry]
        lower = state.lower - others[state.lower_round, part, state.entry]
        todo = ~(upper < lower)
        i, p = np.nonzero(todo)  # first the entry itself is measured anew
        own = ((x[i, p] - book[p, state.entry[i, p]]) ** 2).sum(1)
        state.upper[i, p], state.upper_round[i, p] = _above(own), now
        todo[i, p] = ~(state.upper[i, p] < lower[i, p])
    for p in range(parts):
        i = np.flatnonzero(todo[:, p])
        if len(i):
            best, near, next_ = _scan(x[i, p], book[p])
            state.entry[i, p], state.upper[i, p], state.lower[i, p] = best, _above(near), _below(next_)
            state.upper_round[i, p] = state.lower_round[i, p] = now
    return state, int(todo.sum())


def totals(x: np.ndarray, entry: np.ndarray, entries: int) -> np.ndarray:
    """Per part and entry the sum of each component, then the count."""
    parts = x.shape[1]
    out = np.zeros((parts, entries, x.shape[2] + 1), np.int64)
    for p in range(parts):
        np.add.at(out[p, :, :-1], entry[:, p], x[:, p])
        out[p, :, -1] = np.bincount(entry[:, p], minlength=entries)
    return out


def moved_book(book: np.ndarray, sums: list[int]) -> np.ndarray:
    """Entries at the floor of the mean of their parts; unused ones where they were. Sums are of any size."""
    out, width = book.copy(), book.shape[2]
    for p in range(book.shape[0]):
        for j in range(book.shape[1]):
            at = (p * book.shape[1] + j) * (width + 1)
            count = sums[at + width]
            if count:
                out[p, j] = [s // count for s in sums[at : at + width]]
    return out


# ---- Spark jobs


def _integers(vectors: pa.Array, width: int, parts: int) -> np.ndarray:
    """vectors x parts x components: floor(4096 x); shorter vectors are filled with zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), parts * width), np.int64)
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(flat) and 4 * max(1, width) * (np.abs(flat).max() + 1) ** 2 >= 2**62:
        raise ValueError("a component is too large for distances of 64 bits")
    out[np.arange(parts * width)[None, :] < lengths[:, None]] = flat
    return out.reshape(len(vectors), parts, width)


def _cells(raw: bytes, n: int) -> pa.Array:
    """``raw`` cut into ``n`` cells of one size."""
    offsets = np.arange(n + 1, dtype=np.int64) * (len(raw) // max(n, 1))
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])


def _kept(batch: pa.RecordBatch, parts: int, width: int) -> tuple[np.ndarray, State]:
    """Integers and states of a written round."""
    v, state = (b"".join(batch.column(c).to_pylist()) for c in ("v", "state"))
    wide = parts * sum(np.dtype(k).itemsize for _, k in State.KINDS)
    return np.frombuffer(v, "<i4").reshape(len(batch), parts, width).astype(np.int64), State.unpack(np.frombuffer(state, np.uint8).reshape(-1, wide), parts)


_PAYLOAD = ["vec_id", "label"]
_ROUND = "vec_id long, label {label}, v binary, state binary, sums array<long>"


def _round(history: list[np.ndarray], first: bool):
    """A round over vectors: their integers and states, and behind a task's vectors a row with its sums."""
    parts, entries, width = history[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, kinds = np.zeros((parts, entries, width + 1), np.int64), None
        for batch in batches:
            kinds = [batch.column(c).type for c in _PAYLOAD]
            if first:
                x, state = _integers(batch.column("v"), width, parts), None
            else:
                x, state = _kept(batch, parts, width)
            state, _ = assign(x, history, state)
            sums += totals(x, state.entry, entries)
            cells = (_cells(b, len(x)) for b in (x.astype("<i4").tobytes(), state.pack().tobytes()))
            columns = [*[batch.column(c) for c in _PAYLOAD], *cells, pa.nulls(len(x), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [*_PAYLOAD, "v", "state", "sums"])
        if kinds:
            none = [pa.nulls(1, k) for k in (*kinds, pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array([sums.reshape(-1)], pa.list_(pa.int64()))], [*_PAYLOAD, "v", "state", "sums"])

    return run


def _codes(history: list[np.ndarray], first: bool):
    parts, _, width = history[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if first:
                x, state = _integers(batch.column("v"), width, parts), None
            else:
                x, state = _kept(batch, parts, width)
            state, _ = assign(x, history, state)
            error = ((x - history[-1][np.arange(parts)[None, :], state.entry]) ** 2).sum((1, 2))
            codes = [r.tobytes().hex() for r in state.entry]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in _PAYLOAD], pa.array(codes, pa.string()), pa.array(error, pa.int64())], [*_PAYLOAD, "code", "error"])

    return run


def kept_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows whose vector is there and has finite components only."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return embeddings.where(F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v"))


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[list[np.ndarray], DataFrame | None, str | None]:
    """The codebooks of all rounds, and the table (and its folder) with the states of the last round before the last codebook.

    The driver holds codebooks, and a number for each component of one; a round reads the table of the round before it and
    writes its own, after which the older one goes. Vectors are never shuffled.
    """
    spark = vectors.sparkSession
    longest = vectors.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return [], None, None
    width = -(-longest // parts)
    starts = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    first = _integers(pa.array([r["v"] for r in starts], pa.list_(pa.float64())), width, parts)
    history = [np.ascontiguousarray(first.transpose(1, 0, 2))]
    kind = _ROUND.format(label=vectors.schema["label"].dataType.simpleString())
    table, path = vectors, None
    for r in range(rounds):
        done, to = written(table.mapInArrow(_round(history, r == 0), kind), "codes")
        if path:
            remove(spark, path)
        numbers = done.where("sums IS NOT NULL").select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s"))
        sums = [0] * (history[0].shape[0] * history[0].shape[1] * (width + 1))
        for row in numbers.collect():  # a number for each component of a codebook
            sums[row["i"]] = row["s"]
        history.append(moved_book(history[-1], sums))
        table, path = done.where("sums IS NULL").drop("sums"), to
    return history, table, path


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for every row with a vector of finite components.

    Rows without such a vector are dropped; without any row left there are no rows. Codebooks start from the smallest vec_ids
    (null last, of equal ones the smaller vector first), so with fewer rows than entries they are shorter. Vectors of different
    lengths, or of one that the parts do not divide, are filled with zeros. Equal rows stay as many as they are; null
    labels are one label; other columns are not read. Components of over 2^27 / 4096 or so raise an error, as distances would not
    fit 64 bits.
    """
    spark = embeddings.sparkSession
    vectors = kept_vectors(embeddings)
    label = vectors.schema["label"].dataType.simpleString()
    history, table, path = fit(vectors, parts, entries, rounds)
    if not history:
        return vectors.select("vec_id", F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256"))
    coded = staged(table.mapInArrow(_codes(history, rounds == 0), f"vec_id long, label {label}, code string, error long"), "codes")
    if path:
        remove(spark, path)
    books = hashlib.sha256(",".join(map(str, history[-1].reshape(-1).tolist())).encode()).hexdigest()
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    same = F.col("a.label").eqNullSafe(F.col("b.label"))
    few = by_label.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    if few:
        out = coded.alias("a").join(F.broadcast(by_label).alias("b"), same)
    else:
        # a label may be that of a third of all rows: they are dealt to 64 copies of its sum
        salted = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(64)).cast("int"))
        copies = by_label.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
        out = salted.alias("a").join(copies.alias("b"), same & (F.col("a._salt") == F.col("b._salt")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books).alias("codebooks_sha256"))
