"""What the corpus operators share: inputs, row keys, tokenizer files, cutting of very long texts."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of text that Python code holds cut into words at one time.
PIECE = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, '' where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. ``lower`` does just that in a text of one byte a character."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Columns that name a row by its content, without nulls: rows that agree in them have the same
    id and text and get the same decisions, so a row needs no number of its own."""
    t = text_of(text)
    return [
        F.col(doc_id).isNull().alias("_k_null"), F.coalesce(F.col(doc_id), F.lit(0)).alias("_k_id"),
        F.xxhash64(t).alias("_k_hash"), F.length(t).alias("_k_len"),
    ]


KEY = ["_k_null", "_k_id", "_k_hash", "_k_len"]


def keep_rows(docs: DataFrame, keys: DataFrame, how: str = "left_semi", once: bool = False) -> DataFrame:
    """The rows of ``docs`` whose key is (``left_anti``: is not) in ``keys``, with the columns of ``docs``.
    ``once``: of rows with the same key only one, the first by all other columns (by their JSON where there are maps)."""
    from pyspark.sql import Window

    names = docs.columns
    sortable = not re.search(r"\b(map<|variant\b)", docs.schema.simpleString())
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), *row_key())
    kept = keyed.join(keys.select(*KEY).distinct(), KEY, how)
    if once:
        w = Window.partitionBy(*KEY).orderBy("_row" if sortable else F.to_json("_row"))
        kept = kept.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return kept.select("_row.*")


def pieces(text: str, cut: re.Pattern, size: int = PIECE) -> Iterator[str]:
    """The text in parts of about ``size`` characters, each but the first starting where ``cut`` matches."""
    start = 0
    while len(text) - start > size:
        found = cut.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def groups(texts: list[str], size: int = PIECE) -> Iterator[list[str]]:
    """Lists of neighbouring texts of about ``size`` characters; a longer text stands alone."""
    out, n = [], 0
    for t in texts:
        if out and n + len(t) > size:
            yield out
            out, n = [], 0
        out.append(t)
        n += len(t)
    if out:
        yield out


def each_freed(batches: Iterator, work: Callable) -> Iterator:
    """What ``work`` makes of each batch of a task. No batch is held while the next one is read, and memory that Arrow keeps
    of earlier ones goes back: workers stay for the stages that follow."""
    for batch in batches:
        out = work(batch)
        del batch
        pa.default_memory_pool().release_unused()
        yield out
        del out


_kept: dict = {}


def kept_by_worker(make: Callable, *args):
    """``make(*args)``, made once for all tasks of a worker that ask for it. A worker keeps one such object: before it makes
    another, or where a task needs none (:func:`nothing_kept`), the one before goes with all that it remembers."""
    if (make, args) not in _kept:
        nothing_kept()
        _kept[make, args] = make(*args)
    return _kept[make, args]


def nothing_kept() -> None:
    if _kept:
        _kept.clear()
        gc.collect()  # they refer to themselves


#: Characters of a word that workers remember at most. A text without blanks is one word.
LONGEST = 64


class Recent:
    """Values of words, computed once while a word is in use: two tables of up to ``entries`` words of up to ``LONGEST``
    characters, of which the older is dropped when the younger is full. ``learn`` gives the values of a list of new words."""

    def __init__(self, learn, entries: int):
        self.learn, self.entries = learn, entries
        self.young: dict = {}
        self.old: dict = {}

    def forget(self) -> None:
        self.young, self.old = {}, {}

    def remember(self, values: dict) -> None:
        self.young.update((w, v) for w, v in values.items() if len(w) <= LONGEST)

    def values(self, words: list[str]) -> list:
        found = list(map(self.young.get, words))
        if None in found:
            new = list({w for w, v in zip(words, found, strict=True) if v is None})
            known = dict(zip(new, map(self.old.get, new), strict=True))
            todo = [w for w, v in known.items() if v is None]
            known.update(zip(todo, self.learn(todo), strict=True))
            self.remember(known)
            found = [known[w] if v is None else v for w, v in zip(words, found, strict=True)]
            if len(self.young) > self.entries:
                self.old, self.young = self.young, {}
        return found


def shared_out(lists: list[list], values: list):
    """The slices of ``values`` that belong to each of ``lists``."""
    at = 0
    for x in lists:
        yield values[at : at + len(x)]
        at += len(x)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not learned: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def logistic(m: np.ndarray, t: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over the margins, with a small pull of the slope to 0 and never below it."""
    centre, spread = m.mean(), m.std() + 1e-9
    x, a, c = (m - centre) / spread, 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + c, -30, 30)))
        g = np.array([(weight * (p - t) * x).sum() + 0.5 * a, (weight * (p - t)).sum()])
        v = weight * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 0.5, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        d = np.clip(np.linalg.solve(h, g), -1, 1)
        a, c = max(a - d[0], 1e-3), c - d[1]
    return float(a / spread), float(c - a * centre / spread)
