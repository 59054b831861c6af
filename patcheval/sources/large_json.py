"""Records of JSON documents of any size, a document read by as many tasks as it has splits.

A document is read as text that ends at ``}``, so Spark splits it like any text. Each split first tells how many quotes and
brackets it holds, once as if it started outside a string and once inside; sums over the splits of a document then tell
where each really starts. A second pass cuts the records out; what lies across splits is put together from its fragments.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patcheval.functions.stage import staged

_ESCAPE = re.compile(r"\\.", re.DOTALL)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?P<closed>")?|[\[\]{}:]', re.DOTALL)
_REST_OF_STRING = re.compile(r'(?:[^"\\]|\\.)*"', re.DOTALL)
_GAP = re.compile(r"[\s,]*")
_BRACKETS = re.compile(r"[\[\]{]")
#: Splits whose starts are handed to all tasks. The driver lists each of them anyway to plan a scan.
MOST_SPLITS = 5_000_000
OWN, FIRST, LAST, WHOLE = range(4)


def _outside(text: str, inside: bool) -> tuple[str, bool]:
    """What of a piece is outside strings, and whether its end is inside one."""
    if "\\" in text:
        text = _ESCAPE.sub("", text)
    parts = text.split('"')
    return "".join(parts[inside::2]), (len(parts) % 2 == 0) != inside


def elements(region: str) -> Iterator[str]:
    """The JSON texts of neighbouring elements of a list; an object stands only at the end."""
    at, read = _GAP.match(region).end(), json.JSONDecoder().raw_decode
    while at < len(region):
        if region[at] == "{":
            yield region[at:].rstrip()
            return
        end = read(region, at)[1]
        yield region[at:end]
        at = _GAP.match(region, end).end()


class Cutter:
    """Walks through one split. ``held``: whether its place lies inside the list of records, which is the document itself
    (``level`` 1) or the value of the key ``wanted`` of an object (``level`` 2)."""

    def __init__(self, inside: bool, depth: int, level: int, held: bool, wanted: str | None):
        self.inside, self.depth, self.level, self.held, self.wanted = inside, depth, level, held, wanted
        self.key, self.changed, self.entered = None, False, False
        self.buffer: list[str] = []

    def piece(self, text: str) -> Iterator[str]:
        """Takes the next piece, which a ``}`` ends, and gives the regions that end in it."""
        out, after = _outside(text, self.inside)
        if self.depth < self.level or not self._stays(out):
            yield from self._walk(text + "}", after)
            return
        self.depth += out.count("[") + out.count("{") - out.count("]") - (not after)
        self.inside = after
        if self.held:
            self.buffer += (text, "}")
            if not after and self.depth == self.level:
                yield self._region()
        if self.depth < self.level:
            self.held, self.changed = False, True

    def _stays(self, out: str) -> bool:
        """Whether the depth stays at the level of the list's elements or below them, up to the ``}`` that ends a piece."""
        if "]" not in out:
            return True
        depth = self.depth
        for b in _BRACKETS.findall(out):
            depth += -1 if b == "]" else 1
            if depth < self.level:
                return False
        return True

    def _region(self) -> str:
        region, self.buffer = "".join(self.buffer), []
        return region

    def _walk(self, text: str, after: bool) -> Iterator[str]:
        at = start = 0
        if self.inside:
            found = _REST_OF_STRING.match(text)
            at = found.end() if found else len(text)
        last = None
        for token in _TOKEN.finditer(text, at):
            t = token[0]
            if t[0] == '"':
                last = t if token["closed"] else None
            elif t == ":":
                if self.depth == 1 and self.level == 2:
                    self.key = last and json.loads(last)
            elif t in "[{":
                self.depth += 1
                if t == "[" and self.depth == self.level and not self.held and (self.level == 1 or self.key == self.wanted):
                    self.held = self.changed = self.entered = True
                    self.buffer, start = [], token.end()
            else:
                if self.depth == self.level:
                    if self.held:
                        self.buffer.append(text[start : token.start()])
                        yield self._region()
                    self.held, self.changed = False, True
                self.depth -= 1
                if self.held and self.depth == self.level and t == "}":
                    self.buffer.append(text[start : token.end()])
                    yield self._region()
                    start = token.end()
        if self.held:
            self.buffer.append(text[start:])
        self.inside = after


_VALUE_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?P<closed>")?|[\[\]{}:,]', re.DOTALL)


class FieldCutter:
    """Walks through one split and keeps the values of the key ``wanted`` of the outermost object, each behind its key and in front of a
    comma. ``held``: whether the split starts in such a value. ``ended``: whether the object ends in it, what follows is not looked at;
    ``last``: at the end of its last piece."""

    def __init__(self, inside: bool, depth: int, held: bool, wanted: str):
        self.inside, self.depth, self.held, self.wanted = inside, depth, held, wanted
        self.changed, self.entered, self.ended, self.last = False, False, False, False
        self.kept: list[str] = []

    def piece(self, text: str, keep: bool = True) -> None:
        """Takes the next piece, which a ``}`` ends."""
        if self.ended:
            self.last = False
            return
        out, after = _outside(text, self.inside)
        if self.depth > 1 and ("]" not in out or self._stays(out)):
            self.depth += out.count("[") + out.count("{") - out.count("]") - (not after)
            if self.held and keep:
                self.kept += (text, "}")
        else:
            self._walk(text + "}", keep)
        self.inside = after

    def _stays(self, out: str) -> bool:
        """Whether the depth stays below the outermost object, up to the ``}`` that ends a piece."""
        depth = self.depth
        for b in _BRACKETS.findall(out):
            depth += -1 if b == "]" else 1
            if depth < 2:
                return False
        return True

    def _named(self, key: str | None) -> bool:
        try:
            return key is not None and json.loads(key) == self.wanted
        except ValueError:
            return False

    def _walk(self, text: str, keep: bool) -> None:
        at = start = 0
        if self.inside:
            found = _REST_OF_STRING.match(text)
            at = found.end() if found else len(text)
        last = None
        for token in _VALUE_TOKEN.finditer(text, at):
            t = token[0]
            if t[0] == '"':
                last = t if token["closed"] else None
            elif t in "[{":
                self.depth += 1
            elif self.depth > 1:
                self.depth -= t in "]}"
            elif t == ":":
                if not self.held and self.depth == 1 and self._named(last):
                    self.held = self.changed = self.entered = True
                    self.kept.append(json.dumps(self.wanted) + ":")
                    start = token.end()
            elif self.depth == 1:
                if self.held and keep:
                    self.kept += (text[start : token.start()], ",")
                self.held, self.changed = False, True
                if t != ",":
                    self.depth, self.ended, self.last = 0, True, True
                    return
        if self.held and keep:
            self.kept.append(text[start:])


#: Characters of one split that Python holds at a time, besides a batch of rows and the record at hand.
HELD = 4_000_000


def _by_split(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]):
    """(file, block and the columns ``names``, pieces): parts of neighbouring rows of one split."""
    key = row = None
    pieces: list[str] = []
    size = 0
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("file", "block", *names, "value")), strict=True):
            if r[:2] != key or size > HELD:
                if key is not None:
                    yield row, pieces
                key, row, pieces, size = r[:2], r[:-1], [], 0
            pieces.append(r[-1])
            size += len(r[-1])
    if key is not None:
        yield row, pieces


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: bytes, the first character that is not blank, and for a start outside and inside a string: whether the end is
    inside one, and by how many brackets the depth grows."""
    rows: dict[tuple, list] = {}
    for row, pieces in _by_split(batches, ("size",)):
        known = rows.setdefault(row, [0, "", False, 0, True, 0])
        for p in pieces:
            known[0] += len(p.encode()) + 1
            known[1] = known[1] or (p + "}").lstrip()[:1]
            for k in (2, 4):
                out, known[k] = _outside(p, known[k])
                known[k + 1] += out.count("[") + out.count("{") - out.count("]") - (not known[k])
    flat = [(*k, *v) for k, v in rows.items()]
    names = ["file", "block", "size", "bytes", "start", "quoted0", "depth0", "quoted1", "depth1"]
    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in flat], schema=_schema(_MEASURED))


_MEASURED = "file string, block long, size long, bytes long, start string, quoted0 boolean, depth0 long, quoted1 boolean, depth1 long"


def _schema(text: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in text.split(", "))])


def _cutters(batches: Iterator[pa.RecordBatch], wanted: str | None):
    """(file, block, cutter, pieces) of each part of each split, with one cutter a split."""
    known: tuple | None = None
    cutter = None
    for row, pieces in _by_split(batches, ("inside", "depth", "level", "held")):
        if row[:2] != known:
            known, cutter = row[:2], Cutter(*row[2:], wanted)
        yield (*known, cutter, pieces)


def _outline(wanted: str | None):
    """(file, block, held, entered): whether a split ends in the list, if that changes in it, and whether the list begins in it."""

    def run(batches):
        found = {}
        for file, block, cutter, pieces in _cutters(batches, wanted):
            for p in pieces:
                for _ in cutter.piece(p):
                    pass
                cutter.buffer = []
            if cutter.changed:
                found[file, block] = cutter.held, cutter.entered
        rows = [{"file": f, "block": b, "held": h, "entered": e} for (f, b), (h, e) in found.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=_schema(_CHANGES))

    return run


_CHANGES = "file string, block long, held boolean, entered boolean"
_CUT = "file string, block long, kind int, seq long, raw string"


def _cut(wanted: str | None):
    """Records that lie inside a split, numbered, and the fragments at its ends. What comes before the first end of a record is the
    rest of one that began before (FIRST), what follows the last end the beginning of one (LAST); without an end all is
    in the middle of one (WHOLE)."""

    def run(batches):
        state: tuple | None = None  # file, block, cutter
        seq, ended, rows = 0, False, []

        def close():
            file, block, cutter = state
            left = "".join(cutter.buffer) if cutter.held else ""
            if cutter.held or left:
                rows.append((file, block, LAST if ended else WHOLE, 0, left))

        def batch_of():
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _schema(_CUT), strict=True)], schema=_schema(_CUT))
            rows.clear()
            return out

        for file, block, cutter, pieces in _cutters(batches, wanted):
            if state is None or state[2] is not cutter:
                if state is not None:
                    close()
                state, seq = (file, block, cutter), 0
                ended = not cutter.held  # outside the list nothing is continued
            for p in pieces:
                entered = cutter.held
                for region in cutter.piece(p):
                    if not ended and entered:
                        rows.append((file, block, FIRST, 0, region))
                    else:
                        for e in elements(region):
                            rows.append((file, block, OWN, seq, e))
                            seq += 1
                    ended = True
            if len(rows) > 2000:
                yield batch_of()
        if state is not None:
            close()
        if rows:
            yield batch_of()

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for file, block, region in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "region")), strict=True):
            rows += [(file, block, OWN, k, e) for k, e in enumerate(elements(region))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _schema(_CUT), strict=True)], schema=_schema(_CUT))


def _measured_splits(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """The documents' pieces, a row per text that ends at ``}``, and a row per split: where it starts, and what is counted in it."""
    pieces = spark.read.text(path, lineSep="}").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), "value"
    )
    measured = staged(pieces.mapInArrow(_measure, _MEASURED), "json-splits")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # outside, unless an odd number of quotes came before
    odd = F.coalesce(F.sum(F.col("quoted0").cast("int")).over(before), F.lit(0)) % 2 == 1
    depth = F.when(F.col("inside"), F.col("depth1")).otherwise(F.col("depth0"))
    starts = measured.withColumn("inside", odd).withColumn("delta", depth).select(
        "file", "block", "size", "bytes", "inside", "delta", F.coalesce(F.sum("delta").over(before), F.lit(0)).alias("depth"),
        F.first(F.nullif("start", F.lit("")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("start"),
    )
    starts = staged(starts.withColumn("level", F.when(F.col("start") == "[", 1).otherwise(2)), "json-starts")
    return pieces, starts


def read_list_records(spark: SparkSession, path, wrapper: str | None = None) -> DataFrame:
    """(file, position, raw): the JSON text of each record, as it stands in documents that are a list or, with ``wrapper``, an object
    whose field of that name is a list. Any other document is an error, a broken one too.

    A document is read twice, one with a wrapper three times. No task holds more than its split and one record, and
    only fragments at the ends of splits are shuffled. Between tasks goes a row for each split.
    """
    pieces, starts = _measured_splits(spark, path)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = starts.groupBy("file", "start").agg(F.max("size").alias("size"), F.sum("bytes").alias("bytes"), F.sum("delta").alias("depth"))
    # text behind the last } counts one } too many
    whole = F.col("depth") == F.when(F.col("bytes") == F.col("size"), 0).otherwise(-1)
    kinds = ["["] + (["{"] if wrapper else [])
    wrong = ends.where(~whole | ~F.coalesce(F.col("start"), F.lit("")).isin(kinds)).first()
    if wrong:
        raise ValueError(f"{wrong['file']}: not a list" + (f" or an object with '{wrapper}'" if wrapper else ""))
    if starts.count() > MOST_SPLITS:
        raise ValueError("too many splits: raise spark.sql.files.maxPartitionBytes")

    def placed(states, level=None):
        # a row per split, so rows stay where and in the order in which they were read
        known = states.select("file", "block", "inside", F.col("depth").cast("int").alias("depth"), "level", "held")
        rows = pieces.join(F.broadcast(known), ["file", "block"], "left")
        lost = F.raise_error(F.lit("the splits of the documents have changed, read them again")).cast("boolean")
        rows = rows.withColumn("inside", F.coalesce("inside", lost))
        return (rows.where(F.col("level") == level) if level else rows).select("file", "block", "inside", "depth", "level", "held", "value")

    held = F.col("depth") >= 1
    if wrapper:
        objects = starts.where("level = 2")
        changes = staged(placed(starts.withColumn("held", F.lit(False)), 2).mapInArrow(_outline(wrapper), _CHANGES), "json-outline")
        missing = objects.select("file").distinct().join(changes.where("entered").select("file").distinct(), "file", "left_anti").first()
        if missing:
            raise ValueError(f"{missing['file']}: not a list or an object with '{wrapper}'")
        starts = starts.join(changes.select("file", "block", F.col("held").alias("_after")), ["file", "block"], "left")
        held = F.when(F.col("level") == 1, held).otherwise(F.coalesce(F.last("_after", ignorenulls=True).over(before), F.lit(False)))
    starts = staged(starts.withColumn("held", held), "json-starts")
    rows = staged(placed(starts).mapInArrow(_cut(wrapper), _CUT), "json-records")

    # a fragment belongs to the record that the last end of one before it left open
    open_ = F.coalesce(F.sum(F.col("ends").cast("int")).over(before), F.lit(0))
    parts = rows.where(F.col("kind") != OWN)
    firsts = parts.where(F.col("kind") == FIRST).select("file", "block", F.lit(True).alias("ends"))
    lasts = parts.where(F.col("kind") == LAST).select("file", "block", F.lit(True).alias("ends"))
    blocks = starts.select("file", "block").join(firsts.unionByName(lasts).distinct(), ["file", "block"], "left").withColumn("ends", F.coalesce("ends", F.lit(False)))
    groups = blocks.withColumn("open", open_)
    group = F.col("open") + F.when(F.col("kind") == LAST, 1).otherwise(0)
    regions = (
        parts.join(groups, ["file", "block"]).groupBy("file", group.alias("group"))
        .agg(F.max("block").alias("block"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "raw"))), lambda x: x["raw"]), "").alias("region"))
    )
    across = staged(regions.select("file", "block", "region").mapInArrow(_joined, _CUT), "json-across")
    counts = (
        rows.where(F.col("kind") == OWN).groupBy("file", "block").agg(F.count(F.lit(1)).alias("own")).join(
            across.groupBy("file", "block").agg(F.count(F.lit(1)).alias("first")), ["file", "block"], "full"
        ).na.fill(0)
    )
    offsets = counts.select("file", "block", "first", F.coalesce(F.sum(F.col("own") + F.col("first")).over(before), F.lit(0)).alias("at"))
    numbered = rows.where(F.col("kind") == OWN).withColumn("skip", F.lit(True)).unionByName(across.withColumn("skip", F.lit(False)))
    position = F.col("at") + F.col("seq") + F.when(F.col("skip"), F.col("first")).otherwise(0)
    return numbered.join(offsets, ["file", "block"]).select("file", position.alias("position"), "raw")


_FIELD_OUTLINE = "file string, block long, held boolean, entered boolean, ended boolean, last boolean"
_FIELD_CUT = "file string, block long, raw string"


def _field_cutters(batches: Iterator[pa.RecordBatch], wanted: str, keep: bool):
    """(file, block, cutter) of each split, when it has been walked through."""
    known: tuple | None = None
    cutter = None
    for row, pieces in _by_split(batches, ("inside", "depth", "held")):
        if row[:2] != known:
            if known is not None:
                yield (*known, cutter)
            known, cutter = row[:2], FieldCutter(*row[2:], wanted)
        for p in pieces:
            cutter.piece(p, keep)
    if known is not None:
        yield (*known, cutter)


def _field_outline(wanted: str):
    """Of splits in which that changes: whether they end in a value of the field, one begins in them, the object ends in them."""

    def run(batches):
        rows = [
            {"file": f, "block": b, "held": c.held, "entered": c.entered, "ended": c.ended, "last": c.last}
            for f, b, c in _field_cutters(batches, wanted, False) if c.changed
        ]
        yield pa.RecordBatch.from_pylist(rows, schema=_schema(_FIELD_OUTLINE))

    return run


def _field_cut(wanted: str):
    def run(batches):
        for f, b, c in _field_cutters(batches, wanted, True):
            yield pa.RecordBatch.from_pylist([{"file": f, "block": b, "raw": "".join(c.kept)}], schema=_schema(_FIELD_CUT))

    return run


def read_field(spark: SparkSession, path, name: str) -> DataFrame:
    """(file, doc): of each document that is an object with the field ``name``, the object with that field alone, a repeated one as often as
    it stands there. Lists and objects that do not end have no rows; what stands elsewhere in a document is told by quotes and brackets only.

    A document is read three times by as many tasks as it has splits. A task holds no more than its part of the field.
    """
    pieces, starts = _measured_splits(spark, path)
    objects = starts.where("start = '{'")
    if objects.count() > MOST_SPLITS:
        raise ValueError("too many splits: raise spark.sql.files.maxPartitionBytes")

    def placed(states):
        known = states.select("file", "block", "inside", F.col("depth").cast("int").alias("depth"), "held")
        return pieces.join(F.broadcast(known), ["file", "block"]).select("file", "block", "inside", "depth", "held", "value")

    changes = staged(placed(objects.withColumn("held", F.lit(False))).mapInArrow(_field_outline(name), _FIELD_OUTLINE), "json-outline")
    sizes = starts.groupBy("file").agg(F.max("block").alias("_block"), F.max("size").alias("size"), F.sum("bytes").alias("bytes"))
    # text behind the last } of a file is read as if one stood behind it
    real = ~F.col("last") | (F.col("block") < F.col("_block")) | (F.col("bytes") == F.col("size"))
    ends = changes.where("ended").join(sizes, "file").where(real).groupBy("file").agg(F.min("block").alias("_end"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    states = objects.join(changes.withColumnRenamed("held", "_after"), ["file", "block"], "left").withColumn(
        "held", F.coalesce(F.last("_after", ignorenulls=True).over(before), F.lit(False))
    )
    states = staged(states.join(ends, "file").where("block <= _end AND (held OR coalesce(entered, false))"), "json-starts")
    parts = staged(placed(states).mapInArrow(_field_cut(name), _FIELD_CUT), "json-field")
    # texts of one field, which the caller reads as one cell
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "raw"))), lambda x: x["raw"]), "")
    return parts.groupBy("file").agg(F.concat(F.lit("{"), F.rtrim(text, F.lit(",")), F.lit("}")).alias("doc"))
