"""Hash trees over ranges of row digests: which rows of a copy differ, found from digests.

Rows carry a sha-256 (``sinks.row_checksums``). A part (such as a run) is cut into 16**depth ranges of that digest, deep
enough for some ``LEAF`` different rows a range; a range's digest is that of its sorted rows, and sixteen ranges make one of the level
above, up to the root. Ranges follow from the digests alone, so a changed row changes two leaves and no boundary, and however often a key occurs,
ranges stay small. Roots are equal just when the rows are, repeated ones included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patcheval.functions.stage import staged

#: Different rows that a range may be expected to hold.
LEAF = 256
_DIGITS = 13


def _part(by) -> Column:
    """The part of a row as one text, nulls included."""
    return F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("{}")


def _sha(kind: str, members: Column) -> Column:
    return F.sha2(F.concat(F.lit(kind), F.array_join(F.array_sort(members), ",")).cast("binary"), 256)


#: Stands before a digest that is not 64 lowercase hex digits, so that it is longer than the 32 bytes of one that is.
_OTHER = bytes(33)


def _packed(digest: Column) -> Column:
    """A digest as bytes: half of what its hex digits take in shuffles and stages."""
    plain = digest.rlike(r"\A[0-9a-f]{64}\z")
    return F.when(plain, F.unhex(digest)).otherwise(F.concat(F.lit(_OTHER), digest.cast("binary")))


def _unpacked(packed: Column) -> Column:
    n = len(_OTHER)
    return F.when(F.length(packed) < n, F.lower(F.hex(packed))).otherwise(F.substring(packed, n + 1, 1 << 30).cast("string"))


def _depth(rows: Column) -> Column:
    """The least depth at which that many rows make ranges of ``LEAF``."""
    return sum(((rows > LEAF * 16**d).cast("int") for d in range(_DIGITS)), F.lit(0))


def _entries(checked: DataFrame, by, column: str) -> DataFrame:
    """(part, packed checksum, n): repeated rows are one entry with their number."""
    return checked.groupBy(_part(by).alias("part"), _packed(F.col(column)).alias("checksum")).agg(F.count(F.lit(1)).alias("n"))


def _placed(rows: DataFrame, depths: DataFrame) -> DataFrame:
    return rows.join(depths, "part").withColumn("place", F.substring(_unpacked(F.col("checksum")), F.lit(1), F.col("depth")))


def range_tree(checked: DataFrame, by=("run_id",), like: DataFrame | None = None, column: str = "checksum") -> DataFrame:
    """(part, level, place, depth, rows, digest): the nodes of all trees, one tree for each part, a place being the first digits of the
    digests below it. Roots are at level 0, with an empty place.

    With ``like``, another tree, parts get the depths they have there, so that the two can be compared. Empty tables have no nodes.
    """
    entries = staged(_entries(checked, by, column), "entries")
    depths = entries.groupBy("part").agg(_depth(F.count(F.lit(1))).alias("depth"))
    if like is not None:
        theirs = like.where("level = 0").select("part", F.col("depth").alias("_theirs"))
        depths = depths.join(theirs, "part", "left").select("part", F.coalesce("_theirs", "depth").alias("depth"))
    depths = staged(depths, "depths")
    members = F.transform(F.collect_list(F.struct("checksum", "n")), lambda x: F.concat_ws(":", _unpacked(x["checksum"]), x["n"].cast("string")))
    leaves = _placed(entries, depths).groupBy("part", "depth", "place").agg(F.sum("n").alias("rows"), _sha("rows:", members).alias("digest"))
    leaves = staged(leaves, "leaves")
    columns = ["part", "place", "depth", "rows", "digest"]
    levels, below = [], None
    for level in range(depths.agg(F.max("depth")).first()[0] or 0, -1, -1):
        here = leaves.where(F.col("depth") == level).select(*columns)
        if below is not None:
            up = below.groupBy("part", "depth", F.substring("place", 1, level).alias("place")).agg(
                F.sum("rows").alias("rows"), _sha("ranges:", F.collect_list(F.concat_ws(":", "place", "digest"))).alias("digest")
            )
            here = here.unionByName(up.select(*columns))
        below = staged(here, "level")
        levels.append(below.withColumn("level", F.lit(level)))
    nodes = levels[0] if levels else leaves.withColumn("level", F.lit(0))
    for more in levels[1:]:
        nodes = nodes.unionByName(more)
    return nodes.select("part", "level", "place", "depth", "rows", "digest")


def roots(nodes: DataFrame) -> DataFrame:
    """(part, rows, root)."""
    return nodes.where("level = 0").select("part", "rows", F.col("digest").alias("root"))


def differing_ranges(nodes: DataFrame, other: DataFrame) -> DataFrame:
    """(part, place, depth) of the lowest ranges whose digests differ, ``other`` being a tree ``like`` the first. Goes down from
    the roots and reads of each level only what lies below a difference; equal trees end at their roots."""
    found, above, level = [], None, 0
    while True:
        sides = []
        for side, name in ((nodes, "a"), (other, "b")):
            here = side.where(F.col("level") == level)
            if above is not None:
                parent = F.substring("place", 1, level - 1)
                here = here.withColumn("_parent", parent).join(above, ["part", "_parent"], "left_semi")
            sides.append(here.select("part", "place", F.col("depth").alias(f"_d{name}"), F.col("digest").alias(f"_{name}")))
        both = sides[0].join(sides[1], ["part", "place"], "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
        unlike = staged(both.select("part", "place", F.coalesce("_da", "_db").alias("depth")), "unlike")
        found.append(unlike.where(F.col("depth") == level))
        deeper = unlike.where(F.col("depth") > level)
        if deeper.isEmpty():
            break
        above, level = deeper.select("part", F.col("place").alias("_parent")), level + 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def changed_rows(
    checked: DataFrame, nodes: DataFrame, copy: DataFrame, copy_nodes: DataFrame, keys=("run_id", "instance_id"), by=("run_id",), column: str = "checksum"
) -> DataFrame:
    """(keys, status, rows_before, rows_after) for every key whose rows differ: ``missing`` in the copy, ``extra`` there, or
    ``changed``; the numbers are those of rows that the other side lacks. Null keys are keys. Only rows of differing ranges are compared.
    """
    ranges = staged(differing_ranges(nodes, copy_nodes), "ranges")
    depths = ranges.select("part", "depth").distinct()

    def side(rows, name):
        named = rows.select(*keys, _part(by).alias("part"), _packed(F.col(column)).alias("checksum"))
        inside = _placed(named, depths).join(ranges.select("part", "place"), ["part", "place"], "left_semi")
        # a digest is of the whole row, so rows that share it share their keys; grouped as they are joined, they are shuffled once
        return inside.groupBy("part", "checksum").agg(*[F.first(k).alias(k) for k in keys], F.count(F.lit(1)).alias(name))

    a, b = side(checked, "_a").alias("a"), side(copy, "_b").alias("b")
    both = a.join(b, (F.col("a.part") == F.col("b.part")) & (F.col("a.checksum") == F.col("b.checksum")), "full")
    less = F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0))
    # of null keys either side is right; of others the one that is there
    rows = both.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], less.alias("_less")).where("_less <> 0")
    sums = rows.groupBy(*keys).agg(
        F.sum(F.greatest("_less", F.lit(0))).alias("rows_before"), F.sum(F.greatest(-F.col("_less"), F.lit(0))).alias("rows_after")
    )
    status = F.when(F.col("rows_after") == 0, "missing").when(F.col("rows_before") == 0, "extra").otherwise("changed")
    return sums.select(*keys, status.alias("status"), "rows_before", "rows_after")
