"""A Merkle manifest of a data set, of which only some levels are kept: leaves, and every second level above.

Nodes of one kept level lie in blocks of ``RUN * RUN`` neighbours, an aligned subtree each. A proof is taken out from the
top down: in each subtree the level between is made anew from the nodes that are kept, the siblings of every node are
written behind those of the levels below, and what was made is dropped. No proof is ever shuffled: a
subtree meets the siblings of its root, then a row for each of its nodes follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patcheval.functions.positions import positions
from patcheval.functions.stage import staged
from patcheval.llm.common import ascii_lower

#: Nodes that make one of the next level.
RUN = 16
#: Characters of a digest.
WIDTH = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the strings one behind the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _field(value: Column) -> Column:
    s = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(changes: dict[str, Column] | None = None) -> Column:
    """The digest of a row of documents; ``changes`` puts other values in place of some of its fields."""
    return digest(*[_field((changes or {}).get(c, F.col(c))) for c in FIELDS])


# ---- inside a subtree: ``x`` holds its nodes' digests in order, ``n`` is how many nodes its group has at this level


def _joined(x: Column) -> Column:
    return F.array_join(x, "")


def _runs(x: Column) -> Column:
    """The digests of the runs of ``x``: the level between."""
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / RUN).cast("int") - 1), lambda i: digest(_joined(F.slice(x, i * RUN + 1, RUN))))


def _top(x: Column, n: Column) -> Column:
    """The digest of the subtree's root: one node of a group is its own root, up to ``RUN`` make it in one level."""
    return F.when(n == 1, x[0]).when(n <= RUN, digest(_joined(x))).otherwise(digest(_joined(_runs(x))))


def _siblings(run: Column, i: Column) -> Column:
    """What stands left and right of node ``i`` of a run, given as one string."""
    return F.struct(F.substring(run, F.lit(1), i * WIDTH).alias("l"), F.substring(run, (i + 1) * WIDTH + 1, F.length(run)).alias("r"))


# ---- Spark jobs


def _blocks(nodes: DataFrame, keys: list[str], payload: list[str], name: str) -> DataFrame:
    """Kept nodes by subtree: keys, _block, _count (nodes of the group) and ``nodes``, in order: at most ``RUN * RUN``."""
    row = F.struct("_place", "digest", *payload)
    block = F.shiftright(F.col("_place"), 2 * (RUN - 1).bit_length()).alias("_block")
    return staged(nodes.groupBy(*keys, block).agg(F.first("_count").alias("_count"), F.sort_array(F.collect_list(row)).alias("nodes")), name)


def _digests(nodes: str = "nodes") -> Column:
    return F.col(f"{nodes}.digest")


def _climb(leaves: DataFrame, keys: list[str], payload: list[str]) -> list[DataFrame]:
    """The kept levels, lowest first. ``leaves``: keys, _place from 0 on within its group, _count, digest and payload."""
    kept = [_blocks(leaves, keys, payload, "merkle-0")]
    while not kept[-1].where(F.col("_count") > RUN * RUN).isEmpty():
        up = kept[-1].where(F.col("_count") > RUN * RUN).select(
            *keys, F.col("_block").alias("_place"), F.ceil(F.col("_count") / (RUN * RUN)).alias("_count"), _top(_digests(), F.col("_count")).alias("digest")
        )
        kept.append(_blocks(up, keys, [], f"merkle-{2 * len(kept)}"))
    return kept


def _roots(kept: list[DataFrame], keys: list[str]) -> DataFrame:
    """Keys and the digest of each group's root: of the level at which one subtree holds the whole group."""
    out = None
    for level in kept:
        one = level.where(F.col("_count") <= RUN * RUN).select(*keys, _top(_digests(), F.col("_count")).alias("digest"))
        out = one if out is None else out.unionByName(one)
    return out


def _same(a: str, b: str, keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return on


def _descend(kept: list[DataFrame], keys: list[str], above: DataFrame) -> DataFrame:
    """A row for each node of the lowest kept level: keys, ``node`` (with its payload), ``path`` and the columns of ``above``, which
    has for each group (keys) the ``path`` of its root."""
    extra = [c for c in above.columns if c not in (*keys, "path")]
    known = None  # paths of nodes of the level above, by place
    for level in reversed(kept):
        lone = level.where(F.col("_count") <= RUN * RUN).alias("a").join(above.alias("b"), _same("a", "b", keys))
        met = lone.select(*[F.col(f"a.{k}").alias(k) for k in keys], "_block", "_count", "nodes", "path", *extra)
        if known is not None:
            many = level.where(F.col("_count") > RUN * RUN).alias("a").join(known.alias("b"), _same("a", "b", keys) & (F.col("_block") == F.col("_at")))
            met = met.unionByName(many.select(*[F.col(f"a.{k}").alias(k) for k in keys], "_block", "_count", "nodes", "path", *extra))
        count, steps = F.col("_count"), F.sequence(F.lit(0), F.ceil(F.size("nodes") / RUN).cast("int") - 1)
        runs = met.select(
            *keys, "_count", "path", *extra, _joined(_runs(_digests())).alias("_between"),
            F.posexplode(F.transform(steps, lambda i: F.slice("nodes", i * RUN + 1, RUN))).alias("_r", "_run"),
        )
        high = F.concat(F.array(_siblings(F.col("_between"), F.col("_r"))), F.col("path"))
        each = runs.select(
            *keys, "_count", F.when(count <= RUN, F.col("path")).otherwise(high).alias("path"), *extra,
            _joined(_digests("_run")).alias("_line"), F.posexplode("_run").alias("_i", "node"),
        )
        low = F.concat(F.array(_siblings(F.col("_line"), F.col("_i"))), F.col("path"))
        known = each.select(*keys, F.col("node._place").alias("_at"), "node", F.when(count == 1, F.col("path")).otherwise(low).alias("path"), *extra)
        if level is not kept[0]:
            known = staged(known.drop("node"), "merkle-paths")
    return known.drop("_at")


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, start, lambda node, s: digest(s["l"], node, s["r"]))


def manifest(docs: DataFrame, checked: Column | None = None) -> DataFrame:
    """A row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``checked``: the leaf whose proof is folded, of the columns of ``docs``; null: the leaf itself. Per source leaves ascend by
    doc_id, null first, rows with one id by their leaves, equal rows in any order; subroots ascend by source, null first. Null
    fields are ``-``, an empty text is ``0:``; a lone row is its own root and has no siblings; no rows give no rows. Other
    columns are not read.
    """
    return proofs(*tree(docs, checked))


def tree(docs: DataFrame, checked: Column | None = None) -> tuple[list[DataFrame], list[DataFrame]]:
    """The kept levels of the leaves of each source, and those above the subroots."""
    made = leaf()
    other = F.lit(None).cast("string") if checked is None else checked
    rows = docs.select("source", "doc_id", made.alias("digest"), other.alias("checked"))
    rows = rows.withColumn("checked", F.when(F.col("checked") != F.col("digest"), F.col("checked")))
    placed = positions(staged(rows, "leaves"), ["source"], ["doc_id", "digest", "checked"])
    kept = _climb(placed.withColumnsRenamed({"position": "_place", "group_size": "_count"}), ["source"], ["doc_id", "checked"])
    tops = positions(_roots(kept, ["source"]), [], ["source"]).withColumnsRenamed({"position": "_place", "group_size": "_count"})
    return kept, _climb(tops.withColumn("_all", F.lit(0)), ["_all"], ["source"])


def proofs(kept: list[DataFrame], tops: list[DataFrame]) -> DataFrame:
    """The rows of :func:`manifest`, from kept levels alone."""
    root = _roots(tops, ["_all"]).select("_all", F.array().cast("array<struct<l:string,r:string>>").alias("path"), F.col("digest").alias("root"))
    above = _descend(tops, ["_all"], root).select("node.source", F.col("node.digest").alias("subroot"), "path", "root")
    each = _descend(kept, ["source"], staged(above, "merkle-subroots"))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), "")
    checked = F.coalesce("node.checked", "node.digest")
    out = each.select(
        F.col("node.doc_id").alias("doc_id"), F.col("node.digest").alias("leaf"), "subroot", "root",
        F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), fold(checked, F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_leaf() -> Column:
    """The leaf with the text's A-Z in lower case, of rows whose crc32 of the id in decimals is a multiple of 5."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf({"text": ascii_lower(F.col("text"))}))
