"""Merkle manifest of a dataset by slot pivots, in DataFrame functions only.

Each row is a leaf: the SHA-256 of its fields. Leaves of a group (a source) stand in
key order; every FANOUT consecutive nodes become their parent until one is left, the
group's subroot; the subroots in group order become the root the same way. Parents
come from a pivot: one conditional aggregate a slot spreads the children of a parent
into FANOUT columns, whose concatenation is hashed. Going down again, a child meets
its parent's columns: those before its slot and those after it, without its own, are its
siblings. A row's path is the list of (left, right) up to the root, so its proof and a
root folded from any other leaf need nothing else.

Positions come from one range-sorted index over all rows (``ranking.global_index``),
so a group may hold any share of the rows; a parent has at most FANOUT children, so
no task sees more than its even share. Each level is a table on shared storage,
1 / FANOUT of the one below. The driver holds the number of levels and the root.

Nulls in a field are hashed as a mark of their own; a null group is a group, ordered
first, and null keys come first in theirs. Rows with equal keys are ordered by their
leaf digest; equal rows are leaves of their own, side by side. Empty and very long
texts are hashed whole. Columns beyond the fields, of any name, are left out of leaf and
result. An empty table gives an empty result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimwise.llm.urls import LOWER, UPPER
from claimwise.operators.ranking import global_index
from claimwise.session import materialize
from claimwise.sources.joins import checked_broadcast

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SLOTS = [f"s{i}" for i in range(FANOUT)]


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of concatenated texts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return digest(*map(_field, fields))


def _pivot(nodes: DataFrame) -> DataFrame:
    """Parents of ``nodes`` (g, pos, n: nodes of the group on this level, digest):
    g, pos, n (of the parents' level), a column for each slot, and their digest."""
    slot = F.pmod("pos", F.lit(FANOUT))
    spread = [F.max(F.when(slot == i, F.col("digest"))).alias(c) for i, c in enumerate(SLOTS)]
    rows = nodes.where("n > 1").groupBy("g", F.expr(f"pos div {FANOUT}").alias("pos")).agg(F.max("n").alias("n"), *spread)
    rows = rows.withColumn("n", F.expr(f"(n + {FANOUT - 1}) div {FANOUT}"))
    return rows.withColumn("digest", F.sha2(F.concat_ws("", *SLOTS).cast("binary"), 256))


def levels(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """Pivoted parents level by level, for groups of at most ``largest`` nodes."""
    out = []
    while largest > 1:
        out.append(materialize(_pivot(nodes)))
        nodes, largest = out[-1], -(-largest // FANOUT)
    return out


def _under(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """``nodes`` with the path that their parents give: (left, right) of the parent's
    columns without the node's own, then the parent's path."""
    up = parents.select(F.col("g").alias("_g"), F.col("pos").alias("_pos"), *[F.col(c).alias(f"_{c}") for c in SLOTS], F.col("path").alias("_path"))
    rows = nodes.join(up, (F.col("g") == F.col("_g")) & (F.expr(f"pos div {FANOUT}") == F.col("_pos")))
    slot = F.pmod("pos", F.lit(FANOUT))
    left = F.concat_ws("", *[F.when(slot > i, F.col(f"_{c}")) for i, c in enumerate(SLOTS)])
    right = F.concat_ws("", *[F.when(slot < i, F.col(f"_{c}")) for i, c in enumerate(SLOTS)])
    return rows.select(*nodes.columns, F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("_path")).alias("path"))


def _top(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """``nodes`` that are their group's subroot, with the group's own path."""
    return nodes.where("n = 1").join(tops.withColumnRenamed("g", "_g"), F.col("g") == F.col("_g")).drop("_g")


def paths(nodes: DataFrame, up: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``nodes`` with ``path``: (left, right) from their own level to the root.
    ``up``: their ``levels``; ``tops``: each group's g and path."""
    above = None
    for level in [*reversed(up), nodes]:
        part = _top(level, tops)
        if above is not None:
            part = part.unionByName(_under(level.where("n > 1"), above))
        above = part if level is nodes else materialize(part)
    return above


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, start, lambda now, x: F.sha2(F.concat(x["left"], now, x["right"]).cast("binary"), 256))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", key: str = "doc_id",
             tamper: str = "text", of: int = 5) -> DataFrame:
    """Per row: key, leaf, subroot, root, proof_sha256, folded_root, verified, n_levels.

    ``folded_root`` starts from the leaf as it would be with ``tamper``'s A-Z in
    lower case, in rows where ``of`` divides the crc32 of the decimal key."""
    picked = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % of == 0, F.lit(False))
    own = leaf([F.col(c) for c in fields])
    other = leaf([F.translate(F.col(c), UPPER, LOWER) if c == tamper else F.col(c) for c in fields])
    leaves = materialize(docs.select(
        F.col(key).alias("k"), F.col(group).alias("src"), own.alias("digest"), F.when(picked, other).alias("changed")))
    leaves = leaves.withColumn("row", F.monotonically_increasing_id())
    placed = global_index(leaves, [F.asc_nulls_first("src"), F.asc_nulls_first("k"), F.asc("digest"), F.asc("row")], "at")
    groups = materialize(placed.groupBy("src").agg(F.min("at").alias("begin"), F.count(F.lit(1)).alias("n")))
    groups = materialize(global_index(groups, [F.asc_nulls_first("src")], "g"))
    largest, n_groups = groups.agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()

    few = checked_broadcast(groups.withColumnRenamed("src", "_src"))
    nodes = placed.join(few, F.col("src").eqNullSafe(F.col("_src"))).withColumn("pos", F.col("at") - F.col("begin"))
    nodes = materialize(nodes.select("k", "changed", "digest", "g", "pos", "n"))
    up = levels(nodes, largest)
    subroots = reduce(DataFrame.unionByName, [x.where("n = 1").select("g", "digest") for x in [nodes, *up]])
    subroots = materialize(subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), F.lit(n_groups).cast("long").alias("n"), "digest"))
    over = levels(subroots, n_groups)
    root = (over[-1] if over else subroots).select("digest").first()
    root = F.lit(root[0] if root else None).cast("string")

    none = docs.sparkSession.range(1).select(F.col("id").alias("g"), F.expr("CAST(array() AS array<struct<left:string,right:string>>)").alias("path"))
    tops = materialize(paths(subroots, over, none).select(F.col("pos").alias("g"), F.col("path"), F.col("digest").alias("subroot")))
    rows = paths(nodes, up, tops.select("g", "path")).join(checked_broadcast(tops.select(F.col("g").alias("_g"), "subroot")), F.col("g") == F.col("_g"))
    proof = F.aggregate("path", F.lit(""), lambda now, x: F.concat(now, x["left"], x["right"]))
    folded = fold(F.coalesce("changed", "digest"), F.col("path"))
    out = rows.select(
        F.col("k").alias(key), F.col("digest").alias("leaf"), "subroot", root.alias("root"), F.sha2(proof.cast("binary"), 256).alias("proof_sha256"),
        folded.alias("folded_root"), F.size("path").cast("int").alias("n_levels"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
