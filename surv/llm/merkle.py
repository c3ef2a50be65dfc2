"""Operator 11: Merkle manifest of a dataset as a persistent, path-copying tree.

Every row is a leaf, the SHA-256 of its fields.  Leaves of a group ascend by id;
every ``ARITY`` consecutive nodes become their hash until one is left, the
group's subroot; subroots in the order of their groups become the root likewise.

1. ``leaves`` hashes texts where they are read: only digests are shuffled.
2. ``positioned`` numbers the rows of each group: a range partitioning by (group,
   id), one written table, and running sums over (group, partition) counts.
3. Up: an aligned block of ``ARITY ** BLOCK_LEVELS`` neighbours is one group of a
   bounded size; a task makes its subtree and hands its top node on.  Each round
   leaves 1/729 of the nodes, so the upper rounds are small tables.
4. Down: each block meets the path above it (siblings left and right of every
   level), and gives every node its own.
5. Versions: a changed leaf makes a new version of the tree.  It shares all
   untouched nodes and copies only its ancestors: inside the block from the
   block's nodes, then on along the block's path through the upper levels, row by
   row in the same tasks.

Defined results: null fields count as ``-``; an empty text is ``0:``; a null group
is a group of its own and comes first; null ids come first in a group; rows with
equal ids are ordered by their leaf, and wholly repeated rows are leaves of their
own; a group with one leaf has it as its subroot; one group's subroot is the root;
an empty table has no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surv.session import materialize

ARITY = 3
BLOCK_LEVELS = 6
BLOCK = ARITY ** BLOCK_LEVELS

NODE = "g string, pos long, n long, digest string"
PATH = "g string, pos long, digest string, lefts array<string>, rights array<string>, root string"


def field(value: Column) -> Column:
    """``-`` for null, else byte count, ``:`` and the value as text."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]).cast("binary"), 256)


def leaves(rows: DataFrame, fields: list[str], group_col: str, id_col: str, changed: dict[str, Column] | None = None,
           when: Column | None = None) -> DataFrame:
    """One row per row of ``rows``: ``g`` (group as an ordered, non-null key),
    ``id``, ``leaf``, and ``new``: the leaf with the columns of ``changed``
    replaced, null where ``when`` does not hold."""
    old = [F.col(f"`{c}`") for c in fields]
    new = F.lit(None).cast("string")
    if changed:
        new = F.when(F.lit(True) if when is None else when, leaf([changed.get(c, F.col(f"`{c}`")) for c in fields]))
    group = F.col(f"`{group_col}`").cast("string")
    return rows.select(F.when(group.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), group)).alias("g"),
                       F.col(f"`{id_col}`").alias("id"), leaf(old).alias("leaf"), new.alias("new"))


def positioned(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` plus ``pos``, the 0-based place in its group ``g`` by ``order``,
    and ``n``, the group's size.  Rows of a hot group spread over the range
    partitions; only counts per (group, partition) meet in a window."""
    keys = ["g", *order]
    m = materialize(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), name)
    m = m.withColumn("_part", F.shiftright("_at", 33))
    counts = m.groupBy("g", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    w = Window.partitionBy("g")
    counts = counts.select("g", "_part", "_first", F.sum("_rows").over(w).alias("n"),
                           (F.sum("_rows").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")).alias("_before"))
    return (m.join(counts, ["g", "_part"]).withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first"))
            .drop("_at", "_part", "_first", "_before"))


def sha(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def subtree(nodes: list[str], whole: bool) -> list[list[str]]:
    """The levels above ``nodes``, themselves first: up to one node in a whole
    group, else the fixed number of levels of an aligned block."""
    levels = [nodes]
    while (len(levels[-1]) > 1) if whole else (len(levels) <= BLOCK_LEVELS):
        below = levels[-1]
        levels.append([sha(below[i: i + ARITY]) for i in range(0, len(below), ARITY)])
    return levels


def siblings(levels: list[list[str]], i: int) -> tuple[list[str], list[str]]:
    """Per level of a subtree the digests left and right of node ``i`` in its run."""
    lefts, rights = [], []
    for nodes in levels[:-1]:
        a = i - i % ARITY
        lefts.append("".join(nodes[a:i]))
        rights.append("".join(nodes[i + 1: a + ARITY]))
        i //= ARITY
    return lefts, rights


def copied(node: str, lefts: list[str], rights: list[str]) -> list[str]:
    """The ancestors that a version with ``node`` in its place has of its own."""
    out = []
    for left, right in zip(lefts, rights):
        node = sha([left, node, right])
        out.append(node)
    return out


def _block_levels(t: pa.Table) -> list[list[str]]:
    return subtree(t["digest"].to_pylist(), t["n"][0].as_py() <= BLOCK)


def up(nodes: DataFrame) -> DataFrame:
    """One node per aligned block of ``nodes``."""
    def block(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        top = _block_levels(t)[-1][0]
        return pa.table({"g": t["g"][:1], "pos": pa.array([t["pos"][0].as_py() // BLOCK], pa.int64()),
                         "n": pa.array([-(-t["n"][0].as_py() // BLOCK)], pa.int64()), "digest": pa.array([top], pa.string())})

    return nodes.groupBy("g", (F.col("pos") / BLOCK).cast("long").alias("b")).applyInArrow(lambda t: block(t), NODE)


def down(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """The path of every node from the paths of the blocks' top nodes."""
    def block(t: pa.Table, top: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        levels = _block_levels(t)
        lefts, rights, root = top["lefts"][0].as_py(), top["rights"][0].as_py(), top["root"][0].as_py()
        own = [siblings(levels, i) for i in range(t.num_rows)]
        strings = pa.list_(pa.string())
        return pa.table({"g": t["g"], "pos": t["pos"], "digest": t["digest"], "lefts": pa.array([a + lefts for a, _ in own], strings),
                         "rights": pa.array([b + rights for _, b in own], strings), "root": pa.array([root] * t.num_rows, pa.string())})

    return (nodes.withColumn("b", (F.col("pos") / BLOCK).cast("long")).groupBy("g", "b")
            .cogroup(above.withColumnRenamed("pos", "b").groupBy("g", "b")).applyInArrow(lambda t, top: block(t, top), PATH))


def rounds_for(n: int | None) -> int:
    """Rounds of ``up`` until ``n`` nodes are one; at least one."""
    k = 1
    while n is not None and n > BLOCK ** k:
        k += 1
    return k


class Manifest:
    """The tree over ``leaves``: its written levels, and what follows from them."""

    def __init__(self, leaf_rows: DataFrame, name: str = "manifest"):
        self.id_type = leaf_rows.schema["id"].dataType.simpleString()
        # written first: the range partitioning draws its bounds from digests, not by hashing all texts once more
        self.leaves = positioned(materialize(leaf_rows, f"{name}-digests"), ["id", "leaf"], f"{name}-leaves")
        nodes = self.leaves.select("g", "pos", "n", F.col("leaf").alias("digest"))
        self.groups = self._levels(nodes, name)
        tops = self.groups[-1].select(F.lit("").alias("g"), F.col("g").alias("group"), "digest")
        self.tops = positioned(tops, ["group"], f"{name}-tops")
        self.upper = self._levels(self.tops.select("g", "pos", "n", "digest"), name)

    @staticmethod
    def _levels(nodes: DataFrame, name: str) -> list[DataFrame]:
        """``nodes`` and the written tables of nodes above, up to one per group."""
        out = [nodes]
        for _ in range(rounds_for(nodes.agg(F.max("n")).first()[0])):
            out.append(materialize(up(out[-1]), f"{name}-level"))
        return out

    def root(self) -> str | None:
        """The root digest; None for an empty table."""
        top = self.upper[-1].first()
        return top and top.digest

    def _paths(self) -> DataFrame:
        """Paths of the first blocks' top nodes: ``g, pos, lefts, rights, subroot, root``."""
        none = F.expr("cast(array() as array<string>)")
        p = self.upper[-1].select("g", "pos", "digest", none.alias("lefts"), none.alias("rights"), F.col("digest").alias("root"))
        for nodes in reversed(self.upper[:-1]):
            p = down(nodes, p)
        p = self.tops.select("g", "pos", "group").join(p, ["g", "pos"])
        p = p.select(F.col("group").alias("g"), F.lit(0).cast("long").alias("pos"), "digest", "lefts", "rights",
                     F.concat("digest", "root").alias("root"))      # both tops travel down
        for nodes in reversed(self.groups[1:-1]):
            p = down(nodes, p)
        return p

    def audit(self, versions: bool = False) -> DataFrame:
        """Per leaf: ``id, g, leaf, subroot, root``, ``proof`` (siblings of all
        levels, left to right, as one text), ``folded_root`` (of the version with
        the new leaf, else of the leaf itself), and with ``versions`` the nodes
        ``copies`` that the version has of its own, from the leaf's parent up."""
        def block(t: pa.Table, top: pa.Table) -> pa.Table:
            t = t.sort_by("pos")
            levels = subtree(t["leaf"].to_pylist(), t["n"][0].as_py() <= BLOCK)
            lefts, rights, tops = top["lefts"][0].as_py(), top["rights"][0].as_py(), top["root"][0].as_py()
            proof, folded, copies = [], [], []
            for i, (old, new) in enumerate(zip(levels[0], t["new"].to_pylist())):
                a, b = siblings(levels, i)
                a, b = a + lefts, b + rights
                path = copied(new or old, a, b)
                proof.append("".join(x + y for x, y in zip(a, b)))
                folded.append(path[-1] if path else new or old)
                copies.append(path if new and new != old else [])
            n = t.num_rows
            out = {"id": t["id"], "g": t["g"], "leaf": t["leaf"], "subroot": pa.array([tops[:64]] * n, pa.string()),
                   "root": pa.array([tops[64:]] * n, pa.string()), "proof": pa.array(proof, pa.string()), "folded_root": pa.array(folded, pa.string())}
            if versions:
                out["copies"] = pa.array(copies, pa.list_(pa.string()))
            return pa.table(out)

        schema = f"id {self.id_type}, g string, leaf string, subroot string, root string, proof string, folded_root string"
        rows = self.leaves.withColumn("b", (F.col("pos") / BLOCK).cast("long")).groupBy("g", "b")
        above = self._paths().withColumnRenamed("pos", "b").groupBy("g", "b")
        return rows.cogroup(above).applyInArrow(lambda t, top: block(t, top), schema + (", copies array<string>" if versions else ""))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def documents_manifest(docs: DataFrame) -> Manifest:
    """The manifest of ``documents`` per source; where 2 divides the crc32 of an
    id, a version whose text has lost its line ends."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return Manifest(leaves(docs, FIELDS, "source", "doc_id", {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}, tampered))
