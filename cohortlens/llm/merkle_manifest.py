"""Merkle manifest of a table: a hash tree for each group of rows, one root above them, proofs by folding.

A node is the SHA-256 of its children's digests as hex text, at most `WIDTH` children.  Building a parent copies the
hash state before each child slot and keeps the copies.  A changed child is folded by resuming the
state of its slot with the replacement and the siblings to the right of it; nothing to its left is hashed again.

As Spark work: leaves are hashed in the scan; they are ordered by ranges of (group, id) and get their places from counts
per range.  SPAN levels at a time are built as blocks of WIDTH ** SPAN consecutive nodes, a group's blocks in different
tasks, so a large group is no large task.  Each round (a tier) has WIDTH ** SPAN times fewer nodes; it ends with a subroot for
each group, and the subroots are the nodes of one more tree, whose top is the root.  On the way down every
block gets the path above it, (left siblings, right siblings) level by level.  Hash states cannot leave a
task, so a block rebuilds those of its own levels, and takes up the states above it once from the left siblings.
All its rows are folded with copies of these states.

Defined results: groups are ordered by their UTF-8 bytes, null first; leaves of a group ascend by id, a null id first,
equal ids by their leaf (a repeated row is a leaf each time); a tree of one node is that node; an empty table gives no rows
and no root; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

WIDTH, SPAN = 8, 3
PATH_TYPE = "array<struct<left:binary,right:binary>>"
PATH = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))


def leaf_hash(fields: Sequence[str | Column]) -> Column:
    """Digest (binary) of the fields, each `-` if null, else its UTF-8 byte count, `:` and its value."""
    texts = [(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256))


class MidstateTree:
    """Some levels of a hash tree whose parents keep the hash state before each child slot; digests are hex bytes."""

    def __init__(self, nodes: list[bytes], levels: int, width: int = WIDTH):
        self.width, self.rows, self.states = width, [nodes], []
        for _ in range(levels):
            states, parents = [], []
            for at in range(0, len(self.rows[-1]), width):
                state = sha256()
                for child in self.rows[-1][at:at + width]:
                    states.append(state.copy())
                    state.update(child)
                parents.append(state.hexdigest().encode())
            self.states.append(states)
            self.rows.append(parents)
        self.levels = levels

    def siblings(self, slot: int) -> list[tuple[bytes, bytes]]:
        """(left, right) of a slot, level by level."""
        out = []
        for row in self.rows[:self.levels]:
            start = slot - slot % self.width
            out.append((b"".join(row[start:slot]), b"".join(row[slot + 1:start + self.width])))
            slot //= self.width
        return out

    def fold(self, slot: int, digest: bytes, siblings: list[tuple[bytes, bytes]]) -> bytes:
        """The top node when `digest` stands in the slot."""
        for states, (_, right) in zip(self.states, siblings, strict=True):
            digest = resume(states[slot], digest, right)
            slot //= self.width
        return digest


def resume(state, digest: bytes, right: bytes) -> bytes:
    state = state.copy()
    state.update(digest)
    state.update(right)
    return state.hexdigest().encode()


def height(n: int, width: int = WIDTH) -> int:
    """Levels above n nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // width), levels + 1
    return levels


def places(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """The rows with i, the place (from 0) within `tree` by `order`, and n, the rows of the tree.

    Sorted in ranges of (tree, order), which a column without ties must end, and written with their number within the
    range; the count of each (range, tree) does the rest.
    """
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranged = materialise(ranged.withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    counts = ranged.groupBy("tree", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    own = Window.partitionBy("tree")
    before = F.sum("rows").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("tree", "part", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("rows").over(own).alias("n"))
    placed = ranged.withColumn("part", part).join(counts, ["tree", "part"])
    return placed.withColumn("i", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "before")


def _block(nodes: DataFrame, span: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("i") / WIDTH**span))


def _hex(column: pa.ChunkedArray) -> list[bytes]:
    return [d.hex().encode() for d in column.to_pylist()]


def _unhex(digest: bytes) -> bytes:
    return bytes.fromhex(digest.decode())


def _up(nodes: DataFrame, span: int) -> DataFrame:
    """The next tier: (tree, i, n, digest), one node for each block."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        n = table["n"][0].as_py()
        tree = MidstateTree(_hex(table["digest"]), min(span, height(n)))
        return pa.table({"tree": table["tree"][:1], "i": table["block"][:1], "n": [-(-n // WIDTH**span)], "digest": pa.array([_unhex(tree.rows[-1][0])], pa.binary())})

    return _block(nodes.select("tree", "i", "n", "digest"), span).groupBy("tree", "block").applyInArrow(build, "tree string, i long, n long, digest binary")


def _down(nodes: DataFrame, paths: DataFrame, span: int) -> DataFrame:
    """(tree, i, path, top) of each node, from those (with n and digest) of the tier above."""
    keep = [c for c in nodes.columns if c == "name"]

    def extend(table: pa.Table, above: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        tree = MidstateTree(_hex(table["digest"]), min(span, height(table["n"][0].as_py())))
        path = [(s["left"], s["right"]) for s in above["path"][0].as_py()]
        own = [[{"left": x, "right": y} for x, y in tree.siblings(k) + path] for k in range(len(table))]
        top = pa.array([above["top"][0].as_py()] * len(table), pa.binary())
        return pa.table({"tree": table["tree"], "i": table["i"], "path": pa.array(own, PATH), "top": top, **{c: table[c] for c in keep}})

    schema = f"tree string, i long, path {PATH_TYPE}, top binary" + "".join(f", {c} string" for c in keep)
    return _block(nodes.select("tree", "i", "n", "digest", *keep), span).groupBy("tree", "block").cogroup(
        paths.withColumnRenamed("i", "block").groupBy("tree", "block")).applyInArrow(extend, schema)


class Manifest:
    """The trees of a table of leaves: rows (tree, digest) and columns `order`, of which the last has no ties."""

    def __init__(self, leaves: DataFrame, order: Sequence[str], span: int = SPAN):
        self.span = span
        self.tiers = [materialise(places(leaves, order, "manifest-ranges"), "manifest-leaves")]
        self._climb(self.tiers)
        subroots = self.tiers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
        self.upper = [materialise(places(subroots, ["name"], "manifest-groups"), "manifest-subroots")]
        self._climb(self.upper)
        top = self.upper[-1].select(F.lower(F.hex("digest")).alias("root")).first()  # one row
        self.root: str | None = top["root"] if top else None

    def _climb(self, tiers: list[DataFrame]) -> None:
        while (tiers[-1].agg(F.max("n")).first()[0] or 0) > 1:
            tiers.append(materialise(_up(tiers[-1], self.span), "manifest-tier"))

    @property
    def subroots(self) -> DataFrame:
        """(tree, subroot) of each group."""
        return self.upper[0].select(F.col("name").alias("tree"), F.lower(F.hex("digest")).alias("subroot"))

    def _paths(self) -> DataFrame:
        """(tree, i, path, top): the path above each block of leaves, and the subroot of its tree."""
        top = self.upper[-1]
        paths = top.select(*[c for c in top.columns if c in ("tree", "i", "name")], F.array().cast(PATH_TYPE).alias("path"), F.lit(None).cast("binary").alias("top"))
        for tier in reversed(self.upper[:-1]):
            paths = _down(tier, paths, self.span)
        paths = paths.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("i"), "path")
        paths = paths.join(self.tiers[-1].select("tree", F.col("digest").alias("top")), "tree")
        for tier in reversed(self.tiers[1:-1]):
            paths = materialise(_down(tier, paths, self.span), "manifest-paths")
        return paths

    def fold(self, replaced: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
        """(keep..., leaf, subroot, proof, folded) of every leaf, as hex text.

        `proof` is the digest of all siblings, level by level up to the root; `folded` the root that
        the column `replaced` (binary; null: the leaf itself) gives in place of the leaf.
        """
        nodes, span = self.tiers[0], self.span
        replacement = F.coalesce(F.col(replaced), F.col("digest")) if replaced else F.col("digest")
        rows = _block(nodes.select("tree", "i", "n", "digest", replacement.alias("replaced"), *[F.col(c).alias(f"keep_{c}") for c in keep]), span)
        paths = self._paths().withColumnRenamed("i", "block")

        def run(table: pa.Table, above: pa.Table) -> pa.Table:
            table = table.sort_by("i")
            leaves = _hex(table["digest"])
            tree = MidstateTree(leaves, min(span, height(table["n"][0].as_py())))
            path = [(s["left"], s["right"]) for s in above["path"][0].as_py()]
            upper = [(sha256(left), right) for left, right in path]  # the states before this block's slots
            rest = b"".join(left + right for left, right in path)
            subroot = above["top"][0].as_py().hex()
            proofs, folded = [], []
            for k, digest in enumerate(_hex(table["replaced"])):
                siblings = tree.siblings(k)
                proofs.append(sha256(b"".join(x for pair in siblings for x in pair) + rest).hexdigest())
                digest = tree.fold(k, digest, siblings)
                for state, right in upper:
                    digest = resume(state, digest, right)
                folded.append(digest.decode())
            kept = {c: table[f"keep_{c}"] for c in keep}
            return pa.table({**kept, "leaf": [x.decode() for x in leaves], "subroot": [subroot] * len(table), "proof": proofs, "folded": folded})

        types = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
        schema = "".join(f"`{c}` {types[c]}, " for c in keep) + "leaf string, subroot string, proof string, folded string"
        return rows.groupBy("tree", "block").cogroup(paths.groupBy("tree", "block")).applyInArrow(run, schema)


def leaves(docs: DataFrame, fields: Sequence[str], tree_col: str, id_col: str, changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(tree, id, digest, row, replaced): `replaced` is the digest with the `changed` fields, where `where` holds."""
    name = F.col(tree_col).cast("string")
    digest = leaf_hash(fields)
    replaced = F.lit(None).cast("binary")
    if changed:
        other = leaf_hash([changed.get(f, F.col(f)) for f in fields])
        replaced = other if where is None else F.when(where, other)
    out = docs.select(F.when(name.isNull(), "").otherwise(F.concat(F.lit("x"), name)).alias("tree"), F.col(id_col).alias("id"), digest.alias("digest"), replaced.alias("replaced"))
    return materialise(out.withColumn("row", F.monotonically_increasing_id()), "manifest-hashes")


def manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), tree_col: str = "lang", id_col: str = "doc_id", changed: dict[str, Column] | None = None, where: Column | None = None, span: int = SPAN) -> Manifest:
    """The manifest of a table.  Its tree names are the values of `tree_col` after an `x`, the empty string for null."""
    return Manifest(leaves(docs, fields, tree_col, id_col, changed, where), ["id", "digest", "row"], span)


def verify(m: Manifest, id_col: str = "doc_id") -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, with the `replaced` leaves of the manifest."""
    folded = m.fold("replaced", ["id"])
    root = F.lit(m.root).cast("string")
    return folded.select(F.col("id").alias(id_col), "leaf", "subroot", root.alias("root"), F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"))
