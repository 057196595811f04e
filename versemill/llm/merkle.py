"""Merkle manifest of a dataset: nodes labelled by the intervals of leaf ranks they cover.

Each tree (one per source) ranks its rows from 0, and a node of level ``l`` covers the ranks
``[lo, hi)`` of at most ``fanout ** l`` leaves. The label alone places a node: its parent is
the one whose interval contains it, found in the bucket ``lo div fanout ** (l + 1)``, and its
siblings are the children left when its own interval is taken out of its parent's. The roots
of all trees are the leaves of one more tree, whose root stands for the dataset.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versemill.joins import join_lookup
from versemill.llm.common import fold
from versemill.staging import stage, with_row_index

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = "array<struct<left:string,right:string>>"


@dataclass
class Manifest:
    """The families (a parent with its children) of each level of all trees and of the top tree.

    ``families[l]`` holds ``tree, n, lo, hi, hash, children``; ``n`` is the number of leaves
    of the tree, and ``children`` are its nodes of level ``l`` in order. ``lone`` holds the
    trees of one leaf, ``roots`` one row per tree, and ``root`` is None without any row.
    """

    families: list[DataFrame]
    lone: DataFrame
    roots: DataFrame
    top: list[DataFrame]
    root: str | None
    fanout: int


def digest(*values: Column) -> Column:
    """Lower-case hex sha256 of the values: ``-`` for null, else byte count, ``:`` and value."""
    texts = [v.cast("string") for v in values]
    parts = [
        F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t))
        for t in texts
    ]
    return F.sha2(F.concat(*parts), 256)


def _leaf_nodes(docs: DataFrame, id_col: str, tree_col: str, fields: tuple[str, ...], altered: dict) -> DataFrame:
    """A node per row: tree number, leaves of the tree, interval of its rank, digest, id, digest if altered."""
    leaves = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        docs[tree_col].cast("string").alias("source"),
        digest(*(docs[f] for f in fields)).alias("hash"),
        digest(*(altered.get(f, docs[f]) for f in fields)).alias("altered"),
    )
    # rows that repeat an id are told apart by their digests, and equal rows by their place
    ranked = with_row_index(
        leaves.withColumn("place", F.monotonically_increasing_id()),
        F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), "hash", "altered", "place", name="rank",
    ).drop("place")
    # a key that is never null: null sources are one tree
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    trees = ranked.groupBy("source").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    trees = with_row_index(trees, F.asc_nulls_first("source"), name="tree").select(
        key.alias("key"), "tree", "first", "n"
    )
    return join_lookup(ranked.withColumn("key", key), trees, ["key"], ["rank"]).select(
        "tree",
        "n",
        (F.col("rank") - F.col("first")).alias("lo"),
        (F.col("rank") - F.col("first") + 1).alias("hi"),
        "hash",
        "doc_id",
        "altered",
    )


def _bucket(interval: Column, width: int) -> Column:
    return F.floor(interval / F.lit(width)).cast("long")


def _grow(nodes: DataFrame, fanout: int, label: str) -> tuple[list[DataFrame], DataFrame]:
    """The families of every level above ``nodes``, written, and the root of each tree."""
    keep = ["tree", "n", "lo", "hi", "hash"]
    most = nodes.agg(F.max("n")).first()[0] or 0
    families, roots, width = [], nodes.where("n = 1").select(*keep), 1
    while width < most:
        width *= fanout
        child = F.struct(*(c for c in nodes.columns if c not in ("tree", "n")))
        grouped = (
            nodes.where(F.col("n") > width // fanout)
            .groupBy("tree", "n", _bucket(F.col("lo"), width).alias("bucket"))
            .agg(F.sort_array(F.collect_list(child)).alias("children"))  # at most ``fanout`` of them
        )
        family = stage(
            grouped.select(
                "tree",
                "n",
                F.col("children")[0]["lo"].alias("lo"),
                F.element_at("children", -1)["hi"].alias("hi"),
                F.sha2(F.array_join(F.transform("children", lambda c: c["hash"]), ""), 256).alias("hash"),
                "children",
            ),
            f"merkle-{label}",
        )
        families.append(family)
        nodes = family.select(*keep)
        roots = roots.union(nodes.where(F.col("n") <= width))
    return families, roots


def build_manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    tree_col: str = "source",
    fields: tuple[str, ...] = FIELDS,
    altered: dict[str, Column] | None = None,
    fanout: int = FANOUT,
) -> Manifest:
    """Digest every row and grow one tree per value of ``tree_col`` and one over their roots.

    Leaves are ordered by id, null ids first, and rows that repeat an id by digest; trees are
    ordered bytewise by ``tree_col``, null first. ``altered`` gives other values of some
    fields, from which the leaves' second digest is made. Each level is one shuffle of a
    ``fanout``-th of the rows before; groups never hold more than ``fanout`` nodes, however
    large a tree is. Columns that are not among ``fields`` are never read. An empty table
    gives a manifest without a root.
    """
    leaves = stage(_leaf_nodes(docs, id_col, tree_col, fields, altered or {}), "merkle-leaves")
    families, roots = _grow(leaves, fanout, "families")
    roots = stage(roots, "merkle-roots")
    trees = roots.count()
    top_nodes = roots.select(
        F.lit(0).cast("long").alias("tree"),
        F.lit(trees).cast("long").alias("n"),
        F.col("tree").alias("lo"),
        (F.col("tree") + 1).alias("hi"),
        "hash",
    )
    top, root = _grow(top_nodes, fanout, "top")
    found = root.first()
    return Manifest(families, leaves.where("n = 1"), roots, top, found and found["hash"], fanout)


def _descend(families: list[DataFrame], paths: DataFrame, fanout: int) -> DataFrame | None:
    """Hand the paths of the roots ``(tree, n, lo, hi, path, subroot)`` down to the children of level 0.

    A step of a path holds the digests left and right of a node among its siblings. None if
    no tree has a level above its leaves.
    """
    below = None
    for level in range(len(families) - 1, -1, -1):
        width = fanout ** (level + 1)
        # ancestors of this level: roots of trees that end here, and what came down
        ends = paths.where((F.col("n") <= width) & (F.col("n") > width // fanout))
        above = ends if below is None else ends.union(below.select(*ends.columns))
        above = above.select(
            "tree", F.col("lo").alias("from"), F.col("hi").alias("to"), "path", "subroot",
            _bucket(F.col("lo"), width).alias("bucket"),
        )
        placed = families[level].drop("hash").withColumn("bucket", _bucket(F.col("lo"), width))
        inside = placed.join(above, ["tree", "bucket"]).where("from <= lo AND hi <= to").drop("lo", "hi")
        own = inside.select("tree", "n", "path", "subroot", "children", F.explode("children").alias("own"))

        def beside(condition) -> Column:
            return F.array_join(F.transform(F.filter("children", condition), lambda c: c["hash"]), "")

        step = F.struct(
            beside(lambda c: c["hi"] <= F.col("own.lo")).alias("left"),
            beside(lambda c: c["lo"] >= F.col("own.hi")).alias("right"),
        )
        below = own.select("tree", "n", "own.*", "subroot", F.concat(F.array(step), "path").alias("path"))
    return below


def leaf_paths(manifest: Manifest) -> DataFrame:
    """``doc_id, hash, altered, subroot, path`` of every leaf; the path leads to the root of the dataset.

    Siblings are attached to whole families, so a level costs one join of a ``fanout``-th of
    its nodes, and leaves are only unfolded from their family, never joined.
    """
    roots, width = manifest.roots, manifest.fanout
    none = F.array().cast(_STEP)
    trees = roots.agg(F.count("*").alias("n")).select(
        F.lit(0).cast("long").alias("tree"), "n", F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi"),
        none.alias("path"), F.lit(None).cast("string").alias("subroot"),
    )
    top = _descend(manifest.top, trees, width)
    if top is None:
        starts = roots.withColumn("path", none)
    else:
        starts = roots.join(top.select(F.col("lo").alias("tree"), "path"), "tree")
    starts = stage(starts.select("tree", "n", "lo", "hi", "path", F.col("hash").alias("subroot")), "merkle-starts")
    names = ["doc_id", "hash", "altered", "subroot", "path"]
    lone = manifest.lone.join(starts.select("tree", "path", "subroot"), "tree").select(*names)
    found = _descend(manifest.families, starts, width)
    return lone if found is None else lone.union(found.select(*names))


def fold_path(start: Column, path: Column) -> Column:
    """The root that a leaf's digest leads to."""
    return F.aggregate(path, start, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    """sha256 of all siblings, level by level, left to right."""
    joined = F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")
    return F.sha2(joined, 256)


def verify_tampered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    The manifest is made of the rows as given. Then the text of each row whose crc32 of the
    id is divisible by 5 (a null id counts as the empty text) has its ASCII letters lowered,
    and its leaf is folded with the siblings of the manifest; ``verified`` tells whether the
    root comes out. Rows without such letters, and null texts, stay verified.
    """
    tampered = F.when(fold(docs[id_col], 5) == 0, F.translate(docs[text_col], _UPPER, _LOWER)).otherwise(
        docs[text_col]
    )
    manifest = build_manifest(docs, id_col, altered={text_col: tampered}, **options)
    root = F.lit(manifest.root).cast("string")
    return leaf_paths(manifest).select(
        "doc_id",
        F.col("hash").alias("leaf"),
        "subroot",
        root.alias("root"),
        proof_digest(F.col("path")).alias("proof_sha256"),
        fold_path(F.col("altered"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
