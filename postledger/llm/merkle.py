"""Merkle manifest of a dataset: a persistent tree whose versions copy paths."""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postledger.operators.ids import arrival_ids
from postledger.shared import cut, is_small

FAN = 8  # children of a node
BLOCK_LEVELS = 4  # levels that one task folds
BLOCK = FAN**BLOCK_LEVELS  # nodes of an aligned block
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(joined: str) -> str:
    return hashlib.sha256(joined.encode()).hexdigest()


def framed(value: Column) -> Column:
    """Byte count, colon and value of a field; ``-`` for NULL."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*map(framed, fields)).cast("binary"), 256)


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case, nothing else changed."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def third(doc_id: Column) -> Column:
    """Whether 3 divides the checksum of the id's decimal form; a NULL id is not meant."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def levels_above(n: int) -> int:
    """Foldings that turn ``n`` nodes into one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def block_levels(nodes: list[str], n: int) -> list[list[str]]:
    """The levels inside an aligned block of a tree with ``n`` nodes, given first to last.

    A block folds until it is one node; only a tree that fits one block ends earlier.
    """
    levels = [nodes]
    for _ in range(min(BLOCK_LEVELS, levels_above(n))):
        below = levels[-1]
        levels.append([digest("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
    return levels


def siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """Level by level the digests left and right of the path from node ``at``."""
    path = []
    for level in levels[:-1]:
        begin = at - at % FAN
        path.append(("".join(level[begin:at]), "".join(level[at + 1 : begin + FAN])))
        at //= FAN
    return path


def copied_path(path: list[tuple[str, str]], leaf: str) -> list[str]:
    """A version's own nodes, leaf to root: the ancestors that a changed leaf copies.

    Every other node of the version is the base tree's.
    """
    nodes = [leaf]
    for left, right in path:
        nodes.append(digest(left + nodes[-1] + right))
    return nodes


def written(path: list[tuple[str, str]]) -> str:
    return "".join(f"{left}|{right};" for left, right in path)


def read_path(line: str) -> list[tuple[str, str]]:
    return [tuple(step.split("|")) for step in line.split(";")[:-1]]


def by_place(block: pa.Table) -> pa.Table:
    return block.sort_by("pos")


def _top(block: pa.Table) -> pa.Table:
    block = by_place(block)
    tree, n, pos = (block.column(c)[0].as_py() for c in ("tree", "n", "pos"))
    top = block_levels(block.column("node").to_pylist(), n)[-1]
    return pa.table({"tree": [tree], "n": [-(-n // BLOCK)], "pos": [pos // BLOCK], "node": top})


def in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / BLOCK))


def tiers(nodes: DataFrame, label: str) -> list[DataFrame]:
    """``tree, n, pos, node`` of every BLOCK_LEVELS-th level, from the given nodes to one node a tree.

    Each aligned block is folded by one task of at most BLOCK rows; its top is a node of
    the next tier, whose blocks are dealt out again.
    """
    found = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        blocks = in_blocks(found[-1].select("tree", "n", "pos", "node")).groupBy("tree", "block")
        found.append(cut(blocks.applyInArrow(_top, "tree long, n long, pos long, node string"), label))
        most = -(-most // BLOCK)
    return found


def _paths(block: pa.Table, above: pa.Table) -> pa.Table:
    block, levels, upper = _opened(block, above)
    paths = [written(siblings(levels, at) + upper) for at in range(block.num_rows)]
    return pa.table({"tree": block.column("tree"), "pos": block.column("pos"), "path": pa.array(paths, pa.string())})


def _opened(block: pa.Table, above: pa.Table) -> tuple[pa.Table, list[list[str]], list[tuple[str, str]]]:
    """A block in order, its levels, and the path of its top to the root."""
    block = by_place(block)
    if not block.num_rows:
        return block, [[]], []
    return block, block_levels(block.column("node").to_pylist(), block.column("n")[0].as_py()), read_path(above.column("path")[0].as_py())


def descend(nodes: DataFrame, above: DataFrame, each: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Bring ``above`` (``tree, pos, path`` of the tier over ``nodes``) down to the nodes, block by block."""
    tops = above.withColumnRenamed("pos", "block").groupBy("tree", "block")
    return in_blocks(nodes).groupBy("tree", "block").cogroup(tops).applyInArrow(each, schema)


def tree_paths(found: list[DataFrame], above: DataFrame, label: str) -> DataFrame:
    """``tree, pos, path`` of the tier over the lowest one, from the paths of the trees' last nodes."""
    for nodes in reversed(found[1:-1]):
        above = cut(descend(nodes, above, _paths, "tree long, pos long, path string"), label)
    return above


def numbered(leaves: DataFrame, group_col: str, id_col: str) -> DataFrame:
    """The leaves with ``tree`` (a number that ascends with the group), ``n`` and ``pos`` in their tree.

    Groups ascend bytewise, NULL first; in a group ids ascend, NULL first, then digests.
    """
    placed = arrival_ids(leaves.withColumn("_row", F.monotonically_increasing_id()), [group_col, id_col, "node", "_row"], name="_id").drop("_row")
    trees = cut(placed.groupBy(F.col(group_col).alias("_of")).agg(F.min("_id").alias("tree"), F.count(F.lit(1)).alias("n")), "merkle-trees")
    trees = F.broadcast(trees) if is_small(trees) else trees
    joined = placed.join(trees, F.col(group_col).eqNullSafe(F.col("_of"))).withColumn("pos", F.col("_id") - F.col("tree"))
    return joined.drop("_of", "_id")


def _proved(block: pa.Table, above: pa.Table) -> pa.Table:
    block, levels, upper = _opened(block, above)
    changed = block.column("changed").to_pylist()
    subroot, root, proofs, folded, copies = [], [], [], [], []
    top = levels[-1]
    whole = copied_path(upper, top[0]) if top else []
    height = above.column("height")[0].as_py() if top else 0
    for at, leaf in enumerate(levels[0]):
        path = siblings(levels, at) + upper
        proofs.append(digest("".join(left + right for left, right in path)))
        # The version of a changed leaf; an unchanged one folds to the base tree's root again.
        nodes = copied_path(path, changed[at] or leaf)
        folded.append(nodes[-1])
        copies.append(nodes if changed[at] else None)
        subroot.append(whole[len(whole) - 1 - height])
        root.append(whole[-1])
    return pa.table(
        {
            "doc_id": block.column("doc_id"),
            "leaf": block.column("node"),
            **{k: pa.array(v, pa.string()) for k, v in (("subroot", subroot), ("root", root), ("proof_sha256", proofs), ("folded_root", folded))},
            "verified": pa.array([a == b for a, b in zip(folded, root)], pa.bool_()),
            "copied": pa.array(copies, pa.list_(pa.string())),
        }
    )


def merkle_manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "lang",
    fields: Iterable[str] = FIELDS,
    text_col: str = "text",
    tampered: Callable[[Column], Column] = third,
    tamper: Callable[[Column], Column] = lowered,
) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, copied``, one row per input row.

    A leaf is the digest of the framed ``fields``. Per group, leaves ascend by id and every
    FAN consecutive nodes become their digest until one is left, the subroot; the
    subroots, by group, give the root likewise. ``proof_sha256`` is the digest of all
    siblings on the way to the root.

    Rows that ``tampered`` picks by their id get their text changed by ``tamper``. Each is a
    version of the tree on its own: it copies the changed leaf's ancestors (``copied``, leaf
    to root) and shares all other nodes with the base tree, which never changes.
    ``folded_root`` is the version's root, and ``verified`` whether it is the base's. Rows
    not tampered with fold their own leaf, and ``copied`` is NULL.

    Nodes are folded in aligned blocks of BLOCK nodes, so no task holds more of a group
    however large; the tops of blocks are folded likewise, tier by tier, and the path
    of each top comes down the same way.

    NULL fields are framed as ``-``, other than empty text (``0:``). A NULL group is a group;
    a NULL id comes first and is never tampered with. Rows of one id are leaves of their
    own, by digest; equal rows are equal leaves side by side. A group of one row is its own
    subroot, a table of one group has its subroot as root. An empty table gives an
    empty table; columns other than the fields are not read.
    """
    changed = [tamper(F.col(c)) if c == text_col else F.col(c) for c in fields]
    leaves = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(group_col).alias("group"),
        leaf_digest(map(F.col, fields)).alias("node"),
        F.when(tampered(F.col(id_col)), leaf_digest(changed)).alias("changed"),
    )
    kind = leaves.schema["doc_id"].dataType.simpleString()
    leaves = numbered(cut(leaves, "merkle-leaves"), "group", "doc_id").select("doc_id", "changed", "tree", "n", "pos", "node")
    leaves = cut(leaves, "merkle-placed")
    low = tiers(leaves, "merkle-nodes")

    # One node a tree is left: the leaves of the root's tree, in the order of the groups.
    tops = arrival_ids(low[-1].select(F.col("tree").alias("_tree"), "node"), ["_tree"], name="_id")
    n = tops.count()
    tops = cut(tops.select("_tree", F.lit(0).cast("long").alias("tree"), F.lit(n).cast("long").alias("n"), (F.col("_id") - 1).alias("pos"), "node"), "merkle-subroots")
    high = tiers(tops, "merkle-nodes")
    start = docs.sparkSession.createDataFrame([(0, 0, "")], "tree long, pos long, path string")
    above = descend(tops, tree_paths(high, start, "merkle-paths"), _paths, "tree long, pos long, path string")
    above = tops.select("pos", "_tree").join(above, "pos").select(F.col("_tree").alias("tree"), F.lit(0).cast("long").alias("pos"), "path")
    above = tree_paths(low, cut(above, "merkle-paths"), "merkle-paths")
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, copied array<string>"
    return descend(leaves, above.withColumn("height", F.lit(levels_above(n))), _proved, schema)
