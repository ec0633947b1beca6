"""A Merkle manifest of a table: every row a leaf, a tree for each group of rows, one tree over the groups.

Runs of FAN consecutive nodes become their parent. A tree is cut into aligned blocks of BLOCK nodes, each of them one
row that a task folds alone; the roots of its blocks are the nodes of the next round, so rounds grow with the logarithm
of the largest group. On the way back every block gets the path from its root to the top once, from its parent block.
A changed leaf makes a version of its block that shares all nodes but its ancestors; the version's root then goes on
along that path, in the same task as its block.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import durable, fold

#: Children of a node, and nodes of a block: two levels.
FAN = 16
BLOCK = FAN * FAN
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Node(NamedTuple):
    """A node that is never written to: versions of a tree share those that they have in common."""

    hash: str
    children: tuple = ()


def grown(leaves: list[str], whole: bool) -> Node:
    """The root of a block. whole: the block is all of its tree, which ends as soon as one node is left; else two levels."""
    level, height = [Node(x) for x in leaves], 0
    while len(level) > 1 if whole else height < 2:
        runs = [tuple(level[i : i + FAN]) for i in range(0, len(level), FAN)]
        level, height = [Node(digest(c.hash for c in run), run) for run in runs], height + 1
    return level[0]


def height_of(node: Node) -> int:
    return 1 + height_of(node.children[0]) if node.children else 0


def steps_to(root: Node, place: int) -> list[tuple[int, list[str]]]:
    """From leaf number `place` up to root, for each level: the place among the siblings, and the others' digests."""
    steps, node, size = [], root, FAN ** max(0, height_of(root) - 1)
    while node.children:
        at, place = divmod(place, size)
        steps.append((at, [c.hash for i, c in enumerate(node.children) if i != at]))
        node, size = node.children[at], size // FAN
    return steps[::-1]


def replaced(root: Node, place: int, leaf: str, size: int | None = None) -> Node:
    """The version of a tree in which leaf number `place` is another: new ancestors, all other nodes shared."""
    if not root.children:
        return Node(leaf)
    size = FAN ** (height_of(root) - 1) if size is None else size
    at, rest = divmod(place, size)
    children = (*root.children[:at], replaced(root.children[at], rest, leaf, size // FAN), *root.children[at + 1 :])
    return Node(digest(c.hash for c in children), children)


def climbed(hash_: str, path: list[tuple[int, list[str]]]) -> str:
    """The digest at the end of a path that begins with a node of this one."""
    for at, others in path:
        hash_ = digest([*others[:at], hash_, *others[at:]])
    return hash_


def leaf_column(columns: list[Column]) -> Column:
    """Digest of a row: for each value its UTF-8 byte count, a colon and the value, or a dash for null."""
    made = []
    for c in columns:
        value = c.cast("string")
        made.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*made), 256)


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows plus pos, their number from 0 within the tree, in `order`; rows is durable.

    Rows are sorted in ranges of tree and order, so a tree of any size is many tasks. Only the first tree of a range
    can have begun before it, so the numbers to add are one row a range and are broadcast. Rows that are equal in
    tree and order get any number of theirs, fixed by `spread`, which deals them over ranges too.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(rows.repartitionByRange(n, tree, *order, "spread").withColumn("range", F.spark_partition_id()))
    counts = placed.groupBy("range", tree).agg(F.count("*").alias("n"))
    before = counts.select(F.col("range").alias("r"), F.col(tree).alias("t"), F.coalesce(F.sum("n").over(Window.partitionBy(tree).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range", tree).orderBy(*order, "spread")) - 1
    joined = placed.withColumn("inside", inside).join(F.broadcast(before.where("before > 0")), (F.col("range") == F.col("r")) & (F.col(tree) == F.col("t")), "left")
    return joined.withColumn("pos", (F.col("inside") + F.coalesce("before", F.lit(0))).cast("long")).drop("range", "r", "t", "before", "inside", "spread")


@F.udf(StringType(), useArrow=True)
def _top_of(hashes, whole):
    return grown(list(hashes), whole).hash


def blocks_of(nodes: DataFrame) -> DataFrame:
    """(tree, block, whole, members, top) from nodes (tree, pos, hash, further columns): members are structs by pos.

    whole: the block is surely all of its tree, as it is the first and not full. At most BLOCK nodes meet in a row.
    """
    rest = [c for c in nodes.columns if c not in ("tree", "pos")]
    grouped = nodes.groupBy("tree", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", *rest))).alias("members"))
    whole = (F.col("block") == 0) & (F.size("members") < BLOCK)
    return grouped.withColumn("whole", whole).withColumn("top", _top_of("members.hash", "whole"))


def _blocks_in(batches):
    """The rows of a batch, one at a time, as a block holds hundreds of members."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _path_rows(rows: list[tuple]) -> pa.RecordBatch:
    path = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.list_(pa.string()))]))
    kinds = (("tree", pa.string()), ("block", pa.int64()), ("path", path), ("subroot", pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[k for k, _ in kinds])


PATHS = "tree string, block long, path array<struct<at:int,others:array<string>>>, subroot string"


def _paths(named: bool):
    """For each node of a block its path to the top: its steps inside the block, then the block's own.

    named: the nodes are the tops of other trees, named by `id`, which get the paths of their only node to come.
    """

    def run(batches):
        for b in _blocks_in(batches):
            root = grown([m["hash"] for m in b["members"]], b["whole"])
            rows = []
            for i, m in enumerate(b["members"]):
                path = [{"at": at, "others": others} for at, others in steps_to(root, i)] + b["path"]
                rows.append((m["id"], 0, path, m["hash"]) if named else (b["tree"], m["pos"], path, b["subroot"]))
            yield _path_rows(rows)

    return run


class Forest:
    """Trees over nodes (tree, pos, hash, ...), built in rounds that are written to the shared folder; tops: (tree, top)."""

    def __init__(self, nodes: DataFrame):
        self.rounds, self.tops = [], None
        while self.tops is None or not nodes.isEmpty():
            made = durable(blocks_of(nodes))
            self.rounds.append(made)
            ended = made.where("whole").select("tree", "top")
            self.tops = ended if self.tops is None else self.tops.unionByName(ended)
            nodes = made.where("not whole").select("tree", F.col("block").alias("pos"), F.col("top").alias("hash"))

    def blocks(self, above: DataFrame) -> DataFrame:
        """The lowest blocks, each with its path to the top of everything and its subroot; above: PATHS of the trees' tops."""
        above, paths = above.drop("block"), None
        for made in self.rounds[::-1]:
            placed = made.where("whole").join(above, "tree")  # one row a tree on both sides
            if paths is not None:
                placed = placed.unionByName(made.where("not whole").join(paths, ["tree", "block"]))
            if made is not self.rounds[0]:
                paths = placed.select("tree", "whole", "members", "path", "subroot").mapInArrow(_paths(False), PATHS)
        return placed


def _proved(root: str):
    names = (("id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("steps", pa.int32()), ("proof_sha256", pa.string()), ("folded_root", pa.string()))

    def run(batches):
        for b in _blocks_in(batches):
            top, above = grown([m["hash"] for m in b["members"]], b["whole"]), [(s["at"], s["others"]) for s in b["path"]]
            upper, rows = "".join(x for _, others in above for x in others), []
            unchanged = climbed(top.hash, above)
            for i, m in enumerate(b["members"]):
                inner = steps_to(top, i)
                proof = digest([*(x for _, others in inner for x in others), upper])
                folded = unchanged if m["changed"] is None else climbed(replaced(top, i, m["changed"]).hash, above)
                rows.append((m["id"], m["hash"], b["subroot"], len(inner) + len(above), proof, folded))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), names, strict=True)], names=[n for n, _ in names])

    return run


def prove(leaves: DataFrame) -> DataFrame:
    """(id, leaf, subroot, root, steps, proof_sha256, folded_root, verified) for each of leaves (tree, id, hash, changed).

    tree: the group, by whose order the groups stand in the upper tree, never null; id: a long, by which leaves ascend,
    null first, equal ones by hash; hash: the leaf's digest; changed: its digest after tampering, or null. verified:
    the leaf as it is now (changed or not) and its siblings as they were give the root. No leaves give no rows.
    """
    spark = leaves.sparkSession
    kept = durable(leaves.select("tree", "id", "hash", "changed", F.monotonically_increasing_id().alias("spread")))
    trees = Forest(numbered(kept, "tree", ["id", "hash"]))
    tops = durable(trees.tops.select(F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("top").alias("hash"), F.lit(0).alias("spread")))
    over = Forest(numbered(tops, "tree", ["id"]))
    top = over.tops.first()
    root = top.top if top else ""
    start = spark.createDataFrame([("", 0, [], "")], PATHS)
    ways = durable(over.blocks(start).select("whole", "members", "path").mapInArrow(_paths(True), PATHS))
    rows = trees.blocks(ways).select("whole", "members", "path", "subroot").mapInArrow(_proved(root), "id long, leaf string, subroot string, steps int, proof_sha256 string, folded_root string")
    return rows.select("id", "leaf", "subroot", F.lit(root).alias("root"), "steps", "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def group_key(c: Column) -> Column:
    """A name for each value, null among them, that sorts as the values do with null first."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def manifest(df: DataFrame, by: str = "source", id: str = "doc_id", columns: tuple = COLUMNS, tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """prove() of the rows of df: trees by the values of `by`, leaves by `id`, of the given columns.

    tampered: columns that have other values now, in the rows for which `where` holds. Columns of df not named are not
    read; rows that repeat id and values are leaves of their own; null in any column counts as a dash.
    """
    plain = [F.col(f"`{c}`") for c in columns]
    changed = leaf_column([(tampered or {}).get(c, F.col(f"`{c}`")) for c in columns]) if tampered else F.lit(None).cast("string")
    if where is not None:
        changed = F.when(where, changed)
    return prove(df.select(group_key(F.col(f"`{by}`")).alias("tree"), F.col(f"`{id}`").cast("long").alias("id"), leaf_column(plain).alias("hash"), changed.alias("changed")))


def manifest_index(df: DataFrame) -> DataFrame:
    """For op12: the manifest of the documents, one in five of them by its id (null: the empty text) now in lower case."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    made = manifest(df, tampered={"text": F.translate("text", capitals, capitals.lower())}, where=fold(F.col("doc_id"), 5) == 0)
    return made.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
