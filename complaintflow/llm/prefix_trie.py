"""The prefix trie of conversations, built as ternary search trees over shards of sorted conversations.

Each conversation is a path of turns; a turn is the MD5 of its role and text, so texts never move. Equal paths are
aggregated to one, with counts from each task, before they are range-sorted; a shard is at most ``SHARD_PATHS`` paths, or
``SHARD_TURNS`` turns, that follow each other in that order. Inside a shard the turns are numbered by a dictionary, the
paths go into a ternary search tree median first, which keeps it balanced, and one iterative pass from the last created
node back to the root accumulates members, leaves and savings.

Nodes that a neighbouring shard may have, too, lie on the shard's first or last path. They aren't final: they become two
paths again, which carry what the shard has accumulated below them, and go through the same step with the boundary paths of
all other shards. Each round leaves at most two paths for each shard, until one shard holds all.

A conversation is one value, as a text is: its turns are brought together once, as 16 bytes and a length each.

Defined results: turns are ordered by ``turn``, null first, equal ones by MD5; a null role or text is empty; repeated rows
are turns like any other; rows without conv_id belong to no conversation and are left out; a conversation without turns is a
member of the root only; an empty table has no nodes; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from complaintflow.llm.checksums import crc32_sql
from complaintflow.llm.shared import columns, stored, table

SHARD_PATHS = 1 << 15
SHARD_TURNS = 1 << 20
#: A shard has so many paths in any case, however long: it leaves two of them.
LEAST_PATHS = 4
#: So many turns of a path decide on its place in the first round's order, twice as many in each further round; paths that
#: agree in them follow their hash.
SORT_TURNS = 64
#: Members of a node are listed in pieces of so many neighbouring identifiers at first.
ID_SLICE = 4096

ROOT = hashlib.md5(b"").digest()
#: What a shard knows of one node of a path: of the node's own members and of all that lies below it in finished shards.
PART = "n_convs long, conv_id long, n_children long, n_leaves long, saved long"
_PART = [f.split()[0] for f in PART.split(", ")]
_PATH = f"turns array<binary>, sizes array<long>, parts array<struct<{', '.join(f.replace(' ', ': ') for f in PART.split(', '))}>>"
_NODE = "node binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
NODE_COLUMNS = [f.split()[0] for f in _NODE.split(", ")]


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, path: array of (turn: MD5 of role and text, size: bytes of the text), in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turns = columns(conversations, "conv_id", "turn", "role", "text").filter(F.col("conv_id").isNotNull()).select(
        "conv_id", F.struct(F.col("turn").alias("at"), digest.alias("turn"), F.octet_length(text).cast("long").alias("size")).alias("t"))
    ordered = F.sort_array(F.collect_list("t"))
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["turn"].alias("turn"), t["size"].alias("size"))).alias("path"))


def _node_of(path) -> F.Column:
    """A node's identifier: the MD5 of its parent's and its last turn."""
    return F.aggregate(path, F.lit(ROOT), lambda above, t: F.unhex(F.md5(F.concat(above, t["turn"]))))


def prefix_trie(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, parent, depth, conv_id, n_convs, n_children, n_leaves, saved_tokens) and members (conv_id, node in which
    the conversation ends) of ``paths`` (conv_id, path)."""
    spark = paths.sparkSession
    placed = stored(paths.select("conv_id", "path", _node_of(F.col("path")).alias("node")))
    distinct = placed.groupBy("node").agg(F.count("*").alias("n"), F.min("conv_id").alias("low"), F.any_value("path").alias("path"))
    nothing = F.struct(*(F.lit(None if f == "conv_id" else 0).cast("long").alias(f) for f in _PART))
    end = F.struct(F.col("n").alias("n_convs"), F.col("low").alias("conv_id"), *(F.lit(0).cast("long").alias(f) for f in _PART[2:]))
    rows = distinct.select(F.col("path.turn").alias("turns"), F.col("path.size").alias("sizes"),
                           F.concat(F.array_repeat(nothing, F.size("path")), F.array(end)).alias("parts"))
    done, parts, deep = [], 0, SORT_TURNS
    while True:
        order = [F.slice("turns", 1, deep), F.xxhash64("turns")]
        if parts == 1:
            dealt = rows.coalesce(1)
        else:
            dealt = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
        grown = dealt.sortWithinPartitions(*order, "turns").mapInArrow(_grow(deep, parts == 1), f"{_NODE}, {_PATH}")
        out = stored(grown)
        done.append(out.filter("node IS NOT NULL").select(*NODE_COLUMNS))
        rows = out.filter("node IS NULL").select("turns", "sizes", "parts")
        left, turns = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("turns")), F.lit(0))).first()
        if not left:
            break
        # four shards a task; one shard takes all that is left as soon as it is no more than that
        shards = max(left / SHARD_PATHS, turns / SHARD_TURNS)
        parts, deep = max(1, min(1 + int(shards / 4), left // (2 * LEAST_PATHS))), 2 * deep
    nodes = done[0]
    for more in done[1:]:
        nodes = nodes.unionByName(more)
    return nodes, placed.select("conv_id", "node")


def _grow(deep: int, last: bool):
    """Task function: shards of sorted paths to finished nodes and, unless one shard holds all, boundary paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, turns = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("turns", "sizes", "parts"))):
                if not last and len(shard) >= LEAST_PATHS and (len(shard) >= SHARD_PATHS or turns + len(row[0]) > SHARD_TURNS):
                    yield from _batches(*_shard(shard, deep, last))
                    shard, turns = [], 0
                shard.append(row)
                turns += len(row[0])
        if shard:
            yield from _batches(*_shard(shard, deep, last))

    return run


def _batches(nodes: list[tuple], paths: list[tuple]) -> Iterator[pa.RecordBatch]:
    types = [pa.binary(), pa.binary(), *[pa.int64()] * 6, pa.list_(pa.binary()), pa.list_(pa.int64()),
             pa.list_(pa.struct([(f, pa.int64()) for f in _PART]))]
    names = [*NODE_COLUMNS, "turns", "sizes", "parts"]
    rows = [(*n, None, None, None) for n in nodes] + [(*[None] * len(NODE_COLUMNS), *p) for p in paths]
    for at in range(0, len(rows), 1 << 14):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at:at + (1 << 14)]), types)], names)


class TernarySearchTree:
    """Paths of numbers. ``parent``, ``depth`` and ``code`` describe the trie nodes; node 0 is the root."""

    def __init__(self) -> None:
        self.code, self.lower, self.higher, self.first, self.parent, self.depth = [-1], [0], [0], [0], [0], [0]

    def insert(self, path: list[int]) -> list[int]:
        """The nodes of the path below the root, created where they are new."""
        code, lower, higher, first = self.code, self.lower, self.higher, self.first
        at, nodes = 0, []
        for c in path:
            above, links, slot = at, first, at
            at = first[at]
            while at and code[at] != c:
                links = lower if c < code[at] else higher
                slot, at = at, links[at]
            if not at:
                at = len(code)
                links[slot] = at
                code.append(c)
                lower.append(0)
                higher.append(0)
                first.append(0)
                self.parent.append(above)
                self.depth.append(self.depth[above] + 1)
            nodes.append(at)
        return nodes


def median_first(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of each interval ahead of its halves."""
    open_ = [(0, n)]
    while open_:
        lo, hi = open_.pop()
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            open_ += [(mid + 1, hi), (lo, mid)]


def _shard(rows: list[tuple], deep: int, last: bool) -> tuple[list[tuple], list[tuple]]:
    """The nodes that only this shard has, and its first and last path with all that belongs to them."""
    lengths = [len(r[0]) for r in rows]
    _, codes = np.unique(np.array([t for r in rows for t in r[0]], dtype="S16"), return_inverse=True)
    codes, ends = codes.tolist(), np.cumsum([0, *lengths]).tolist()
    tree = TernarySearchTree()
    places: list[list[int]] = [[]] * len(rows)
    for i in median_first(len(rows)):
        places[i] = [0, *tree.insert(codes[ends[i]:ends[i + 1]])]

    n = len(tree.code)
    members, leaves, saved, children = [0] * n, [0] * n, [0] * n, [0] * n
    smallest: list[int | None] = [None] * n
    turn, size = [b""] * n, [0] * n
    for (turns, sizes, parts), nodes in zip(rows, places):
        for v, t, b in zip(nodes[1:], turns, sizes):
            turn[v], size[v] = t, b
        for v, p in zip(nodes, parts):
            if p["n_convs"]:
                members[v] += p["n_convs"]
                smallest[v] = p["conv_id"] if smallest[v] is None else min(smallest[v], p["conv_id"])
                children[v] += p["n_children"]
                leaves[v] += p["n_leaves"]
                saved[v] += p["saved"]

    name = [ROOT] * n
    for v in range(1, n):  # parents are created ahead of their children
        name[v] = hashlib.md5(name[tree.parent[v]] + turn[v]).digest()
    shared = set()
    for edge in () if last else {0, len(rows) - 1}:
        shared.update(places[edge][:deep + 1])
        if lengths[edge] >= deep:  # deeper down the order doesn't follow the turns, so any shard may have these nodes
            shared.update(v for nodes in places if len(nodes) > deep and nodes[deep] == places[edge][deep] for v in nodes)
    found = []
    for v in range(n - 1, -1, -1):
        if v in shared:
            continue
        if not children[v]:
            leaves[v] += 1
        saved[v] += (members[v] - 1) * size[v]
        above = tree.parent[v]
        found.append((name[v], name[above] if v else None, tree.depth[v], smallest[v], members[v], children[v], leaves[v], saved[v]))
        if v:
            members[above] += members[v]
            smallest[above] = smallest[v] if smallest[above] is None else min(smallest[above], smallest[v])
            children[above] += 1
            leaves[above] += leaves[v]
            saved[above] += saved[v]
    boundary, written = [], set()
    for (turns, sizes, _), nodes in zip(rows, places):
        cut = max((k + 1 for k, v in enumerate(nodes) if v in shared and v not in written), default=0)
        if cut:  # what several paths have in common goes with the first of them
            parts = [dict(zip(_PART, (0, None, 0, 0, 0) if v in written else (members[v], smallest[v], children[v], leaves[v], saved[v])))
                     for v in nodes[:cut]]
            written.update(nodes[:cut])
            boundary.append((turns[:cut - 1], sizes[:cut - 1], parts))
    return found, boundary


# --------------------------------------------------------------------------- the registered query
HEAD_TURNS, HEAD_CONVS = 9, 5


def shared_heads(found: DataFrame) -> DataFrame:
    """Every conversation c begins with the first h turns of c - c % 5, h = CRC-32 of c in decimal, modulo 9, ahead of its own after h."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD_TURNS).cast("int")
    heads = found.filter(F.col("conv_id") % HEAD_CONVS == 0).select(F.col("conv_id").alias("base"), F.slice("path", 1, HEAD_TURNS).alias("head"))
    marked = found.select("conv_id", "path", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % HEAD_CONVS).alias("base"))
    own = F.slice("path", F.col("h") + 1, F.size("path"))
    taken = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.slice("path", 1, 0))
    return marked.join(heads, "base", "left").select("conv_id", F.concat(taken, own).alias("path"))


def ends(members: DataFrame) -> DataFrame:
    """node, ids: the conversations that end in it, in numerical order with commas between. They are joined in slices first,
    so that a conversation with very many copies meets as few long strings."""
    sliced = members.groupBy("node", F.floor(F.col("conv_id") / ID_SLICE).alias("slice")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return sliced.groupBy("node").agg(F.array_join(F.sort_array(F.collect_list(F.struct("slice", "ids")))["ids"], ",").alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, members = prefix_trie(shared_heads(sequences(table(spark, sf_dir, "conversations"))))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    listed = ends(members).select("node", F.sha2("ids", 256).alias("sha"))
    return nodes.join(above, "parent", "left").join(listed, "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


SQL = f"""
WITH own AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))
                       ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS path
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT conv_id, path, CAST({crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 AS BIGINT) AS h FROM own),
paths AS (
  SELECT c.conv_id, list_concat(coalesce(b.path[1:c.h], []), c.path[c.h + 1:]) AS path
  FROM heads c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
members AS (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM paths),
nodes AS (
  SELECT depth, path[1:depth] AS prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(strlen(path[1:depth][depth].t), 0) AS size,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(path) = depth), '')) AS ends_sha256
  FROM members GROUP BY ALL),
children AS (SELECT depth - 1 AS depth, prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
own_parts AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children, CASE WHEN c.n_children IS NULL THEN 1 ELSE 0 END AS leaf, (n.n_convs - 1) * n.size AS saved
  FROM nodes n LEFT JOIN children c ON n.depth = c.depth AND n.prefix = c.prefix),
below AS (SELECT prefix, leaf, saved, unnest(range(0, depth + 1)) AS depth FROM own_parts),
subtrees AS (SELECT depth, prefix[1:depth] AS prefix, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM below GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM own_parts n JOIN subtrees s ON n.depth = s.depth AND n.prefix = s.prefix
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]"""
