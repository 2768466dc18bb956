"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard.  At each node every child draws
``-ln(u) / weight`` with ``u`` hashed from (key, child) and the smallest draw wins.
Raising one child's weight can only pull rows into that child, so a change moves
rows only into subtrees whose weights change.  Growth opens a region of its own for
the new shard: all other weights stay, hence one more shard takes rows only into itself.

Law ``key``: the key and the tree alone decide the shard; neither other rows nor the
order of rows matter.  Slots within a shard are gapless from 0 without sorting a shard
in one task: rows are ranked within (shard, hash bucket) and buckets get prefix sums.

Edge cases: a null key is a key of its own (drawn as the empty string); a null text
has no bytes (size 1, CRC 0); a text of any length is one row, hashed whole; of equal
draws the child listed first wins; repeated rows each get a slot of their own, equal rows
being interchangeable; an empty table gives an empty result; columns other than key and
text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

#: Slot buckets of a shard. The table of bucket offsets has shards x BUCKETS rows at most.
BUCKETS = 1024


@dataclass(frozen=True)
class Node:
    """A region, rack or shard (a leaf has a shard number)."""

    name: str
    weight: float = 1.0
    children: tuple[Node, ...] = ()
    shard: int | None = None

    @property
    def total(self) -> float:
        return sum(c.total for c in self.children) if self.children else self.weight

    @property
    def shards(self) -> list[int]:
        return [s for c in self.children for s in c.shards] if self.children else [self.shard]


def tree(n_shards: int, per_rack: int = 4, racks: int = 2, weights: dict[int, float] | None = None) -> Node:
    """Shards 0..n-1 in racks of ``per_rack`` and regions of ``racks`` racks."""
    weights = weights or {}
    leaves = [Node(f"s{i}", weights.get(i, 1.0), shard=i) for i in range(n_shards)]
    rack = [Node(f"k{i}", children=tuple(leaves[i : i + per_rack])) for i in range(0, n_shards, per_rack)]
    return Node("root", children=tuple(Node(f"r{i}", children=tuple(rack[i : i + racks])) for i in range(0, len(rack), racks)))


def grow(root: Node, weight: float = 1.0) -> Node:
    """One more shard, in a region of its own."""
    i = max(root.shards) + 1
    leaf = Node(f"s{i}", weight, shard=i)
    return replace(root, children=(*root.children, Node(f"g{i}", children=(Node(f"h{i}", children=(leaf,)),))))


def uniform(key: Column, salt: str) -> Column:
    """A hash of (key, salt) as an integer below 2^52, exact in a double."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{salt}")).cast("binary")), 1, 13), 16, 10).cast("long")


def _draw(key: Column, node: Node) -> Column:
    u = (uniform(key, node.name) + 0.5) / float(1 << 52)
    return -F.log(u) / F.lit(float(node.total))


def shard_of(key: Column, node: Node) -> Column:
    """Shard number of ``key`` (a non-null string) below ``node``."""
    if node.shard is not None:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return shard_of(key, node.children[0])
    best = F.array_min(F.array(*[F.struct(_draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(node.children)]))["i"]
    out = F.when(F.lit(False), F.lit(-1))
    for i, c in enumerate(node.children):
        out = out.when(best == i, shard_of(key, c))
    return out.cast("int")


def _leaf_by_steps(df: DataFrame, key: str, root: Node, out: str) -> DataFrame:
    """As shard_of, level by level, so that each draw is computed once."""
    level, nodes = f"{out}_n0", [root]
    df = df.withColumn(level, F.lit(0))
    depth = 0
    while any(n.children for n in nodes):
        nxt: list[Node] = []
        choice = F.lit(None).cast("int")
        for i, n in enumerate(nodes):
            base, kids = len(nxt), n.children or (n,)
            nxt += kids
            if len(kids) == 1:
                pick = F.lit(base)
            else:
                pick = F.array_min(F.array(*[F.struct(_draw(F.col(key), c).alias("d"), F.lit(base + j).alias("i")) for j, c in enumerate(kids)]))["i"]
            choice = F.when(F.col(level) == i, pick).otherwise(choice)
        depth += 1
        df = df.withColumn(f"{out}_n{depth}", choice).drop(level)
        level, nodes = f"{out}_n{depth}", nxt
    leaf = F.element_at(F.array(*[F.lit(n.shard) for n in nodes]), F.col(level) + 1)
    return df.withColumn(out, leaf.cast("int")).drop(level)


def shard_rows(docs: DataFrame, root: Node, grown: Node | None = None, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(key, size, text_crc32, shard, slot[, grown_shard]) of every row."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    base = docs.select(F.col(key).alias("_key"), (F.octet_length(body) + 1).cast("long").alias("_size"), F.crc32(body).alias("_crc"))
    # Repeated rows become one row with a count before anything is ranked.
    rows = base.groupBy("_key", "_size", "_crc").agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.withColumn("_k", F.coalesce(F.col("_key").cast("string"), F.lit("")))
    rows = _leaf_by_steps(rows, "_k", root, "_shard")
    if grown is not None:
        rows = _leaf_by_steps(rows, "_k", grown, "_grown")
    rows = rows.withColumn("_bucket", (uniform(F.col("_k"), "slot") % buckets).cast("int")).drop("_k")
    offsets = (
        rows.groupBy("_shard", "_bucket").agg(F.sum("_n").alias("_t"))
        .withColumn("_off", F.sum("_t").over(W.partitionBy("_shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("_t"))
        .drop("_t")
    )
    within = W.partitionBy("_shard", "_bucket").orderBy("_key", "_crc", "_size").rowsBetween(W.unboundedPreceding, 0)
    # offsets has at most shards x buckets rows, so its broadcast is bounded
    placed = rows.join(F.broadcast(offsets), ["_shard", "_bucket"]).withColumn("_at", F.col("_off") + F.sum("_n").over(within) - F.col("_n"))
    step = 1 << 16
    out = placed.withColumn("_hi", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / step))))
    out = out.withColumn("_lo", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(step - 1).cast("long"), F.col("_n") - 1 - F.col("_hi") * step))))
    cols = [F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_shard").alias("shard"), (F.col("_at") + F.col("_hi") * step + F.col("_lo")).alias("slot")]
    return out.select(*cols, *([F.col("_grown").alias("grown_shard")] if grown is not None else []))


def op3_weighted_hash_tree(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 equal shards (two regions of two racks of four), law ``key``."""
    root = tree(16)
    out = shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), root, grow(root))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
