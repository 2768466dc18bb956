"""Connected components by alternating large-star and small-star.

Edges are a distributed table throughout; each round is two group-wise minima, combined
before they are shuffled, and two equi-joins with one row per node on one side.  Every round
is written to the shared scratch folder; the loop ends when the edges are a forest of stars.
The aggregation that tells this also finds the largest degrees.  Only if a node has more than
``max(HUB, edges / HUBS)`` edges, the hubs' edges are dealt over parts of that size, each of
which meets a copy of the hub's row; there are at most 2 x HUBS such nodes and as many
additional rows, whatever the input, so the table of hubs may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromalake.runtime import materialize, release

#: A node with more edges than this, and more than 1 / HUBS of all edges, is a hub.
HUB, HUBS = 512, 10_000


def hub_size(rows: int) -> int:
    """The number of rows from which a key counts as a hub; at most HUBS keys of ``rows`` rows are beyond it."""
    return max(HUB, rows // HUBS)


def join_counted(rows: DataFrame, keyed: DataFrame, keys: list[str], other: str, hub: int | None) -> DataFrame:
    """``rows`` joined by ``keys`` with ``keyed``, which has a row per key and its number of rows ``n``.

    Keys of more than ``hub`` rows are joined in parts, dealt by ``other``; None: there are none.
    """
    if hub is None:
        return rows.join(keyed.drop("n"), keys)
    count = F.ceil(F.col("n") / hub).cast("int")
    parts = keyed.where(F.col("n") > hub).select(*keys, count.alias("_parts"))
    dealt = rows.join(F.broadcast(parts), keys, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(other), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    copies = F.when(F.col("n") > hub, F.sequence(F.lit(0), count - 1)).otherwise(F.array(F.lit(0)))
    return dealt.join(keyed.withColumn("_part", F.explode(copies)).drop("n"), [*keys, "_part"]).drop("_part")


def _large_star(edges: DataFrame, hub: int | None) -> DataFrame:
    """``u > v``: ties every larger neighbour of a node to the smallest of the node and its neighbours."""
    end = F.explode(F.array(F.struct(F.col("u").alias("k"), F.col("v").alias("to"), F.lit(0).alias("n")), F.struct(F.col("v").alias("k"), F.col("v").alias("to"), F.lit(1).alias("n"))))
    low = edges.select(end.alias("e")).groupBy(F.col("e.k").alias("v")).agg(F.min("e.to").alias("m"), F.sum("e.n").alias("n")).where("n > 0")
    return join_counted(edges, low, ["v"], "u", hub).select("u", F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, hub: int | None) -> DataFrame:
    """``u > v``: ties a node and its smaller neighbours to the smallest."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    tied = join_counted(edges, low, ["u"], "v", hub).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionAll(low.select("u", F.col("m").alias("v"))).distinct()


def _shape(edges: DataFrame) -> tuple[bool, int | None, int | None]:
    """Whether every ``u`` has one ``v`` and no ``v`` is a ``u``; the hub sizes of large-star and small-star, if there are hubs."""
    end = F.explode(F.array(F.struct(F.col("u").alias("k"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("k"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    per = edges.select(end.alias("e")).groupBy("e.k").agg(F.sum("e.up").alias("up"), F.sum("e.down").alias("down"))
    most = per.agg(F.max(F.when(F.col("down") > 0, F.col("up"))).alias("chain"), F.max("up").alias("up"), F.max("down").alias("down"), F.sum("up").alias("edges")).first()
    if not most["edges"] or (most["up"] == 1 and not most["chain"]):
        return True, None, None
    size = hub_size(most["edges"])
    return False, size if most["down"] > size else None, size if most["up"] > size else None


def connected_components(spark, edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest reachable node, for every node of an edge (u, v).

    Self-loops and nulls are ignored; direction and repetition of edges do not matter.
    """
    clean = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(spark, clean, name)
    for _ in range(max_rounds):
        done, down, up = _shape(now)
        if done:
            break
        old, now = now, materialize(spark, _small_star(_large_star(now, down), up), name)
        release(spark, old)
    else:
        raise RuntimeError(f"{name}: components did not settle in {max_rounds} rounds")
    # a forest of stars: every u once, and its root
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out.scratch = now.scratch  # type: ignore[attr-defined]
    return out


def merge_components(spark, comps: DataFrame, edges: DataFrame, name: str = "components") -> DataFrame:
    """Components (node, component) after further edges (u, v); ``comps`` and ``edges`` are written tables.

    Only the components that an edge touches take part; nodes that are new are their own.
    """
    root = lambda x: comps.select(F.col("node").alias(x), F.col("component").alias(f"_{x}"))
    lifted = edges.join(root("u"), "u", "left").join(root("v"), "v", "left").select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v"))
    moved = connected_components(spark, lifted, name)
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    old = comps.join(to, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    ends = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(comps, "node", "left_anti")
    new = ends.join(moved, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    out = materialize(spark, old.unionByName(new), name)
    release(spark, moved)
    return out
