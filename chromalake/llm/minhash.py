"""Near-duplicate documents by MinHash.

Many universal hash minima of each document's set of word shingles, banding, signature
verification, exact confirmation on full sets, and connected components by alternating
large-star and small-star (see ``components``).

Scale and skew.  Documents with equal sets collapse to one node (the smallest doc_id)
before banding, so copies cost one row each.  A band bucket contributes a star around
its smallest node first.  Stars that pass the signature check are joined to families.  A
bucket that also holds nodes unlike its smallest one is looked at again: what lies outside
the bucket's largest family is compared by signature with the whole bucket, in blocks, so
two nodes of a bucket are either of one family or were compared.  A bucket with more than
BLOCK such nodes first meets BLOCK leaders, which ties its large groups together; the work
that is left is linear in a bucket unless its members really differ, and then grows with
their number squared (in comparisons; rows are copied once a block).  Full sets are
compared within a family only.  A family of more than CHUNK
documents is split into chunks, each of which also gets the family's CHUNK leaders, and
whatever is then still apart from the family's largest component is compared with every
chunk.  So the work of a large family is linear unless its members really differ, and no
link between different texts of a family is lost.

Edge cases: a null text, or one without words, has an empty set (n_shingles 0) and is
linked with nothing; a text with fewer words than the shingle width has its whole word
sequence as its only shingle; a very long text is signed whole, its set being held in one
task at a time; a row with a null id is counted and kept but linked with
nothing (component null); rows that share an id are one document with several texts, so
their links are joined; repeated rows are all returned; an empty table gives an empty
result; columns other than id and text are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromalake.llm import textkernel as tk
from chromalake.llm.components import connected_components, hub_size, join_counted, merge_components
from chromalake.runtime import lean, materialize, release, ship_package, small_batches

BANDS, ROWS = 28, 5  # a pair at similarity 0.8 is missed once in 67,000
MINIMA = BANDS * ROWS
#: Stars below this estimated similarity are dropped before families are formed. A pair
#: linked through a third text at 0.8 each has at least 0.6; the estimate's deviation is 0.04.
STAR = 0.5
#: Signatures of a mixed bucket compared at once, and how far below the asked similarity an
#: estimate may lie there (five deviations).
BLOCK, MARGIN = 512, 0.2
#: Documents of a family compared at once, and their shingles.
CHUNK, CHUNK_SHINGLES = 256, 1 << 21
#: Up to so many narrow rows (three numbers each) are broadcast to pick the wide rows they
#: need; beyond, both sides are shuffled. Their number is counted first.
FEW = 500_000
_TILE = 1 << 13


def coefficients(n: int = MINIMA, seed: int = 20240229) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of n multiply-add-shift hashes (strongly universal on 32-bit keys)."""
    k = np.arange(1, 2 * n + 1, dtype=np.uint64)
    r = tk.mix(k + np.uint64(seed) * np.uint64(1 << 20))
    return r[:n] | np.uint64(1), r[n:]


def signatures(sets: np.ndarray, bounds: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima (texts x hashes, uint32) of non-empty sets laid end to end."""
    n = len(bounds) - 1
    out = np.empty((n, len(a)), np.uint32)
    x = sets >> np.uint64(32)
    i = 0
    while i < n:  # about 32 k shingles at a time stay in cache
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + (1 << 15), side="right")) - 1)
        part, cut = x[bounds[i] : bounds[j]], (bounds[i:j] - bounds[i])
        buf = np.empty_like(part)
        for k in range(len(a)):
            np.multiply(part, a[k], out=buf)
            np.add(buf, b[k], out=buf)
            out[i:j, k] = np.minimum.reduceat(buf, cut) >> np.uint64(32)
        i = j
    return out


def set_digests(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each non-empty set (order-free sums of mixed members, remixed)."""
    n = np.diff(bounds).astype(np.uint64)
    lo = np.add.reduceat(tk.mix(sets), bounds[:-1])
    hi = np.add.reduceat(tk.mix(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), bounds[:-1])
    return np.stack([tk.mix(lo ^ n), tk.mix(hi + n)], 1)


def _sign_batches(width: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients()
        for batch in batches:
            for i, j, buf, off in tk.slices(batch.column(1)):
                sets, bounds, _ = tk.shingle_sets(buf, off, width)
                size = np.diff(bounds)
                full = np.flatnonzero(size)
                n = j - i
                sig = np.zeros((n, MINIMA), np.uint32)
                dig = np.zeros((n, 2), np.uint64)
                if len(full):
                    tight = np.append(bounds[full], bounds[-1])
                    sig[full] = signatures(sets, tight, a, b)
                    dig[full] = set_digests(sets, tight)
                dead = size == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, n),
                        pa.array(size.astype(np.int64)),
                        pa.array(dig[:, 0].view(np.int64), mask=dead),
                        pa.array(dig[:, 1].view(np.int64), mask=dead),
                        pa.ListArray.from_arrays(
                            pa.array((np.concatenate([[0], np.cumsum(~dead)]) * MINIMA).astype(np.int32)),
                            pa.array(sig[~dead].ravel().view(np.int32)),
                        ),
                    ],
                    ["doc_id", "n_shingles", "d0", "d1", "sig"],
                )

    return run


def _set_batches(width: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in tk.slices(batch.column(1)):
                sets, bounds, _ = tk.shingle_sets(buf, off, width)
                rest = [batch.column(k).slice(i, j - i) for k in range(batch.num_columns) if k != 1]
                yield pa.RecordBatch.from_arrays([*rest, tk.binary_column(sets, bounds)], ["node", "family", "chunks", "set"])

    return run


class Groups:
    """Union-find over a few hundred items."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def linked_pairs(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Pairs (i, j) with 100 * |intersection| >= percent * |union|, on full sets.

    Intersections come from products of 0/1 membership tiles, so memory is bounded.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    if n == 2:
        both = np.array([[0, len(np.intersect1d(sets[0], sets[1], assume_unique=True))], [0, 0]], np.float64)
    else:
        who = np.repeat(np.arange(n), size)
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        every, who = every[order], who[order]
        new = np.concatenate([[True], every[1:] != every[:-1]])
        col = np.cumsum(new) - 1
        shared = np.bincount(col)[col] > 1  # a member of one set only meets nothing
        who = who[shared]
        col = np.cumsum(np.concatenate([[True], np.diff(col[shared]) != 0])) - 1 if len(who) else col[:0]
        both = np.zeros((n, n), np.float64)
        for t in range(0, int(col[-1]) + 1 if len(col) else 0, _TILE):
            a, b = np.searchsorted(col, [t, t + _TILE])
            m = np.zeros((n, int(col[b - 1]) - t + 1), np.float32)
            m[who[a:b], col[a:b] - t] = 1
            both += m @ m.T
    union = size[:, None] + size[None, :] - both
    i, j = np.nonzero(np.triu(100 * both >= percent * union, 1) & (size[:, None] > 0) & (size[None, :] > 0))
    return np.stack([i, j], 1)


def _link_batches(percent: int):
    """Rows sorted by group key -> (u, v) edges of a spanning forest of each group's links."""

    def group(nodes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        g = Groups(len(nodes))
        for i, j in linked_pairs(sets, percent).tolist():
            g.join(i, j)
        return [(nodes[i], nodes[g.find(i)]) for i in range(len(nodes)) if g.find(i) != i]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets, seen = None, [], [], set()
        for batch in batches:
            keys = list(zip(*[batch.column(k).to_pylist() for k in range(batch.num_columns - 2)], strict=True))
            edges: list[tuple[int, int]] = []
            for k, node, blob in zip(keys, batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1), strict=True):
                if k != key:
                    if len(nodes) > 1:
                        edges += group(nodes, sets)
                    key, nodes, sets, seen = k, [], [], set()
                raw = blob.as_buffer()
                if (node, raw.size, h := hash(raw.to_pybytes())) not in seen:
                    seen.add((node, raw.size, h))
                    nodes.append(node)
                    sets.append(np.frombuffer(raw.to_pybytes(), np.uint64))
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["u", "v"])
        if len(nodes) > 1 and (edges := group(nodes, sets)):
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["u", "v"])

    return run


def alike(sigs: np.ndarray, few: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j), i < few and i < j, of signatures that agree in ``least`` minima."""
    i, j = [], []
    for k in range(min(few, len(sigs) - 1)):
        hit = np.flatnonzero(np.count_nonzero(sigs[k + 1 :] == sigs[k], axis=1) >= least)
        i.append(np.full(len(hit), k))
        j.append(hit + k + 1)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *i]), np.concatenate([none, *j])


def _alike_batches(least: int):
    """Rows (band, key, chunk, block, late, node, sig), sorted -> (u, v) edges of a spanning forest."""

    def group(late: np.ndarray, nodes: np.ndarray, sigs: np.ndarray) -> list[tuple[int, int]]:
        g = Groups(len(nodes))
        i, j = alike(sigs, int((late == 0).sum()), least)
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            g.join(x, y)
        own = nodes.tolist()
        return [(own[i], own[g.find(i)]) for i in range(len(own)) if g.find(i) != i]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                cols = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(6)]
                new = [np.stack(cols[:4], 1), cols[4], cols[5], batch.column(6).flatten().to_numpy().reshape(-1, MINIMA)]
                held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if held is None:
                continue
            ends = (np.flatnonzero((held[0][1:] != held[0][:-1]).any(1)) + 1).tolist()
            if batch is None:
                ends.append(len(held[0]))
            edges, at = [], 0
            for end in ends:
                edges += group(*[x[at:end] for x in held[1:]])
                at = end
            held = [x[at:] for x in held]  # the last group may go on in the next batch
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["u", "v"])

    return run


def _regroup(spark, bands: DataFrame, heads: DataFrame, sig: DataFrame, odd: DataFrame, comps: DataFrame, least: int, rows: int) -> DataFrame:
    """Families, after the buckets in ``odd`` (band, key) were partitioned to the end."""
    bucket = ["band", "key"]
    odd = materialize(spark, odd, "minhash-odd")
    count, hub = odd.count(), hub_size(rows)
    every = bands.join(F.broadcast(odd), bucket) if count <= FEW else join_counted(bands, odd.join(heads.select(*bucket, "n"), bucket), bucket, "node", hub)
    mixed = materialize(spark, every, "minhash-buckets")
    release(spark, odd)
    for lead in (True, False):
        at = mixed.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
        per = at.groupBy(*bucket, "component").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("head"))
        # the only pair of a bucket of two has been judged; so has, in any bucket, the head with all others
        sized = per.groupBy(*bucket).agg(F.sum("n").alias("all"), F.min("head").alias("head"), F.max(F.struct("n", "component")).alias("m")).select(
            *bucket, F.col("all").alias("n"), "all", "head", F.col("m.component").alias("main"), F.ceil(F.col("all") / BLOCK).cast("int").alias("chunks"), F.ceil((F.col("all") - F.col("m.n")) / BLOCK).cast("int").alias("blocks"))
        dealt = join_counted(at, sized.where("all > 2 and blocks > 1" if lead else "all > 2 and blocks > 0"), bucket, "node", hub).where(F.lit(lead) | (F.col("all") > BLOCK) | (F.col("node") != F.col("head"))).join(sig, "node")
        dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        every = F.sequence(F.lit(0), F.col("chunks") - 1)
        if lead:  # a row of chunk 0 leads: it is compared with every chunk of its bucket
            dealt = dealt.withColumn("chunk", F.explode(F.when(F.col("chunk") == 0, every).otherwise(F.array("chunk")))).withColumn("block", F.lit(0)).withColumn("late", F.lit(0))
        else:  # what lies outside the largest family is compared with every chunk
            block = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")
            cell = lambda c, b, late: F.struct(c.alias("chunk"), b.alias("block"), F.lit(late).alias("late"))
            few = F.when(F.col("component") != F.col("main"), F.transform(every, lambda c: cell(c, block, 0))).otherwise(F.array().cast("array<struct<chunk:int,block:int,late:int>>"))
            many = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: cell(F.col("chunk"), b, 1))
            dealt = dealt.withColumn("_at", F.explode(F.concat(few, many))).select("*", "_at.block", "_at.late", F.col("_at.chunk").alias("_c")).drop("chunk").withColumnRenamed("_c", "chunk")
        keys = [*bucket, "chunk", "block"]
        parts = dealt.select(*keys, "late", "node", "sig").repartition(*keys).sortWithinPartitions(*keys, "late", "node")
        more = materialize(spark, parts.mapInArrow(_alike_batches(least), "u long, v long").where("u <> v"), "minhash-mixed")
        if not more.isEmpty():
            comps = merge_components(spark, comps, more, "minhash-family")
        release(spark, more)
    release(spark, mixed)
    return comps


def _few(ids: DataFrame, rows: int) -> DataFrame:
    """``ids``, to be broadcast if there are few."""
    return F.broadcast(ids) if rows <= FEW else ids


def _confirm(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Edges among the rows that share ``keys``; groups are bounded by the caller."""
    parts = rows.select(*keys, "node", "set").repartition(*keys).sortWithinPartitions(*keys, "node")
    return parts.mapInArrow(_link_batches(percent), "u long, v long").where("u <> v")


def near_duplicates(spark, docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; see the module's text."""
    ship_package(spark)
    small_batches(spark)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = materialize(spark, base.mapInArrow(_sign_batches(width), "doc_id long, n_shingles long, d0 long, d1 long, sig array<int>"), "minhash-signed")

    # one node per distinct set
    distinct = materialize(
        spark,
        signed.where("d0 is not null and doc_id is not null").groupBy("d0", "d1").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")),
        "minhash-distinct",
    )
    bands = distinct.select("node", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.xxhash64(F.slice("sig", j * ROWS + 1, F.lit(ROWS))))).alias("band", "key"))
    nodes = distinct.count()
    heads = bands.groupBy("band", "key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = materialize(spark, join_counted(bands, heads, ["band", "key"], "node", hub_size(BANDS * nodes)).where("node <> head").select("node", "head").distinct(), "minhash-heads")
    same = F.aggregate(F.zip_with("sig", "sig_h", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    ends = _few(stars.select(F.explode(F.array("node", "head")).alias("node")).distinct(), stars.count())
    sig = distinct.select("node", "sig").join(ends, "node", "left_semi")  # all nodes of buckets of two or more
    # of a star that fails, the buckets that both ends share
    both = F.filter(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.slice("sig", j * ROWS + 1, F.lit(ROWS)) == F.slice("sig_h", j * ROWS + 1, F.lit(ROWS)))
    judged = materialize(
        spark,
        stars.join(sig, "node").join(sig.select(F.col("node").alias("head"), F.col("sig").alias("sig_h")), "head").withColumn("like", same >= int(STAR * MINIMA))
        .select("node", "head", "like", F.when(~F.col("like"), F.transform(both, lambda j: F.struct(j.alias("band"), F.xxhash64(F.slice("sig", j * ROWS + 1, F.lit(ROWS))).alias("key")))).alias("odd")),
        "minhash-stars",
    )
    families = connected_components(spark, judged.where("like").select(F.col("node").alias("u"), F.col("head").alias("v")), "minhash-family")
    unlike = judged.where("not like")
    if not unlike.isEmpty():
        odd = unlike.select(F.explode("odd").alias("o")).select("o.band", "o.key").distinct()
        families = _regroup(spark, bands, heads, sig, odd, families, int(max(percent / 100 - MARGIN, 0) * MINIMA), BANDS * nodes)
    release(spark, judged, stars)

    # Full sets of family members; the family's size decides into how many chunks it is cut.
    members = families.join(distinct.select("node", "n"), "node").select("node", F.col("component").alias("family"), "n")
    sized = members.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("_t")).select(
        "family", "n", F.ceil(F.greatest(F.col("n") / CHUNK, F.col("_t") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    total = families.count()
    wanted = _few(join_counted(members.select("node", "family"), sized, ["family"], "node", hub_size(total)), total)
    texts = base.join(wanted, base["doc_id"] == wanted["node"]).select("node", "text", "family", "chunks")
    written = materialize(spark, texts.mapInArrow(_set_batches(width), "node long, family long, chunks int, set binary"), "minhash-sets")
    sets = written.where(F.length("set") > 0)

    order = F.xxhash64("node")
    sets = sets.withColumn("chunk", F.pmod(order, F.col("chunks")).cast("int"))
    # a row of chunk 0 leads: it is compared with every chunk of its family
    placed = sets.withColumn("chunk", F.explode(F.when(F.col("chunk") == 0, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("chunk"))))
    confirmed = _confirm(placed, ["family", "chunk"], percent)
    comps = connected_components(spark, confirmed, "minhash-component")
    if not sets.where("chunks > 1").isEmpty():
        more = materialize(spark, _residual_links(sets, comps, percent, written.count()), "minhash-residual")
        if not more.isEmpty():
            comps = merge_components(spark, comps, more, "minhash-component")
        release(spark, more)

    # Rows that share an id join its component; sets lead to nodes, nodes to components.
    shared = distinct.select("d0", "d1", "node").join(comps, "node", "left").select("d0", "d1", F.coalesce("component", "node").alias("component_id"))
    # empty sets have no d0 and meet nothing; their own ids spread them over the tasks
    out = signed.select("doc_id", "n_shingles", "d0", F.coalesce("d1", "doc_id").alias("d1")).join(shared, ["d0", "d1"], "left")
    out = _merge_shared_ids(spark, out, signed)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    result = materialize(spark, out.select("doc_id", "n_shingles", "component_id", kept.alias("kept")), "minhash-result")
    release(spark, signed, distinct, families, written, comps)
    return result


def _merge_shared_ids(spark, rows: DataFrame, signed: DataFrame) -> DataFrame:
    """Components of rows; rows with a null id have none, unlinked ones their own id."""
    own = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    rows = rows.withColumn("component_id", own)
    ids = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("d0", F.lit(0))).alias("lo"), F.max(F.coalesce("d0", F.lit(0))).alias("hi")).where("lo <> hi")
    if ids.isEmpty():
        return rows
    # an id with several texts ties the components of all of them together
    tied = rows.select("doc_id", "component_id").join(ids.select("doc_id"), "doc_id").select(F.col("doc_id").alias("u"), F.col("component_id").alias("v"))
    merged = connected_components(spark, tied, "minhash-ids").select(F.col("node").alias("component_id"), F.col("component").alias("_to"))
    return rows.join(merged, "component_id", "left").withColumn("component_id", F.coalesce("_to", "component_id")).drop("_to")


def _residual_links(sets: DataFrame, comps: DataFrame, percent: int, rows: int) -> DataFrame:
    """Links of split families between what lies outside the largest component and every chunk."""
    split = sets.where("chunks > 1")
    at = split.select("node", "family", "chunks").distinct().join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    per = at.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    main = per.groupBy("family").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"))
    rest = join_counted(at, main, ["family"], "node", hub_size(rows)).where("component <> main").select("node", "family")
    counts = rest.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("blocks"))
    left = split.join(rest.select("node"), "node", "left_semi").join(counts, "family")
    block = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")
    few = left.withColumn("block", block).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    many = split.join(counts, "family").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cols = ["family", "chunk", "block", "node", "set"]
    return _confirm(few.select(*cols).unionByName(many.select(*cols)), ["family", "chunk", "block"], percent)


def keep_one(spark, docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, all columns; of rows that repeat an id the smallest text stays.

    Documents without an id are linked with nothing and stay.  Equal texts of one id are told
    apart by a hash of the whole row.
    """
    gone = near_duplicates(spark, docs, width, percent, doc_id, text).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    gone = _few(gone, gone.count())
    out = docs.join(gone, docs[doc_id].cast("long") == gone["_gone"], "left_anti")
    twice = docs.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_twice")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_twice")
    if twice.isEmpty():
        return out
    several = out.join(twice, out[doc_id] == twice["_twice"], "left_semi")
    whole = F.struct(*[F.col(c) for c in docs.columns])
    first = several.groupBy(F.col(doc_id).alias("_id")).agg(F.min_by(whole, F.struct(F.coalesce(F.col(text), F.lit("")), F.xxhash64(*docs.columns))).alias("_row")).select("_row.*")
    return out.join(twice, out[doc_id] == twice["_twice"], "left_anti").unionByName(first)


def op10_minhash_large_small_star(spark, sf_dir: str) -> DataFrame:
    """Components of all documents that share 80 % of their two-word shingles."""
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2, percent=80)
