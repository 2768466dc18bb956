"""Near-duplicate vectors by a pivot-permutation index.

Every vector is described by its PREFIX nearest reference points (pivots), nearest first.
It is posted on the inverted lists of pairs of these pivots, for all pairs whose ranks
(from 0) add up to less than PREFIX: two near vectors see the same pivots in nearly the same
order, so they share a pair of early ranks, and lists of pairs stay short where lists of
single pivots would grow with the input.  On a list the pivots that two vectors share are
counted from their descriptions; pairs that share fewer than SHARED are dropped, and the rest
is verified by the cosine in double precision.  A pair that shares several lists counts on
the list of its smallest shared key, hence once.

Pivots are a bounded sample: vectors in hash order, thinned so that no two are closer than
APART (a large group of near copies must not supply its own pivots), one for every PER
vectors and at most MAX_PIVOTS; fewer than LEAST_PIVOTS are filled up by fixed random
directions.  Every vector is indexed.  Recall is below 1 by design and does not depend on
caps: a list longer than BLOCK is cut into blocks that meet pairwise, so no task holds more
than two blocks, and a list's vectors never leave it as pairs: a task returns a link count
and a root per vector.  Lists of one vector are dropped before vectors are copied to lists.

Equal vectors are one vector with a count before they are indexed.  Edge cases: vectors
that are null, empty, zero, hold null or non-finite components, have a null id or a length
other than the most frequent one link with nothing; of pivots at equal distances the one
drawn first is nearer; vectors that share an id form one node of the component; repeated rows
count as vectors of their own; an empty table gives an empty result; columns other than id
and vector are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromalake.llm.components import connected_components, hub_size, join_counted
from chromalake.runtime import materialize, release, ship_package

PREFIX, SHARED = 12, 3
PER, MAX_PIVOTS, LEAST_PIVOTS, APART = 16, 8192, 64, 0.5
BLOCK = 1024
#: Lists up to this length are judged together, longer ones one by one.
SHORT = 48
_CHUNK = 1 << 14


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def thin(sample: np.ndarray, want: int) -> np.ndarray:
    """The first vectors of a sample that are pairwise no closer than APART; at least LEAST_PIVOTS directions."""
    x, out = unit(sample), []
    free = np.ones(len(x), bool)
    for i in range(len(x)):
        if free[i]:
            out.append(i)
            if len(out) == want:
                break
            free[i + 1 :] &= x[i + 1 :] @ x[i] < APART
    more = np.random.default_rng(11).normal(size=(max(0, LEAST_PIVOTS - len(out)), x.shape[1]))
    return np.concatenate([x[out], unit(more)])


def describe(vec: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The PREFIX nearest pivots of each vector, nearest first."""
    near = unit(vec) @ pivots.T
    top = np.sort(np.argpartition(-near, PREFIX - 1, axis=1)[:, :PREFIX], axis=1)
    order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
    return np.take_along_axis(top, order, 1).astype(np.int32)


#: Ranks whose pivots make a key.
RANKS = [(i, j) for i in range(PREFIX) for j in range(i + 1, PREFIX) if i + j < PREFIX]


def list_keys(prefix: np.ndarray) -> np.ndarray:
    """The keys of the lists that each description is posted on."""
    a, b = prefix[:, [i for i, _ in RANKS]].astype(np.int64), prefix[:, [j for _, j in RANKS]].astype(np.int64)
    return np.minimum(a, b) << 32 | np.maximum(a, b)


def _describe(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), kind))
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                vec = part.column(4)
                top = describe(np.asarray(vec.flatten(), np.float64).reshape(len(vec), -1), pivots)
                yield pa.RecordBatch.from_arrays([*part.columns, lists(top, pa.int32()), lists(list_keys(top), pa.int64())], ["h1", "h2", "node", "n", "vec", "prefix", "keys"])

    return run


def _bits(x: np.ndarray, use: np.ndarray | None = None) -> np.ndarray:
    """Rows of ``x`` (those entries that ``use`` marks) as bit sets over the values that occur twice or more."""
    value, at, count = np.unique(x, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    at = at.reshape(x.shape)
    row, col = np.nonzero((count > 1)[at] if use is None else (count > 1)[at] & use)
    bit = number[at[row, col]]
    out = np.zeros((len(x), (int((count > 1).sum()) + 63) // 64), np.uint64)
    np.bitwise_or.at(out, (row, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
    return out


def _near(vec: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Which pairs have a cosine of ``least`` or more."""
    out = np.zeros(len(i), bool)
    norm = np.linalg.norm(vec, axis=1)
    for a in range(0, len(i), _CHUNK):
        x, y = i[a : a + _CHUNK], j[a : a + _CHUNK]
        out[a : a + _CHUNK] = np.einsum("ij,ij->i", vec[x], vec[y]) / (norm[x] * norm[y]) >= least
    return out


def long_links(vec: np.ndarray, prefix: np.ndarray, block: np.ndarray, key: int, cross: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (i, j) of a long list that count there; memory is a few bytes a pair of rows."""
    bits = _bits(prefix)
    shared = np.zeros((len(vec), len(vec)), np.uint8)
    for w in bits.T:
        shared += np.bitwise_count(w[:, None] & w[None, :])
    cand = np.triu(shared >= SHARED, 1)
    if cross:
        cand &= block[:, None] != block[None, :]
    keys = list_keys(prefix)
    for w in _bits(keys, keys < key).T:  # those count on a list of a smaller key
        cand &= (w[:, None] & w[None, :]) == 0
    if 16 * np.count_nonzero(cand) > cand.size:
        norm = np.linalg.norm(vec, axis=1)
        return np.nonzero(cand & ((vec @ vec.T) / (norm[:, None] * norm[None, :]) >= least))
    i, j = np.nonzero(cand)
    ok = _near(vec, i, j, least)
    return i[ok], j[ok]


def short_links(vec: np.ndarray, prefix: np.ndarray, block: np.ndarray, where: np.ndarray, end: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The same for many short lists at once: ``where`` has each row's (key, lo, hi), ``end`` the end of its list."""
    row = np.arange(len(vec))
    found: list[tuple[np.ndarray, np.ndarray]] = [(row[:0], row[:0])]
    for step in range(1, SHORT):
        every = np.flatnonzero(row + step < end)
        if not len(every):
            break
        for a in range(0, len(every), _CHUNK):
            i = every[a : a + _CHUNK]
            j = i + step
            ok = (where[i, 1] == where[i, 2]) | (block[i] != block[j])
            ok &= (prefix[i][:, :, None] == prefix[j][:, None, :]).any(2).sum(1) >= SHARED
            i, j = i[ok], j[ok]
            ok = _near(vec, i, j, least)
            i, j = i[ok], j[ok]
            for c in range(0, len(i), 1 << 12):
                x, y = i[c : c + (1 << 12)], j[c : c + (1 << 12)]
                own, other = list_keys(prefix[x]), list_keys(prefix[y])
                both = (own[:, :, None] == other[:, None, :]).any(2)
                first = np.where(both, own, np.iinfo(np.int64).max).min(1) == where[x, 0]
                found.append((x[first], y[first]))
    return tuple(np.concatenate(f) for f in zip(*found, strict=True))


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n rows reaches by links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _judge(least: float):
    names = ["h1", "h2", "node", "links", "root"]

    def lists(where, ids, block, vec, prefix) -> pa.RecordBatch | None:
        """Rows of whole lists, in order -> (h1, h2, node, links, root) of rows with a link."""
        cut = np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1
        start = np.concatenate([[0], cut])
        stop = np.concatenate([cut, [len(where)]])
        size = stop - start
        long = size > SHORT
        few = np.flatnonzero(np.repeat(~long, size))
        end = np.repeat(np.cumsum(np.where(long, 0, size)), size)[few]
        i, j = short_links(vec[few], prefix[few], block[few], where[few], end, least)
        pairs = [(few[i], few[j])]
        for a, b in zip(start[long], stop[long], strict=True):
            i, j = long_links(vec[a:b], prefix[a:b], block[a:b], int(where[a, 0]), where[a, 1] != where[a, 2], least)
            pairs.append((i + a, j + a))
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        if not len(i):
            return None
        n = ids[:, 3]
        count = (np.bincount(i, n[j], len(n)) + np.bincount(j, n[i], len(n))).astype(np.int64)
        root = _roots(len(n), i, j)
        hit = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[hit, 0], ids[hit, 1], ids[hit, 2], count[hit], ids[root[hit], 2])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                col = {c: batch.column(c) for c in batch.schema.names}
                whole = lambda cs: np.stack([col[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in cs], 1)
                new = [whole(("key", "lo", "hi")), whole(("h1", "h2", "node", "n")), whole(("block",))[:, 0],
                       np.asarray(col["vec"].flatten(), np.float64).reshape(batch.num_rows, -1), np.asarray(col["prefix"].flatten(), np.int32).reshape(batch.num_rows, -1)]
                held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if held is None or not len(held[0]):
                continue
            at = len(held[0])
            if batch is not None:  # the last list may go on in the next batch
                differ = np.flatnonzero((held[0] != held[0][-1]).any(1))
                at = int(differ[-1]) + 1 if len(differ) else 0
            if at and (out := lists(*[x[:at] for x in held])) is not None:
                yield out
            held = [x[at:] for x in held]

    return run


def near_vectors(spark, vectors: DataFrame, least: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding", max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; see the module's text."""
    ship_package(spark)
    v = F.col("vec")
    base = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("vec"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(odd, F.lit(True)) & F.exists(v, lambda x: x != 0)
    # squares must not vanish or overflow either
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    ok = F.coalesce(whole & (norm > 0) & (norm < float("inf")), F.lit(False))
    keyed = base.withColumn("ok", ok).withColumns({"h1": F.when(F.col("ok"), F.xxhash64("vec")), "h2": F.when(F.col("ok"), F.xxhash64("vec", F.lit(1)))})
    sizes = keyed.where("ok").groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("c").desc(), "d").limit(1).collect()
    if not sizes:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dim = sizes[0]["d"]
    distinct = materialize(spark, keyed.where(F.col("ok") & (F.size("vec") == dim)).groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec")), "pivot-distinct")
    total = distinct.count()
    want = max(min(max_pivots, total // PER), min(total, LEAST_PIVOTS))
    sample = distinct.orderBy(F.xxhash64("h1", F.lit(5)), "h2").select("vec").limit(2 * want).toArrow()["vec"].combine_chunks()  # 2 x max_pivots at most
    pivots = thin(np.asarray(sample.flatten(), np.float64).reshape(len(sample), -1), want)
    fields = [T.StructField("prefix", T.ArrayType(T.IntegerType())), T.StructField("keys", T.ArrayType(T.LongType()))]
    described = materialize(spark, distinct.mapInArrow(_describe(pivots), T.StructType([*distinct.schema.fields, *fields])), "pivot-lists")
    # which lists a vector meets others on, and into how many blocks these are cut, from narrow rows
    posted = described.select("h1", "h2", F.explode("keys").alias("key"))
    lists = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    met = join_counted(posted, lists, ["key"], "h1", hub_size(total * len(RANKS))).groupBy("h1", "h2").agg(F.collect_list(F.struct("key", "blocks")).alias("lists"))
    rows = described.drop("keys").join(met, ["h1", "h2"]).select("*", F.explode("lists").alias("l")).select("*", "l.key", "l.blocks")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("h1", F.lit(3)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["key", "lo", "hi"]
    rows = rows.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).select(*keys, "h1", "h2", "node", "n", "block", "vec", "prefix")
    judged = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_judge(least), "h1 long, h2 long, node long, links long, root long")
    judged = materialize(spark, judged, "pivot-links")
    comps = connected_components(spark, judged.select(F.col("node").alias("u"), F.col("root").alias("v")), "pivot-components")
    counts = judged.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    known = distinct.select("h1", "h2", "node", "n").join(counts, ["h1", "h2"], "left").join(comps, "node", "left").select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    # vectors that cannot link have no hashes; their ids spread them over the tasks
    out = keyed.select("vec_id", "h1", F.coalesce("h2", "vec_id").alias("h2")).join(known, ["h1", "h2"], "left")
    own = F.coalesce("component_id", "vec_id")
    result = materialize(spark, out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept")), "pivot-result")
    release(spark, distinct, described, judged, comps)
    return result


def op6_pivot_permutation(spark, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.9."""
    return near_vectors(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
