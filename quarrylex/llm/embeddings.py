"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

Vectors are normalised in double precision. Each table applies several random rotations (signs and Hadamard transforms,
three rounds); a rotation's hash is the signed axis nearest to the vector, a table's bucket joins its hashes. A vector also
stands in the buckets of its nearest misses. The number of tables follows from the hashes and the width, so that a pair at
the threshold is missed as rarely in a large table or with wide vectors as elsewhere. Identical vectors are collapsed to one weighted representative, buckets with
the same members are compared once, and large buckets are cut into tiles of bounded size. In a tile all pairs are verified
by one matrix product; a pair counts in its smallest common bucket only, and what leaves a tile is a sum of links and a
local root per vector, never pairs. Components of the local roots give the classes.

Vectors that are null, of zero length, all zero, or hold null or non-finite components link with nothing; vectors of
different dimensions never link. Repeated rows count as separate, identical vectors. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylex.llm.base import attach, materialise, mix64
from quarrylex.llm.components import components

#: Smallest and largest side of a tile in vectors, and the copies of a vector up to which sides grow with the bucket.
SIDE, WIDEST, COPIES = 512, 4096, 32
#: Largest chance that a pair at the threshold shares no bucket.
MISS = 0.0005


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        y = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and a Hadamard transform; dimensions are padded to a power of two."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (3, width))
    for s in signs:
        y = hadamard(y * s)
    return y


def buckets(x: np.ndarray, tables: int, hashes: int, probes: int) -> np.ndarray:
    """[vectors, tables * (1 + probes)] bucket ids; the first of each table is the main one."""
    n, out = len(x), []
    for t in range(tables):
        first, second, loss = [], [], []
        for k in range(hashes):
            y = rotated(x, 7919 * t + k)
            size = np.abs(y)
            top = np.argpartition(-size, 1, axis=1)[:, :2]
            vals = np.take_along_axis(size, top, 1)
            swap = vals[:, 0] < vals[:, 1]
            top[swap], vals[swap] = top[swap][:, ::-1], vals[swap][:, ::-1]
            code = top * 2 + (np.take_along_axis(y, top, 1) < 0)
            first.append(code[:, 0])
            second.append(code[:, 1])
            loss.append(vals[:, 0] - vals[:, 1])
        first, second, loss = np.stack(first, 1), np.stack(second, 1), np.stack(loss, 1)
        order = np.argsort(loss, axis=1, kind="stable")
        for p in range(1 + min(probes, hashes)):
            code = first.copy()
            if p:
                code[np.arange(n), order[:, p - 1]] = second[np.arange(n), order[:, p - 1]]
            key = np.full(n, (t + 1) << 32 | x.shape[1], np.uint64)
            for k in range(hashes):
                key = mix64(key + code[:, k].astype(np.uint64))
            out.append(key)
    return np.stack(out, 1).view(np.int64)


@lru_cache
def tables_for(width: int, hashes: int, probes: int, threshold: float) -> int:
    """Tables (8 at least) with which a pair at the threshold meets in none with a chance of MISS at most.

    Rotations are random, so that every such pair has about the same chance to meet in one table; it is counted on drawn pairs.
    """
    rng, n = np.random.default_rng(5), 1000
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.normal(size=(2, n, width)))
    b -= (a * b).sum(1, keepdims=True) * a
    b = threshold * a + np.sqrt(max(0.0, 1 - threshold * threshold)) * b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
    x, y = (buckets(v, 2, hashes, probes).reshape(n, 2, -1) for v in (a, b))
    p = (x[:, :, :, None] == y[:, :, None, :]).any((2, 3)).mean()
    p = min(max(p - 2 * np.sqrt(p * (1 - p) / (2 * n)), 0.01), 0.9999)  # two standard errors on the safe side
    return max(8, int(np.ceil(np.log(MISS) / np.log(1 - p))))


def matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, normalised rows) of each dimension; rows that link with nothing are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lists = column.cast(pa.list_(pa.float64()))
    size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    out = []
    for d in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == d)
        x = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        with np.errstate(all="ignore"):
            x = x / np.abs(x).max(1, keepdims=True)  # so that no square over- or underflows
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
        ok = np.isfinite(x).all(1)
        out.append((rows[ok], x[ok]))
    return out


HASHED = "vec_id bigint, k1 bigint, k2 bigint, vector binary, keys array<bigint>"


def hashed(vectors: DataFrame, tables: int | None, hashes: int, probes: int, threshold: float) -> DataFrame:
    """Each vector's id, 128-bit hash of its direction, normalised components and bucket ids (null: links with nothing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                n = batch.num_rows
                k1, k2, data, keys = [None] * n, [None] * n, [None] * n, [None] * n
                for rows, x in matrix(batch.column(1)):
                    if not len(rows):
                        continue
                    bits = (x + 0.0).view(np.uint64)
                    place = mix64(np.arange(x.shape[1], dtype=np.uint64) + np.uint64(x.shape[1] << 20))
                    one, two = (mix64(bits * np.uint64(2 * s + 1) + place + np.uint64(s)).sum(1, dtype=np.uint64).view(np.int64) for s in (11, 97))
                    width = 1 << max(1, (x.shape[1] - 1).bit_length())
                    found = buckets(x, tables or tables_for(width, hashes, probes, threshold), hashes, probes)
                    for i, r in enumerate(rows.tolist()):
                        k1[r], k2[r], data[r], keys[r] = int(one[i]), int(two[i]), x[i].tobytes(), np.unique(found[i])
                yield pa.record_batch([batch.column(0), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(data, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["vec_id", "k1", "k2", "vector", "keys"])

    return vectors.select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(run, HASHED)


TILED = "vec_id bigint, links bigint, root bigint"


def tile_links(ids: np.ndarray, weight: np.ndarray, side: np.ndarray, x: np.ndarray, keys: list[np.ndarray], bucket: int, threshold: float, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Weighted links of each vector in one tile, and its root among the tile's links.

    side: 0 and 1 for the two halves of an off-diagonal tile (only pairs across count), 2 where all pairs count. A pair that
    shares a smaller bucket has been or will be counted there. Besides one bit map of the pairs, memory is block rows wide.
    """
    n = len(ids)
    a, b = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if (side < 2).any() else (np.arange(n), np.arange(n))
    link = np.zeros((len(a), len(b)), bool)
    for lo in range(0, len(a), block):
        link[lo : lo + block] = (x[a[lo : lo + block]] @ x[b].T) >= threshold
    if a is not b and len(a) == n:
        np.fill_diagonal(link, False)
    count = link.copy()
    rows, earlier = [], []
    for i, k in enumerate(keys):
        k = k[k < bucket]
        rows += [i] * len(k)
        earlier += k.tolist()
    if earlier:
        at_a, at_b = np.full(n, -1), np.full(n, -1)
        at_a[a], at_b[b] = np.arange(len(a)), np.arange(len(b))
        rows, (_, at, number) = np.asarray(rows), np.unique(np.asarray(earlier), return_inverse=True, return_counts=True)
        order = np.argsort(at, kind="stable")
        for run in np.split(order, np.cumsum(number)[:-1]):
            if len(run) > 1:
                i, j = at_a[rows[run]], at_b[rows[run]]
                count[np.ix_(i[i >= 0], j[j >= 0])] = False
    links = np.zeros(n)
    links[a] += count @ weight[b]
    if (side < 2).any():
        links[b] += weight[a] @ count
    root = np.arange(n)
    while True:  # smallest id by links, ids being sorted
        low = root.copy()
        for lo in range(0, len(a), block):
            part = link[lo : lo + block]
            low[a[lo : lo + block]] = np.minimum(low[a[lo : lo + block]], np.where(part, root[b][None, :], n).min(1, initial=n))
            low[b] = np.minimum(low[b], np.where(part, root[a[lo : lo + block]][:, None], n).min(0, initial=n))
        low = low[low]
        if (low == root).all():
            break
        root = low
    return links, ids[root]


def _tiles(threshold: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table["vec_id"].to_numpy(), kind="stable")
        t = table.take(pa.array(order)).combine_chunks()
        ids = t["vec_id"].to_numpy()
        raw = t["vector"].to_pylist()
        x = np.stack([np.frombuffer(v, np.float64) for v in raw])
        lo, hi = key[1].as_py(), key[2].as_py()
        salt = t["salt"].to_numpy()
        side = np.full(len(ids), 2) if lo == hi else (salt == hi).astype(np.int64)
        keys = [k.values.to_numpy() for k in t["keys"]]
        links, root = tile_links(ids, t["n"].to_numpy(), side, x, keys, key[0].as_py(), threshold)
        return pa.table({"vec_id": ids, "links": links.astype(np.int64), "root": root})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, tables: int | None = None, probes: int = 2, hashes: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding)."""
    if hashes is None:  # so that few vectors share a bucket by chance, at any size: 128 buckets and more a hash
        rows = vectors.count()
        hashes = max(2, int(np.ceil(np.log(max(rows, 2)) / np.log(128))))
    signed = materialise(hashed(vectors, tables, hashes, probes, threshold), "hashed")
    live = signed.where("k1 is not null")
    reps = materialise(live.groupBy("k1", "k2").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector"), F.first("keys").alias("keys")), "reps")
    member = reps.select("vec_id", F.explode("keys").alias("bucket"))
    same = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("vec_id").cast("decimal(38,0)")).alias("f"), F.sum(F.xxhash64("vec_id", F.lit(1)).cast("decimal(38,0)")).alias("g")).where("m > 1")
    kept = materialise(same.groupBy("m", "f", "g").agg(F.min("bucket").alias("bucket")).select("bucket", "m"), "buckets")
    n_kept = kept.count()
    held = attach(member, kept, "bucket", n_kept)
    full = reps.select("vec_id", "n", "vector").join(held.groupBy("vec_id").agg(F.sort_array(F.collect_set("bucket")).alias("keys"), F.collect_list(F.struct("bucket", "m")).alias("at")), "vec_id")
    # a bucket's vectors are copied to as many tiles as it has sides: sides grow with it, so that copies don't until they are widest
    parts = F.ceil(F.col("m") / F.least(F.lit(WIDEST), F.greatest(F.lit(SIDE), F.ceil(F.col("m") / COPIES)))).cast("int")
    dealt = (
        full.select("vec_id", "n", "vector", "keys", F.explode("at").alias("at")).select("vec_id", "n", "vector", "keys", "at.bucket", "at.m")
        .withColumn("parts", parts)
        .withColumn("salt", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("bucket", F.least("salt", "other").alias("lo"), F.greatest("salt", "other").alias("hi"), "salt", "vec_id", "n", "vector", "keys")
    )
    found = materialise(dealt.groupBy("bucket", "lo", "hi").applyInArrow(_tiles(threshold), TILED), "tiles")
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    comp = components(found.where("vec_id <> root").select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    side = reps.select("k1", "k2", "vec_id", "n").join(links, "vec_id", "left").join(comp.select(F.col("node").alias("vec_id"), "root"), "vec_id", "left")
    side = side.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    out = signed.select("vec_id", "k1", "k2").join(side, ["k1", "k2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
