"""MinHash near-duplicates: ProbMinHash signatures of weighted shingles, banding, exact verification.

A document's shingles are its runs of five words (one shingle of all words if it has fewer), weighted by how often they
occur. For each shingle a Poisson process, seeded by the shingle and with its weight as rate, deals arrivals to the
registers; a register keeps its earliest arrival's shingle. Arrivals later than all registers end a shingle's process early.
The share of equal registers estimates the probability Jaccard similarity, which verification computes exactly.

Links are found without all pairs of a bucket: texts with the same words are one class; in each bucket members are compared
with its smallest id, and what then still lies in different components is compared exactly, in tiles of bounded size that
give off at most a link a document. So no link that banding finds between different components is lost.

Null, empty and wordless texts link with nothing. Repeated rows (same id and text) are one document: near_duplicates has a row
for each of them, deduplicated keeps one. Ties go to the smallest id.
Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylex.llm.base import Slice, attach, materialise, mix64, pick, semi, slices, words
from quarrylex.llm.components import components

SHINGLE = 5
_C = mix64(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
_K = mix64(np.arange(101, 103, dtype=np.uint64)) | np.uint64(1)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes with their document, hashes of all words, and each document's bounds among the words."""
    starts, _, h = words(s)
    bounds = np.searchsorted(starts, s.off)
    n = len(h)
    if n >= SHINGLE:
        total = np.zeros(n - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            total += h[k : n - SHINGLE + 1 + k] * _C[k]
        doc = np.repeat(np.arange(s.n), np.diff(bounds))
        whole = doc[: n - SHINGLE + 1] == doc[SHINGLE - 1 :]
        hashes, owner = mix64(total[whole]), doc[: n - SHINGLE + 1][whole]
    else:
        hashes, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = np.diff(bounds)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        extra = [mix64((h[bounds[d] : bounds[d + 1]] * _C[: count[d]]).sum(dtype=np.uint64, keepdims=True) + np.uint64(count[d]))[0] for d in short]
        hashes, owner = np.concatenate([hashes, np.asarray(extra, np.uint64)]), np.concatenate([owner, short])
    return hashes, owner, h, bounds


def weighted(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document with their counts."""
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return hashes[first], owner[first], np.diff(np.append(first, len(hashes)))


def signatures(hashes: np.ndarray, owner: np.ndarray, weight: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """[docs, registers] of the shingles that arrive first; registers is a power of two."""
    time = np.full(docs * registers, np.inf)
    winner = np.zeros(docs * registers, np.uint64)
    limit = np.full(docs, np.inf)
    t, h, d, w = np.zeros(len(hashes)), hashes, owner.astype(np.int64), weight
    turn = 0
    while len(h):
        turn += 1
        x = mix64(h + np.asarray([turn], np.uint64) * _GOLD)
        t = t - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w
        early = t < limit[d]  # the rest can't win a register any more
        t, h, d, w, x = t[early], h[early], d[early], w[early], x[early]
        slot = d * registers + (mix64(x + _GOLD) & np.uint64(registers - 1)).astype(np.int64)
        before = time[slot]
        np.minimum.at(time, slot, t)
        won = (t == time[slot]) & (t < before)
        winner[slot[won]] = h[won]
        limit = time.reshape(docs, registers).max(1)
        early = t < limit[d]
        t, h, d, w = t[early], h[early], d[early], w[early]
    return winner.reshape(docs, registers)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two sets of (sorted hashes, weights).

    The sum over common elements d of 1 / sum over e of max(x_e / x_d, y_e / y_d). With the ratio q = y / x of d, the inner
    maximum is x_e / x_d where y_e / x_e <= q and y_e / y_d elsewhere, so that sums over elements sorted by ratio suffice.
    """
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    common, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = wa[ia].astype(np.float64), wb[ib].astype(np.float64)
    only_a, only_b = float(wa.sum()) - x.sum(), float(wb.sum()) - y.sum()
    ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    below, above = np.cumsum(x), y.sum() - np.cumsum(y)  # elements up to each place; those after it
    return float((1 / ((only_a + below) / x + (only_b + above) / y)).sum())


SIGNED = "doc_id bigint, n_words bigint, k1 bigint, k2 bigint, bands array<bigint>"


def sign(docs: DataFrame, bands: int = 16, rows: int = 4) -> DataFrame:
    """doc_id, n_words, 128-bit hash of the word sequence, and a hash for each band of the signature."""
    registers = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(1)):
                hashes, owner, h, bounds = shingles(s)
                n = np.diff(bounds)
                place = (np.arange(len(h)) - np.repeat(bounds[:-1], n)).astype(np.uint64)
                keys = []
                for c in _K:
                    total = np.zeros(len(h) + 1, np.uint64)
                    np.cumsum(mix64(h * c + place * _GOLD), dtype=np.uint64, out=total[1:])
                    keys.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
                won = signatures(*weighted(hashes, owner), s.n, registers)
                band = np.zeros((s.n, bands), np.uint64)
                for r, step in enumerate(np.arange(1, rows + 1, dtype=np.uint64) * _GOLD):
                    band = mix64(band + won[:, r::rows] + step)
                band = mix64(band + np.arange(bands, dtype=np.uint64))
                offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(band[n > 0].reshape(-1).view(np.int64)))
                yield pa.record_batch([batch.column(0)[s.lo : s.hi], pa.array(n.astype(np.int64)), pa.array(keys[0]), pa.array(keys[1]), column], names=["doc_id", "n_words", "k1", "k2", "bands"])

    return pick(docs, "doc_id", "text").mapInArrow(run, SIGNED)


def similarities(pairs: DataFrame) -> DataFrame:
    """(a, b, similarity) of rows (a, b, text_a, text_b), computed exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            last: tuple[str | None, tuple | None] = (None, None)
            for i in range(batch.num_rows):
                sets = []
                for column in (2, 3):
                    text = batch.column(column)[i].as_py()
                    if column == 2 and text == last[0]:
                        sets.append(last[1])
                        continue
                    s = next(slices(pa.array([text], pa.string())))
                    hashes, owner, _, _ = shingles(s)
                    h, _, w = weighted(hashes, owner)
                    sets.append((h, w))
                    if column == 2:
                        last = (text, (h, w))
                out[i] = probability_jaccard(*sets)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out)], names=["a", "b", "similarity"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint, similarity double")


def _verified(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The written pairs (a, b) that are similar enough; only texts that stand in a pair are moved."""
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "pair-ids")
    texts = semi(pick(docs, "doc_id", "text"), ids, "doc_id", ids.count())
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return materialise(similarities(both).where(F.col("similarity") >= threshold).select("a", "b"), "links")


def tile_links(ids: np.ndarray, roots: np.ndarray, texts: pa.Array, threshold: float, columns: int = 4096) -> list[tuple[int, int]]:
    """Links that unite the components of some documents: every pair across components is compared exactly or is united by then.

    Common shingles are counted by products of incidence matrices, in blocks of columns. They give the similarity of texts
    without repeated shingles, and an upper bound for others: a common shingle adds at most its share of either text.
    """
    hashes, owners, weights, base = [], [], [], 0
    for s in slices(texts):
        h, o, w = weighted(*shingles(s)[:2])
        hashes.append(h), owners.append(o + base), weights.append(w)
        base += s.n
    h, o, w = np.concatenate(hashes), np.concatenate(owners), np.concatenate(weights).astype(np.float64)
    n = len(ids)
    size, total = np.bincount(o, minlength=n), np.bincount(o, weights=w, minlength=n)
    plain = np.bincount(o, weights=w > 1, minlength=n) == 0
    _, column, count = np.unique(h, return_inverse=True, return_counts=True)
    at = np.full(len(count), -1)
    at[count > 1] = np.arange((count > 1).sum())
    at = at[column]
    common, bound = np.zeros((n, n), np.float32), np.zeros((n, n))
    for lo in range(0, int(at.max(initial=-1)) + 1, columns):
        use = (at >= lo) & (at < lo + columns)
        there = np.zeros((n, columns), np.float32)
        there[o[use], at[use] - lo] = 1
        common += there @ there.T
        if not plain.all():
            share = np.zeros((n, columns), np.float32)
            share[o[use], at[use] - lo] = w[use] / total[o[use]]
            bound += share @ there.T
    lab = np.unique(roots, return_inverse=True)[1]
    union = size[:, None] + size[None, :] - common
    sure = plain[:, None] & plain[None, :]
    link = sure & (common >= threshold * union - 1e-6) & (union > 0)
    out: list[tuple[int, int]] = []

    def unite(i: int, j: int) -> None:
        out.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
        lab[lab == lab[j]] = lab[i]

    for i in range(n):
        while len(js := np.flatnonzero(link[i] & (lab != lab[i]))):
            unite(i, int(js[0]))
    if not plain.all():
        maybe = ~sure & (np.minimum(bound, bound.T) >= threshold - 1e-4)
        order = np.argsort(o, kind="stable")
        ends = np.searchsorted(o[order], np.arange(n + 1))
        sets = [(h[order[x:y]], w[order[x:y]]) for x, y in zip(ends[:-1], ends[1:], strict=True)]
        for i in range(n):
            for j in np.flatnonzero(maybe[i] & (np.arange(n) > i)).tolist():
                if lab[i] != lab[j] and probability_jaccard(sets[i], sets[j]) >= threshold:
                    unite(i, j)
    return out


def _tiles(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        text = t["text"].combine_chunks() if isinstance(t["text"], pa.ChunkedArray) else t["text"]
        pairs = tile_links(t["rep"].to_numpy(), t["root"].to_numpy(), text, threshold)
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return run


def _crossing(at: DataFrame, docs: DataFrame, threshold: float, part: int = 256) -> DataFrame | None:
    """Links (a, b) between components that meet in a bucket, from rows (bucket, rep, w, root); None if no bucket is split.

    w: a text's size, 1 for each thousand words. The members of a bucket's largest component needn't be compared with each
    other. The others, in parts of bounded size,
    meet each other's parts and those of the largest component, a tile each. Buckets with the same members count once.
    """
    by_root = at.groupBy("bucket", "root").agg(F.sum("w").alias("n"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("f"))
    split = by_root.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("m"), F.max("n").alias("top"), F.max_by("root", F.struct("n", "root")).alias("bulk"), F.sum("f").alias("f")).where("k > 1")
    split = materialise(split.groupBy("m", "f").agg(F.min(F.struct("bucket", "top", "bulk")).alias("s")).select("m", "s.*"), "split")
    n = split.count()
    if not n:
        return None
    one = F.col("m") <= 2 * part
    strays, bulks = F.greatest(F.ceil((F.col("m") - F.col("top")) / part), F.lit(1)).cast("int"), F.greatest(F.ceil(F.col("top") / part), F.lit(1)).cast("int")
    tile = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    p = F.col("p")
    among = F.transform(F.sequence(F.lit(0), F.col("strays") - 1), lambda q: tile(F.least(p, q), F.greatest(p, q)))
    against = F.transform(F.sequence(F.lit(0), F.col("bulks") - 1), lambda q: tile(p, F.col("strays") + q))
    down = F.transform(F.sequence(F.lit(0), F.col("strays") - 1), lambda q: tile(q, F.col("strays") + p))
    rows = attach(at, split, "bucket", n).withColumn("strays", strays).withColumn("bulks", bulks)
    rows = rows.withColumn("p", F.pmod(F.xxhash64("rep", F.lit(5)), F.when(F.col("root") == F.col("bulk"), F.col("bulks")).otherwise(F.col("strays"))).cast("int"))
    where = F.when(one, F.array(tile(F.lit(0), F.lit(0)))).when(F.col("root") == F.col("bulk"), down).otherwise(F.concat(among, against))
    dealt = materialise(rows.select("bucket", "rep", "root", F.explode(where).alias("t")).select("bucket", "t.lo", "t.hi", "rep", "root"), "tiles")
    ids = materialise(dealt.select(F.col("rep").alias("doc_id")).distinct(), "tile-ids")
    texts = semi(pick(docs, "doc_id", "text"), ids, "doc_id", ids.count()).select(F.col("doc_id").alias("rep"), "text").dropDuplicates(["rep"])
    found = dealt.join(texts, "rep").select("bucket", "lo", "hi", "rep", "root", "text").groupBy("bucket", "lo", "hi").applyInArrow(_tiles(threshold), "a bigint, b bigint")
    return materialise(found.distinct(), "tile-links")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 16, rows: int = 4) -> DataFrame:
    """doc_id, class_id (smallest id that links reach), kept (the document stands for its class)."""
    signed = materialise(sign(docs, bands, rows), "signatures")
    # texts with the same words are one class from the start
    exact = materialise(signed.where("n_words > 0").groupBy("k1", "k2", "n_words").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "exact")
    flat = exact.select("rep", F.ceil(F.col("n_words") / 1000).alias("w"), F.explode("bands").alias("bucket"))
    shared = materialise(flat.groupBy("bucket").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "lead"), "buckets")
    member = materialise(attach(flat, shared, "bucket", shared.count()).select("bucket", "rep", "w", "lead"), "members")
    # first each member with its bucket's smallest id, then what still lies in different components of a bucket
    pairs = materialise(member.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    links = _verified(pairs, docs, threshold)
    comp = components(links)
    at = attach(member.select("bucket", "rep", "w"), comp.select(F.col("node").alias("rep"), "root"), "rep", comp.count(), "left").withColumn("root", F.coalesce("root", "rep"))
    more = _crossing(at, docs, threshold)
    if more is not None:
        comp = components(links.unionByName(more))
    roots = exact.join(comp.select(F.col("node").alias("rep"), "root"), "rep", "left").select("k1", "k2", "n_words", F.coalesce("root", "rep").alias("root"))
    # wordless texts, perhaps a large share, have no class to look up
    some = signed.where("n_words > 0").select("doc_id", "k1", "k2", "n_words").join(roots, ["k1", "k2", "n_words"], "left").select("doc_id", F.col("root").alias("class_id"))
    out = some.unionByName(signed.where("n_words = 0").select("doc_id", F.col("doc_id").alias("class_id")))
    return out.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """The documents that stand for their class, with their own columns; one row for each id and text."""
    seen = near_duplicates(docs, **how).groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    seen = materialise(seen.where("not kept or kept and n > 1"), "duplicates")
    again = seen.where("kept").select("doc_id")
    n, n_again = seen.count(), again.count()
    # only the rows of repeated ids are shuffled with their texts
    once = attach(docs, seen.select("doc_id"), "doc_id", n, "left_anti")
    return once.unionByName(semi(docs, again, "doc_id", n_again).dropDuplicates(["doc_id", "text"])) if n_again else once
