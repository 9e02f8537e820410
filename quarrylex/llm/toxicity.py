"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A linear model of hashed words and word beginnings scores each sentence; a noisy-or with a
leak combines the scores to the document's probability, 1 - (1 - leak) * prod(1 - p). Only document labels train it: the
gradient of the noisy-or gives each sentence its share of the blame, so that the same scores locate the offending sentences.
How strongly weights are held near 0 (the ridge) is chosen by folds within the training rows.

Null and empty texts have no sentence and score the leak. Repeated rows are scored separately, ties between sentences go to
the first. Without labels, or with one class only, the score is that class's share. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylex.llm.base import Slice, code_points, crc_mod, lowered, mix64, pick, slices, span_hashes, windows, words

BITS = 20
_STOP = np.zeros(256, bool)
_STOP[[0x0A, 0x21, 0x2E, 0x3F]] = True


@dataclass
class Model:
    """weight of each hashed word, bias of a sentence, and the leak (label noise that no sentence explains)."""

    weight: np.ndarray
    bias: float
    leak: float


#: Features of a word: itself and its first so many bytes.
BEGINNINGS = (4, 6)


def parts(s: Slice) -> Iterator[Slice]:
    """A slice, or the windows of a long text, which end with a sentence."""
    for lo, hi in windows(s, _STOP):
        yield s if hi - lo == len(s.data) else Slice(s.data[lo:hi], np.asarray([0, hi - lo]), s.lo, s.hi)


def sentences(s: Slice) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each feature of the words, first word of each sentence, document of each sentence; starts, ends of words."""
    starts, ends, h = words(s)
    stops = np.zeros(len(s.data) + 1, np.int64)
    np.cumsum(_STOP[s.data], out=stops[1:])
    doc = s.doc_of(starts)
    part = stops[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    low = lowered(s.data)
    hashes = [h] + [mix64(span_hashes(low, starts, np.minimum(ends, starts + k)) + np.uint64(k)) for k in BEGINNINGS]
    return [(x >> np.uint64(64 - BITS)).astype(np.int64) for x in hashes], first, doc[first], starts, ends


def _bags(batch_y: np.ndarray, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: labels, sentences of each document, and the distinct (document, sentence, bucket) triples in order."""
    for s in slices(column):
        docs, sents, buckets, number = [], [], [], np.zeros(s.n, np.int64)
        for part in parts(s):
            feats, first, doc, starts, _ = sentences(part)
            sent = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(starts))))
            key = np.unique(np.concatenate([sent << BITS | f for f in feats]))
            sent = key >> BITS
            docs.append(doc[sent]), sents.append(sent + number.sum()), buckets.append(key & ((1 << BITS) - 1))
            number += np.bincount(doc, minlength=s.n)
        yield batch_y[s.lo : s.hi], number, np.concatenate(docs), np.concatenate(sents), np.concatenate(buckets)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, df, hits): documents and toxic documents with each feature, summed over the task."""
    df, hits = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for batch in batches:
        for y, _, doc, _, bucket in _bags(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)):
            once = np.unique(doc << BITS | bucket)
            b = once & ((1 << BITS) - 1)
            df += np.bincount(b, minlength=1 << BITS)
            hits += np.bincount(b, weights=y[once >> BITS], minlength=1 << BITS).astype(np.int64)
    at = np.flatnonzero(df)
    yield pa.record_batch([pa.array(at), pa.array(df[at]), pa.array(hits[at])], names=["bucket", "df", "hits"])


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, features: int = 2048, steps: int = 150, ridges: tuple[float, ...] = (0.03, 0.1, 0.3, 1.0), folds: int = 3) -> Model:
    """Fit on at most about sample labelled documents, chosen by a hash of their ids.

    Executors count and screen the features; the driver gets the counts of the frequent ones, and for each document only
    the few kept features and the number of its sentences.
    """
    labelled = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")).where(crc_mod("doc_id", 5) != 0)
    n = labelled.count()
    if n > sample:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(sample / n * (1 << 20)))
    chosen = pick(docs, "doc_id", "text").join(F.broadcast(labelled), "doc_id").select("y", "text", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(folds)).cast("int").alias("fold"))  # at most about sample rows
    sums = chosen.mapInArrow(_counted, "bucket bigint, df bigint, hits bigint").groupBy("bucket").agg(F.sum("df").alias("df"), F.sum("hits").alias("hits")).where("df >= 5").toArrow()
    bucket, df, hits = (sums[c].to_numpy() for c in ("bucket", "df", "hits"))
    stat = labelled.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("share")).first()
    share = float(stat["share"] or 0.0)
    if not 0 < share < 1:
        return Model(np.zeros(1 << BITS, np.float32), -30.0, share)
    low = wilson(hits, df)
    best = np.lexsort((bucket, -low))[:features]
    best = np.sort(best[low[best] > share])
    kept, trust = bucket[best], low[best]
    at = np.full(1 << BITS, -1, np.int64)
    at[kept] = np.arange(len(kept))
    shared = docs.sparkSession.sparkContext.broadcast(at.astype(np.int32))

    def kept_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            at = 0
            for y, n_sent, doc, sent, b in _bags(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)):
                use = table[b] >= 0
                d, key = doc[use], sent[use] << BITS | table[b[use]]
                cut = pa.array(np.searchsorted(d, np.arange(len(y) + 1)).astype(np.int32))
                fold = batch.column(2)[at : at + len(y)]
                at += len(y)
                yield pa.record_batch([pa.array(y.astype(np.int32)), pa.array(n_sent.astype(np.int32)), pa.ListArray.from_arrays(cut, pa.array(key)), fold], names=["y", "n_sent", "hits", "fold"])

    rows = chosen.mapInArrow(kept_only, "y int, n_sent int, hits array<bigint>, fold int").toArrow().combine_chunks()
    hit = rows["hits"].combine_chunks()
    size = hit.value_lengths().to_numpy()
    key = hit.flatten().to_numpy()
    data = (rows["y"].to_numpy(), rows["n_sent"].to_numpy(), np.repeat(np.arange(len(size)), size), key >> BITS, key & ((1 << BITS) - 1))
    ridge = chosen_ridge(*data, rows["fold"].to_numpy(), kept, trust, steps, ridges) if len(ridges) > 1 else ridges[0]
    return fit(*data, kept, trust, steps, ridge=ridge)


def chosen_ridge(y: np.ndarray, n_sent: np.ndarray, doc: np.ndarray, sent: np.ndarray, feature: np.ndarray, fold: np.ndarray, kept: np.ndarray, trust: np.ndarray, steps: int, ridges: tuple[float, ...]) -> float:
    """The ridge whose models of all folds but one are the likeliest on the folds left out; of equal ones the largest.

    The features were chosen on all training rows, which is no matter for a choice among ridges.
    """
    loss = []
    for ridge in ridges:
        total = 0.0
        for k in np.unique(fold):
            out = fold == k
            number = np.cumsum(~out) - 1
            use = ~out[doc]
            m = fit(y[~out], n_sent[~out], number[doc[use]], sent[use], feature[use], kept, trust, steps, ridge=ridge)
            p = np.clip(scores(n_sent, doc, sent, feature, m, kept), 1e-6, 1 - 1e-6)[out]
            total -= (y[out] * np.log(p) + (1 - y[out]) * np.log(1 - p)).sum()
        loss.append(total)
    return max(r for r, x in zip(ridges, loss, strict=True) if x <= min(loss) + 1e-9)


def scores(n_sent: np.ndarray, doc: np.ndarray, sent: np.ndarray, feature: np.ndarray, m: Model, kept: np.ndarray) -> np.ndarray:
    """Documents' probabilities from the kept features of their sentences."""
    z = np.full(len(n_sent), np.log(max(1 - m.leak, 1e-12))) + n_sent * np.log1p(-1 / (1 + np.exp(-m.bias)))
    if len(doc):
        rows, r = np.unique(np.stack([doc, sent], 1), axis=0, return_inverse=True)
        p = 1 / (1 + np.exp(-np.clip(m.bias + np.bincount(r.reshape(-1), weights=m.weight[kept][feature]), -30, 30)))
        z += np.bincount(rows[:, 0], weights=np.log1p(-np.minimum(p, 1 - 1e-9)) - np.log1p(-1 / (1 + np.exp(-m.bias))), minlength=len(n_sent))
    return 1 - np.exp(z)


def wilson(hits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Lower bound (two standard errors) of the share hits / n."""
    n = np.maximum(n, 1e-9)
    share = hits / n
    return (share + 2 / n - 2 * np.sqrt(share * (1 - share) / n + 1 / n**2)) / (1 + 4 / n)


def fit(y: np.ndarray, n_sent: np.ndarray, doc: np.ndarray, sent: np.ndarray, feature: np.ndarray, kept: np.ndarray, trust: np.ndarray, steps: int, bias: float = -10.0, ridge: float = 0.1) -> Model:
    """Adam on the likelihood of the noisy-or, from the kept features of each sentence.

    The bias of a sentence is fixed and low, so that thousands of harmless sentences don't add up; labels that no word
    explains are the leak's. ridge pulls the weights towards 0.
    """
    weight = np.zeros(1 << BITS, np.float32)
    if not len(y):
        return Model(weight, bias, 0.0)
    share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    rows, r = np.unique(np.stack([doc, sent], 1), axis=0, return_inverse=True) if len(doc) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
    r = r.reshape(-1)
    owner = rows[:, 0]
    rest = (n_sent - np.bincount(owner, minlength=len(y))) * np.log1p(-1 / (1 + np.exp(-bias)))  # sentences without a kept feature
    trust = np.clip(trust, 1e-3, 1 - 1e-3)
    w = np.where(trust > 0.4, np.log(trust / (1 - trust)) - bias, 0.0)  # a start that explains the surest words
    leak_z = np.log(share / 2 / (1 - share / 2))
    m = [np.zeros(len(kept) + 1) for _ in range(2)]
    for step in range(1, steps + 1):
        z_s = bias + np.bincount(r, weights=w[feature], minlength=len(rows))
        p = 1 / (1 + np.exp(-np.clip(z_s, -30, 30)))
        leak = 1 / (1 + np.exp(-leak_z))
        none = np.exp(np.log(1 - leak) + rest + np.bincount(owner, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y)))
        ratio = np.where(y == 1, none / np.maximum(1 - none, 1e-9), -1.0)
        g_s = ratio[owner] * p
        grad = np.concatenate([np.bincount(feature, weights=g_s[r], minlength=len(kept)) - ridge * w, [(ratio * leak).sum()]])
        m[0] = 0.9 * m[0] + 0.1 * grad
        m[1] = 0.99 * m[1] + 0.01 * grad**2
        move = 0.3 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-6) * (0.2 if step > steps * 0.7 else 1)
        w += move[:-1]
        leak_z = min(leak_z + move[-1], 0.0)
    weight[kept] = w
    return Model(weight, bias, float(1 / (1 + np.exp(-leak_z))))


RESULT = "doc_id bigint, held_out boolean, score double, predicted int, n_sentences bigint, worst_start bigint, worst_end bigint, worst_score double"


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Document scores, with the most offending sentence's place in code points and its own probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for s in slices(batch.column(2)):
                score, n, worst, a, b = score_parts(s, m)
                rows = slice(s.lo, s.hi)
                yield pa.record_batch([batch.column(0)[rows], batch.column(1)[rows], pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(n), pa.array(a), pa.array(b), pa.array(worst)], names=["doc_id", "held_out", "score", "predicted", "n_sentences", "worst_start", "worst_end", "worst_score"])

    return pick(docs, "doc_id", "text").select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "text").mapInArrow(run, RESULT)


def score_parts(s: Slice, m: Model) -> tuple[np.ndarray, ...]:
    """score_slice of a slice, window by window if it is a long text: the chances to be harmless are multiplied."""
    out, at = None, 0
    for part in parts(s):
        found = score_slice(part, m)
        if out is None:
            out = found
        else:  # one text
            score, n, worst, a, b = found
            better = worst > out[2]
            out = (1 - (1 - out[0]) * (1 - score) / max(1 - m.leak, 1e-300), out[1] + n, np.maximum(worst, out[2]), np.where(better, a + at, out[3]), np.where(better, b + at, out[4]))
        at += int(np.count_nonzero((part.data & 0xC0) != 0x80))
    return out if out is not None else score_slice(s, m)


def score_slice(s: Slice, m: Model) -> tuple[np.ndarray, ...]:
    """Score, number of sentences, the worst one's probability, start and end (code points) of each document."""
    feats, first, doc, starts, ends = sentences(s)
    n = np.bincount(doc, minlength=s.n).astype(np.int64)
    score, worst = np.full(s.n, m.leak), np.zeros(s.n)
    a, b = np.zeros(s.n, np.int64), np.zeros(s.n, np.int64)
    if len(first):
        z = logits(feats, first, m)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        stay = np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=s.n)
        score = 1 - (1 - m.leak) * np.exp(stay)
        order = np.lexsort((np.arange(len(p)), -p, doc))
        lead = order[np.flatnonzero(np.diff(doc[order], prepend=-1))]
        last = np.append(first[1:], len(starts)) - 1
        cp = code_points(s.data)
        base = cp[s.off[doc[lead]]]
        worst[doc[lead]], a[doc[lead]], b[doc[lead]] = p[lead], cp[starts[first[lead]]] - base, cp[ends[last[lead]]] - base
    return score, n, worst, a, b


def logits(feats: list[np.ndarray], first: np.ndarray, m: Model) -> np.ndarray:
    return m.bias + sum(np.add.reduceat(once_in_sentence(f, first, m.weight), first) for f in feats)


def once_in_sentence(bucket: np.ndarray, first: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Each word's weight where it first stands in its sentence, else 0."""
    value = weight[bucket].astype(np.float64)
    hit = np.flatnonzero(value)
    if len(hit):
        sent = np.searchsorted(first, hit, side="right")
        _, keep = np.unique(sent << BITS | bucket[hit], return_index=True)
        again = np.ones(len(hit), bool)
        again[keep] = False
        value[hit[again]] = 0
    return value


def score(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """Train on labelled rows that aren't held out (crc32 of the id modulo 5 is not 0) and score every row."""
    return predict(docs, train(docs, labels, **bounds))


def offending(text: str, model: Model, least: float = 0.5) -> list[tuple[int, int, float]]:
    """(start, end, probability) of every sentence of one text at least so likely."""
    s = next(slices(pa.array([text], pa.string())))
    feats, first, _, starts, ends = sentences(s)
    if not len(first):
        return []
    p = 1 / (1 + np.exp(-logits(feats, first, model)))
    last, cp = np.append(first[1:], len(starts)) - 1, code_points(s.data)
    return [(int(cp[starts[first[i]]]), int(cp[ends[last[i]]]), float(p[i])) for i in np.flatnonzero(p >= least)]
