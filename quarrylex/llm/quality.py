"""Quality by co-training of two views.

The text view reads a document's content: patterns of characters around marks, and how much its words repeat themselves. It
has no features for single words: hashed words were tried and lowered the held-out results (see README). The metadata view
reads the record and its page shape: language, source, length, lines, and the make-up of its characters by class. Each view
has a naive Bayes classifier, whose counts cover all labelled rows. In each round, each view's calibrated confident
predictions on all unlabelled rows become pseudo-labels for the other view. Views are calibrated on the labelled rows (a
monotone map from score histograms), each row scored by the counts without itself, and in the end combined by a logistic
model over the calibrated log-odds.

Counts and histograms are summed on the executors; the driver holds one number per feature or cell, whatever the input's
size. Labels of the held-out fold (crc32 of the id modulo 5 is 0) are never used.

Null texts count as empty; null metadata is a value of its own. Repeated rows are scored separately; of several labels of an
id the largest counts. Without labels of both classes every document is kept with score 0.5 or the class's share. Extra
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylex.llm.base import LONG, Slice, attach, crc_mod, materialise, mix64, pick, segment_sums, slices, spans_of, words

#: Bins of a numeric feature; buckets of character patterns (text view); hashed values of a categorical column.
BINS, PATTERNS, VALUES = 24, 2048, 256
CELLS = 64
_CLASS = np.full(256, 5, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 white, 4 other ASCII, 5 beyond ASCII
_CLASS[0x21:0x7F] = 4
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 0, 1, 2
_CLASS[[9, 10, 13, 32]] = 3
TEXT_STATS = ("distinct words", "distinct word pairs", "word length", "longest run of one word", "words before a line end")
META_STATS = ("bytes", "lines", "line length", "upper", "digits", "white", "other marks", "beyond ASCII")
N_TEXT = PATTERNS + len(TEXT_STATS) * BINS
N_META = 2 * VALUES + len(META_STATS) * BINS


def _share_bin(x: np.ndarray) -> np.ndarray:
    """Shares from 0 to 1 in BINS bins, finer near 0."""
    return np.minimum((np.sqrt(np.clip(x, 0, 1)) * BINS).astype(np.int64), BINS - 1)


def _size_bin(x: np.ndarray) -> np.ndarray:
    """Sizes by their logarithm, two bins for each doubling."""
    return np.minimum((2 * np.log2(1 + np.maximum(x, 0))).astype(np.int64), BINS - 1)


def _patterns(data: np.ndarray, off: np.ndarray, lo: int) -> np.ndarray:
    """Document and bucket, as one number, of each pattern in a part of a slice that starts at lo."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    kind = _CLASS[data]
    at = np.flatnonzero((kind[:-2] == 4) | (kind[1:-1] == 4) | (kind[2:] == 4))
    doc = np.searchsorted(off, at + lo, side="right") - 1
    whole = at + lo + 2 < off[doc + 1]
    at, doc = at[whole], doc[whole]
    code = np.where(kind == 4, data, kind)
    pat = code[at].astype(np.uint64) | code[at + 1].astype(np.uint64) << np.uint64(8) | code[at + 2].astype(np.uint64) << np.uint64(16)
    return np.unique(doc * PATTERNS + (mix64(pat) % np.uint64(PATTERNS)).astype(np.int64))


def text_features(s: Slice) -> list[np.ndarray]:
    """Numbers of the features that each document has, sorted and distinct: patterns present, binned statistics."""
    starts, ends, h = words(s)
    bounds = np.searchsorted(starts, s.off)
    n = np.diff(bounds)
    doc = np.repeat(np.arange(s.n), n)

    def distinct(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
        key = np.unique((values >> np.uint64(24)) | (owner.astype(np.uint64) << np.uint64(40)))
        return np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=s.n)

    pair_ok = doc[1:] == doc[:-1]
    pairs = mix64(h[:-1] + mix64(h[1:]))[pair_ok] if len(h) > 1 else h[:0]
    pair_doc = doc[1:][pair_ok] if len(h) > 1 else doc[:0]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    fresh = np.flatnonzero(~same)
    run = np.diff(np.append(fresh, len(h)))
    longest = np.zeros(s.n)
    np.maximum.at(longest, doc[fresh], run)
    at_end = np.zeros(len(starts))
    if len(starts):
        inside = ends < len(s.data)
        at_end[inside] = s.data[ends[inside]] == 10
    some = np.maximum(n, 1)
    stats = [
        _share_bin(distinct(h, doc) / some), _share_bin(distinct(pairs, pair_doc) / np.maximum(n - 1, 1)), _size_bin(segment_sums((ends - starts).astype(float), bounds) / some * 8),
        _size_bin(longest), _share_bin(segment_sums(at_end, bounds) / some),
    ]
    # patterns of three characters: marks as they are, letters and digits by class
    seen = np.unique(np.concatenate([_patterns(s.data[lo : lo + LONG + 2], s.off, lo) for lo in range(0, max(len(s.data), 1), LONG)]))
    lists = np.split(seen % PATTERNS, np.searchsorted(seen // PATTERNS, np.arange(1, s.n)))
    dense = np.stack([PATTERNS + k * BINS + b for k, b in enumerate(stats)], 1)
    return [np.concatenate([a, b]).astype(np.int32) for a, b in zip(lists, dense, strict=True)]


def _counts(s: Slice, which: np.ndarray) -> np.ndarray:
    """Bytes of each document that are in a set."""
    if s.n == 1:
        return np.asarray([float(np.count_nonzero(which[s.data]))])
    return segment_sums(which[s.data].astype(float), s.off)


def meta_features(s: Slice, lang: list, source: list) -> list[np.ndarray]:
    """Feature numbers of the metadata view: hashed language and source, page shape."""
    size = np.diff(s.off)
    some = np.maximum(size, 1)
    counts = np.stack([_counts(s, _CLASS == k) for k in range(6)], 1)
    kinds = counts / some[:, None]
    lines = _counts(s, np.arange(256) == 10) + 1
    stats = [_size_bin(size), _size_bin(lines), _size_bin(size / lines), *(_share_bin(kinds[:, k]) for k in (1, 2, 3, 4, 5))]
    dense = np.stack([2 * VALUES + k * BINS + b for k, b in enumerate(stats)], 1)

    def value(v: object) -> int:
        raw = np.frombuffer(str(v).encode("utf-8", "replace") + b"\0", np.uint8).astype(np.uint64)
        return 0 if v is None else 1 + int(mix64((raw * mix64(np.arange(len(raw), dtype=np.uint64))).sum(keepdims=True))[0] % np.uint64(VALUES - 1))

    known: dict = {}
    codes = [(known.setdefault(("l", a), value(a)), VALUES + known.setdefault(("s", b), value(b))) for a, b in zip(lang, source, strict=True)]
    return [np.asarray([*c, *d], np.int32) for c, d in zip(codes, dense.tolist(), strict=True)]


def featurised(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, y (label of the training folds, null elsewhere), feature numbers of both views."""
    known = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").cast("bigint"), F.col("quality").cast("int").alias("y")).where(crc_mod("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("y").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for s in slices(batch.column(1)):
                rows = slice(s.lo, s.hi)
                yield pa.record_batch([batch.column(0)[rows], pa.array(text_features(s), pa.list_(pa.int32())), pa.array(meta_features(s, lang[rows], source[rows]), pa.list_(pa.int32()))], names=["doc_id", "text", "meta"])

    wide = pick(docs, "doc_id", "text", "lang", "source").mapInArrow(run, "doc_id bigint, text array<int>, meta array<int>")
    return attach(wide, known, "doc_id", known.count(), "left").select("doc_id", "y", "text", "meta")


@dataclass
class View:
    """Log-odds of each feature, and the calibrated log-odds of a raw score by its cell.

    without: log-odds by the counts without one row of class 0, and of class 1, that has the feature.
    """

    weight: np.ndarray
    without: tuple[np.ndarray, np.ndarray]
    edges: np.ndarray
    level: np.ndarray

    def raw(self, features: pa.Array, y: np.ndarray | None = None) -> np.ndarray:
        """y: the classes of rows that were counted, each of which is then scored by the other rows."""
        flat, off = features.values.to_numpy(), features.offsets.to_numpy()
        flat = flat[off[0] : off[-1]]
        off = off - off[0]
        n = np.diff(off)
        weight = self.weight[flat] if y is None else np.where(np.repeat(y, n) == 1, self.without[1][flat], self.without[0][flat])
        return segment_sums(weight, off) / np.sqrt(np.maximum(n, 1))  # damped: features depend on each other

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return self.level[np.searchsorted(self.edges, raw)]


def naive_bayes(counts: np.ndarray) -> np.ndarray:
    """Log-odds from counts [features + 1, 2]; the last row has the documents of each class."""
    n = np.maximum(counts[-1], 1.0)
    p = (np.maximum(counts[:-1], 0) + 1) / (n + 2)
    return np.where(counts[:-1].sum(1) >= 5, np.log(p[:, 1]) - np.log(p[:, 0]), 0.0)


def isotonic(hits: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Monotone shares of hits (pool adjacent violators), with half a count of each class added to the pools."""
    pools: list[list[float]] = []
    for h, n in zip(hits, total, strict=True):
        pools.append([h, n, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            h2, n2, k2 = pools.pop()
            pools[-1] = [pools[-1][0] + h2, pools[-1][1] + n2, pools[-1][2] + k2]
    return np.concatenate([np.full(k, (h + 0.5) / (n + 1)) for h, n, k in pools])


def _aligned(column: pa.Array) -> pa.Array:
    return pa.concat_arrays([column])


def _summed(table: DataFrame, views: tuple[View, View] | None, sure: float, what: str) -> np.ndarray:
    """Sums over all rows, as one vector. what: "labelled" or "pseudo" feature counts of both views, or "cells" (each view's
    score histogram of the labelled rows).
    """
    shared = table.sparkSession.sparkContext.broadcast(views)
    widths = (N_TEXT + 1, N_META + 1)
    size = 2 * sum(widths) if what != "cells" else 2 * CELLS * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, v = np.zeros(size), shared.value
        for batch in batches:
            y = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            columns = [_aligned(batch.column(1)), _aligned(batch.column(2))]
            if what == "cells":
                for k in (0, 1):
                    cell = np.clip(((v[k].raw(columns[k], y) + 16) * (CELLS / 32)).astype(np.int64), 0, CELLS - 1)
                    total += np.bincount(k * 2 * CELLS + cell * 2 + y, minlength=size)
                continue
            base = 0
            for k in (0, 1):
                if what == "labelled":
                    cls = y
                else:  # taught by the other view
                    z = v[1 - k].calibrated(v[1 - k].raw(columns[1 - k]))
                    cls = np.where(y >= 0, -1, np.where(z >= sure, 1, np.where(z <= -sure, 0, -1)))
                use = np.flatnonzero(cls >= 0)
                off = columns[k].offsets.to_numpy()
                flat = columns[k].values.to_numpy()
                owner = np.repeat(cls, np.diff(off))
                flat = flat[off[0] : off[-1]]
                ok = owner >= 0
                total[base : base + 2 * widths[k]] += np.bincount(flat[ok] * 2 + owner[ok], minlength=2 * widths[k])
                total[base + 2 * widths[k] - 2 : base + 2 * widths[k]] += np.bincount(cls[use], minlength=2)
                base += 2 * widths[k]
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["i", "v"])

    rows = table.where("y is not null") if what != "pseudo" else table.where("y is null")
    sums = rows.select("y", "text", "meta").mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[sums["i"].to_numpy()] = sums["v"].to_numpy()
    return out


def _views(counts: np.ndarray) -> tuple[View, View]:
    a = counts[: 2 * (N_TEXT + 1)].reshape(-1, 2)
    b = counts[2 * (N_TEXT + 1) :].reshape(-1, 2)
    none = np.zeros(0)
    return tuple(View(naive_bayes(c), (naive_bayes(c - [1, 0]), naive_bayes(c - [0, 1])), none, np.zeros(1)) for c in (a, b))


def _calibrate(table: DataFrame, views: tuple[View, View]) -> tuple[View, View]:
    cells = _summed(table, views, 0, "cells").reshape(2, CELLS, 2)
    edges = (np.arange(1, CELLS) * (32 / CELLS)) - 16
    for k, v in enumerate(views):
        share = isotonic(cells[k, :, 1], cells[k].sum(1))
        v.edges, v.level = edges, np.log(share) - np.log(1 - share)
    return views


@dataclass
class Model:
    views: tuple[View, View] | None
    mix: np.ndarray  # weights of the calibrated views, intercept
    share: float
    pseudo: list[list[float]]


def train(table: DataFrame, rounds: int = 2, confidence: float = 0.97, trust: float = 0.5) -> Model:
    """Co-train on a featurised table. confidence: calibrated probability from which a prediction teaches the other view;
    trust: weight of a pseudo-label against a label.
    """
    labelled = _summed(table, None, 0, "labelled")
    n = labelled[-2:]
    if n.min() == 0:
        return Model(None, np.zeros(3), float((n[1] + 0.5) / (n.sum() + 1)) if n.sum() else 0.5, [])
    views = _calibrate(table, _views(labelled))
    sure = float(np.log(confidence / (1 - confidence)))
    log = []
    for _ in range(rounds):
        pseudo = _summed(table, views, sure, "pseudo")
        log.append([*pseudo[2 * N_TEXT : 2 * N_TEXT + 2], *pseudo[-2:]])
        views = _calibrate(table, _views(labelled + trust * pseudo))
    return Model(views, _mix(table, views), float(n[1] / n.sum()), log)


def _mix(table: DataFrame, views: tuple[View, View]) -> np.ndarray:
    """Logistic regression of the labels on both calibrated log-odds, from a joint histogram over all labelled rows."""
    shared = table.sparkSession.sparkContext.broadcast(views)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        total = np.zeros(CELLS * CELLS * 2)
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            cell = [np.searchsorted(v[k].edges, v[k].raw(_aligned(batch.column(1 + k)), y)) for k in (0, 1)]
            total += np.bincount((cell[0] * CELLS + cell[1]) * 2 + y, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["i", "v"])

    sums = table.where("y is not null").select("y", "text", "meta").mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    i, n = sums["i"].to_numpy(), sums["v"].to_numpy()
    x = np.stack([views[0].level[i // 2 // CELLS], views[1].level[i // 2 % CELLS], np.ones(len(i))], 1)
    y = i % 2
    w = np.asarray([0.5, 0.5, 0.0])
    for _ in range(25):  # Newton steps with a small ridge towards the start
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (y - p)) - 1.0 * (w - [0.5, 0.5, 0.0])
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(3)
        w = w + np.linalg.solve(hess, grad)
    return w


SCORED = "doc_id bigint, score_text double, score_meta double, score double, keep boolean"


def predict(table: DataFrame, model: Model) -> DataFrame:
    """doc_id, calibrated score of each view, combined score (probability of good quality), keep (score of 0.5 or more)."""
    shared = table.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if m.views is None:
                z = [np.full(batch.num_rows, np.log(m.share / (1 - m.share)))] * 2
                both = z[0]
            else:
                z = [v.calibrated(v.raw(_aligned(batch.column(1 + k)))) for k, v in enumerate(m.views)]
                both = m.mix[0] * z[0] + m.mix[1] * z[1] + m.mix[2]
            p = [1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (*z, both)]
            keep = p[2] >= 0.5 if m.views is not None else np.ones(batch.num_rows, bool)
            yield pa.record_batch([batch.column(0), *map(pa.array, p), pa.array(keep)], names=["doc_id", "score_text", "score_meta", "score", "keep"])

    return table.select("doc_id", "text", "meta").mapInArrow(run, SCORED)


def classify(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Scores of all documents by a model that is co-trained on them."""
    table = materialise(featurised(docs, labels), "features")
    return predict(table, train(table, **how))


def good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents that the classifier keeps, with their own columns."""
    bad = materialise(classify(docs, labels, **how).where("not keep").select("doc_id").distinct(), "rejected")
    return attach(docs, bad, "doc_id", bad.count(), "left_anti")
