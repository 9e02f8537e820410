"""Language identification by prediction by partial matching (PPM).

For each language a variable-order tree of byte contexts is grown from labelled text; its statistics are then frozen. A
byte's code length is exact: escape probabilities of method C with full exclusion, worked out once for every (context, byte)
of the union of all trees. At prediction the union is a finite-state machine: the state before each byte is the longest
context that ends there, so all bytes of a slice are scored with a few table look-ups, and a text's language is the one with
the shortest code.

Null texts and texts without a letter are "und" with score 0, as is everything if no text with a known language exists.
Ties go to the language that sorts first. Repeated rows are predicted separately. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylex.llm.base import LONG, crc_mod, pick, segment_sums, slices

ORDER = 4


@dataclass
class Model:
    """langs; symbol of a byte; machine [states, symbols]; bits of code length [languages, states * symbols]."""

    langs: list[str]
    symbol: np.ndarray
    step: np.ndarray
    bits: np.ndarray

    @property
    def reset(self) -> int:
        return self.step.shape[1] - 1

    def code_lengths(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Bits of each text (row) under each language (column); every text starts from the empty context."""
        n, width = len(data), self.step.shape[1]
        docs = len(off) - 1
        if n > LONG and docs == 1:  # window by window; the bytes before a window are its first contexts
            total = self.code_lengths(data[:LONG], np.asarray([0, LONG]))
            for lo in range(LONG, n, LONG):
                total = total + self._continued(self.symbol[data[lo - ORDER : lo + LONG]])
            return total
        at = np.arange(n) + np.repeat(np.arange(1, docs + 1), np.diff(off))  # one reset symbol before each text
        sym = np.full(n + docs, self.reset, np.int64)
        sym[at] = self.symbol[data]
        flat = self.step.reshape(-1)
        state = np.zeros(n + docs, np.int64)
        padded = np.concatenate([np.full(ORDER, self.reset, np.int64), sym])
        for k in range(ORDER):
            state = flat[state * width + padded[k : k + n + docs]].astype(np.int64)
        cell = state * width + sym
        bounds = off + np.arange(docs + 1)
        return np.stack([segment_sums(row[cell], bounds) for row in self.bits], axis=1) if len(self.langs) else np.zeros((docs, 0))


    def _continued(self, sym: np.ndarray) -> np.ndarray:
        """Bits of symbols in the middle of a text, the first ORDER of which are context only."""
        width, n = self.step.shape[1], len(sym) - ORDER
        flat, state = self.step.reshape(-1), np.zeros(n, np.int64)
        for k in range(ORDER):
            state = flat[state * width + sym[k : k + n]].astype(np.int64)
        cell = state * width + sym[ORDER:]
        return np.asarray([[row[cell].sum(dtype=np.float64) for row in self.bits]]).reshape(1, len(self.langs))


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): counts of every byte with the ORDER bytes before it, as one integer; zero bytes before a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in seen.items():
                gram, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.record_batch([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])
            seen.clear()

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for s in slices(batch.column(1)):
                for i in range(s.n):
                    whole = s.data[s.off[i] : s.off[i + 1]]
                    for lo in range(0, max(len(whole), 1), LONG):
                        before = min(lo, ORDER)
                        one = whole[lo - before : lo + LONG].astype(np.int64)
                        gram = one.copy()
                        for k in range(1, ORDER + 1):
                            gram[k:] += one[: max(0, len(one) - k)] << (8 * k)
                        seen.setdefault(langs[s.lo + i], []).append(gram[before:])
                        size += len(one)
                        if size > 1 << 22:
                            yield from flush()
                            size = 0
                if size > 1 << 22:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, per_language: int = 2000, max_contexts: int = 16_000, min_count: int = 8) -> Model:
    """Grow and freeze the trees from at most about per_language texts of each language, chosen by a hash of their ids.

    per_language and max_contexts bound the model, whatever the input's size.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    total = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not total:
        return Model([], np.zeros(256, np.int64), np.zeros((1, 2), np.uint16), np.zeros((0, 2), np.float32))
    share = F.create_map(*[x for lang, n in total.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))])
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * F.lit(1 << 20)
    table = gram_counts(known.where(part)).toArrow()
    lang, gram, n = table["lang"].to_numpy(zero_copy_only=False), table["gram"].to_numpy(), table["n"].to_numpy()
    return fit([*sorted(total)], lang, gram, n, max_contexts, min_count)


def fit(langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, max_contexts: int, min_count: int) -> Model:
    which = np.searchsorted(np.asarray(langs, object), lang) if len(lang) else np.zeros(0, np.int64)
    byte, before = gram & 255, gram >> 8
    # contexts: depth 0 is the root; kept if frequent enough, and only with their prefix and suffix
    found: list[tuple[int, int, int]] = []
    for depth in range(1, ORDER + 1):
        keys, at = np.unique(before & ((1 << 8 * depth) - 1), return_inverse=True)
        count = np.bincount(at, weights=n, minlength=len(keys))
        whole = np.ones(len(keys), bool)
        for k in range(depth):
            whole &= (keys >> 8 * k) & 255 != 0
        found += [(-int(c), depth, int(key)) for key, c in zip(keys[whole], count[whole], strict=True) if c >= min_count]
    number: dict[tuple[int, int], int] = {(0, 0): 0}
    for _, depth, key in sorted(sorted(found)[:max_contexts], key=lambda x: (x[1], x[2])):
        if (depth - 1, key >> 8) in number and (depth - 1, key & ((1 << 8 * (depth - 1)) - 1)) in number:
            number[depth, key] = len(number)
    alphabet = np.unique(byte)
    width = len(alphabet) + 2  # every other byte, reset
    other, reset = width - 2, width - 1
    symbol = np.full(256, other, np.int64)
    symbol[alphabet] = np.arange(len(alphabet))
    nodes = list(number)
    suffix = np.asarray([number[d - 1, key & ((1 << 8 * (d - 1)) - 1)] if d else 0 for d, key in nodes])
    step = np.zeros((len(nodes), width), np.int64)
    for s, (d, key) in enumerate(nodes):  # by depth: a suffix comes first
        step[s] = step[suffix[s]] if d else 0
        if d < ORDER:
            for k, b in enumerate(alphabet.tolist()):
                if (child := number.get((d + 1, key << 8 | b))) is not None:
                    step[s, k] = child
    step[:, reset] = 0
    bits = np.zeros((len(langs), len(nodes), width), np.float64)
    depth_of = np.asarray([d for d, _ in nodes])
    for x in range(len(langs)):
        mine = which == x
        sym, old, c = symbol[byte[mine]], before[mine], n[mine].astype(np.float64)
        count = np.zeros((len(nodes), width))
        for depth in range(ORDER + 1):
            keys = old & ((1 << 8 * depth) - 1)
            uniq, at = np.unique(keys, return_inverse=True)
            node = np.asarray([number.get((depth, int(k)), -1) for k in uniq], np.int64)[at] if len(uniq) else np.zeros(0, np.int64)
            ok = node >= 0
            np.add.at(count, (node[ok], sym[ok]), c[ok])
        bits[x] = _exact_bits(count, suffix, depth_of, reset)
    return Model(langs, symbol, step.astype(np.uint16 if len(nodes) < 65_536 else np.int32), bits.reshape(len(langs), -1).astype(np.float32))


def _exact_bits(count: np.ndarray, suffix: np.ndarray, depth: np.ndarray, reset: int) -> np.ndarray:
    """Code lengths of every symbol in every context: method C escapes, symbols of longer contexts excluded.

    A context without counts in this language is skipped at no cost. below[s] is the code length at s's suffix when the
    symbols seen at s are excluded.
    """
    nodes, width = count.shape
    seen = count > 0
    bits = np.zeros((nodes, width))
    left = max(1, 256 - int(seen[0, :reset].sum()))
    flat = np.log2(left)  # order -1: any byte not seen at all
    below = np.zeros((nodes, width))
    below[0] = flat
    with np.errstate(divide="ignore", invalid="ignore"):
        for d in range(int(depth.max()) + 1):
            rows = np.flatnonzero(depth == d)
            if d:
                up = suffix[rows]
                fresh = np.where(seen[rows], 0, count[up])
                total, kinds = fresh.sum(1), (fresh > 0).sum(1)
                code = -np.log2(fresh / (total + kinds)[:, None])
                escape = np.where(kinds > 0, -np.log2(kinds / (total + kinds)), 0)[:, None] + below[up]
                below[rows] = np.where(fresh > 0, code, escape)
            total, kinds = count[rows].sum(1), seen[rows].sum(1)
            code = -np.log2(count[rows] / (total + kinds)[:, None])
            escape = -np.log2(kinds / (total + kinds))[:, None] + below[rows]
            found = np.where(seen[rows], code, escape)
            bits[rows] = np.where((total > 0)[:, None], found, bits[suffix[rows]] if d else flat)
    bits[:, reset] = 0
    return bits


RESULT = "doc_id bigint, held_out boolean, lang_pred string, score double, bits_per_byte double"


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the winner's share of 2^-bits over all languages), bits_per_byte."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            letters = np.asarray(batch.column(3).fill_null(False).to_numpy(zero_copy_only=False), bool)
            for s in slices(batch.column(2)):
                bits, size = m.code_lengths(s.data, s.off), np.diff(s.off)
                ok = letters[s.lo : s.hi] & bool(m.langs)
                best = bits.argmin(1) if m.langs else np.zeros(s.n, np.int64)
                least = bits.min(1) if m.langs else np.zeros(s.n)
                with np.errstate(under="ignore"):
                    score = 1 / np.exp2(least[:, None] - bits).sum(1) if m.langs else np.zeros(s.n)
                rows = slice(s.lo, s.hi)
                yield pa.record_batch(
                    [batch.column(0)[rows], batch.column(1)[rows], pa.array([m.langs[b] if o else "und" for b, o in zip(best, ok, strict=True)], pa.string()), pa.array(np.where(ok, score, 0.0)), pa.array(np.where(ok, least / np.maximum(size, 1), 0.0))],
                    names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"],
                )

    return pick(docs, "doc_id", "text").select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "text", F.col("text").rlike(r"\p{L}").alias("letters")).mapInArrow(run, RESULT)


def identify(docs: DataFrame, **bounds) -> DataFrame:
    """Train on the rows that aren't held out (crc32 of the id modulo 4 is not 2) and predict every row."""
    return predict(docs, train(pick(docs, "doc_id", "text", "lang").where(crc_mod("doc_id", 4) != 2), **bounds))
