"""Substring dedup by content-defined chunking.

A gear rolling hash over the last 16 bytes cuts each text where its top bits are zero, so that an insertion only changes the
chunks around it. Stretches without a cut, such as one word again and again, are cut at their largest hashes. Chunks are
looked up with their neighbours: a link is a pair of adjacent chunks, or a chunk that alone is long enough for a passage.
Short hashes of all links are counted first; then a link's 128-bit digest identifies it in the whole corpus. Runs of chunks
whose links stand elsewhere are repeated passages if they are long enough, so that unrelated short matches in different
documents never add up to one; every copy but the first (smallest id, then place) can be removed.

A copy counts where it stands in a run that is long enough. Null and empty texts have no chunk. Each row is a document of its own; repeated rows repeat each other's chunks. The first of
tied copies is the one with the smallest id, then in the first row, at the smallest place. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylex.llm.base import Slice, attach, code_points, materialise, mix64, pick, slices, span_hashes, spans_of

WINDOW = 16
_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)
_SPACE = np.zeros(256, bool)
_SPACE[[0x09, 0x0A, 0x0D, 0x20]] = True
#: Code points in place of a word that make a run long enough whatever its blanks: long unbroken strings.
WIDE = 12


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling hash of the last 16 bytes at each byte: the sum of gear values shifted by their distance, in 16 bits."""
    h = _GEAR[data]
    width = 1
    while width < WINDOW:
        older = h[:-width] << np.uint16(width)
        h = h.copy()
        h[width:] += older
        width *= 2
    return h


def cuts(s: Slice, bits: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of the chunks of all texts.

    A place is a cut if the hash's top bits are zero and no such place is among the least bytes before it; gaps longer than
    most are cut where the hash is largest in the second half of the next most bytes. Both rules look at the bytes nearby only.
    """
    size = np.diff(s.off)
    hashes = gear(s.data)
    at = np.flatnonzero(hashes >> np.uint16(16 - bits) == 0) + 1
    doc = s.doc_of(at - 1)
    at, doc = at[(at - s.off[doc] >= least)], doc[(at - s.off[doc] >= least)]
    far = np.ones(len(at), bool)
    far[1:] = (at[1:] - at[:-1] >= least) | (doc[1:] != doc[:-1])
    keep = far & (at < s.off[doc + 1])
    at, doc = at[keep], doc[keep]
    full = np.flatnonzero(size > 0)
    starts, owner = np.concatenate([s.off[full], at]), np.concatenate([full, doc])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    ends = np.append(starts[1:], len(s.data))
    ends = np.where(np.append(owner[1:] != owner[:-1], True), s.off[owner + 1], ends) if len(owner) else ends[:0]
    wide = np.flatnonzero(ends - starts > most)
    if len(wide):
        more, whose = [], []
        for i in wide.tolist():
            a = int(starts[i])
            while ends[i] - a > most:  # the largest hash of the next bytes; of equal ones the first, so that periods fall in step
                a += most // 2 + 1 + int(hashes[a + most // 2 : a + most].argmax())
                more.append(a)
                whose.append(int(owner[i]))
        owner, starts = np.concatenate([owner, np.asarray(whose, owner.dtype)]), np.concatenate([starts, np.asarray(more, starts.dtype)])
        order = np.argsort(starts, kind="stable")
        owner, starts = owner[order], starts[order]
        ends = np.where(np.append(owner[1:] != owner[:-1], True), s.off[owner + 1], np.append(starts[1:], len(s.data)))
    return owner, starts, ends


def unspaced(data: np.ndarray) -> np.ndarray:
    """Marks the first byte of code points of scripts without blanks: kana and Han, Thai, Lao, Burmese, Khmer."""
    then = np.append(data[1:], np.zeros(min(len(data), 1), data.dtype))
    han = (data == 0xE3) & (then >= 0x81) | (data >= 0xE4) & (data <= 0xE9) | (data == 0xF0) & (then >= 0xA0) & (then <= 0xB3)
    thai = (data == 0xE0) & (then >= 0xB8) & (then <= 0xBB)
    return han | thai | (data == 0xE1) & ((then >= 0x80) & (then <= 0x82) | (then == 0x9E) | (then == 0x9F))


_PAIR = mix64(np.arange(1, 4, dtype=np.uint64)) | np.uint64(1)


def measured(s: Slice, start: np.ndarray, end: np.ndarray, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and code points of chunks; two code points of a script without blanks count as a word, as the tokenizer cuts them."""
    word, _ = spans_of(~_SPACE[s.data], s.off)
    pairs = np.append(np.int32(0), np.cumsum(unspaced(s.data), dtype=np.int32)) + np.int32(1) >> 1
    return np.searchsorted(word, end) - np.searchsorted(word, start) + pairs[end] - pairs[start], cp[end] - cp[start]


def links(s: Slice, chunks: tuple[np.ndarray, np.ndarray, np.ndarray], words: np.ndarray, points: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first chunk, last chunk, hash) of all links: adjacent chunks of a text, and chunks of at least least words or WIDE * least code points."""
    owner, start, end = chunks
    h = span_hashes(s.data, start, end)
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    alone = np.flatnonzero((words >= least) | (points >= WIDE * least))
    keys = np.concatenate([mix64(h[pair] * _PAIR[0] + h[pair + 1] * _PAIR[1]), mix64(h[alone] + _PAIR[2])])
    return np.concatenate([pair, alone]), np.concatenate([pair + 1, alone]), keys


def _sized(docs: DataFrame, least_words: int, bits: int, least: int, most: int) -> DataFrame:
    """64-bit hashes of the links that are found twice and more, summed in each batch before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for s in slices(batch.column(0)):
                chunks = cuts(s, bits, least, most)
                found.append(links(s, chunks, *measured(s, *chunks[1:], code_points(s.data)), least_words)[2])
            d, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.record_batch([pa.array(d.view(np.int64)), pa.array(n.astype(np.int64))], names=["d", "n"])

    return docs.select("text").mapInArrow(run, "d bigint, n bigint").groupBy("d").agg(F.sum("n").alias("n")).where("n > 1").select("d")


def bloom(keys: DataFrame, n: int, most_bits: int = 1 << 27) -> np.ndarray:
    """A bit map of written keys, one bit each in 16 to 32 per key while that is at most most_bits (16 MB).

    It only spares work: what it lets through by chance is joined exactly. Partial maps are joined in few tasks, so that the
    driver gets some maps of bounded size, never keys.
    """
    size = min(most_bits, 1 << max(10, (16 * max(n, 1)).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            bits[(mix64(batch.column(0).to_numpy().view(np.uint64)) & np.uint64(size - 1)).astype(np.int64)] = True
        yield pa.record_batch([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["map"])

    out = np.zeros(size // 8, np.uint8)
    for row in keys.coalesce(4).mapInArrow(run, "map binary").toLocalIterator():
        out |= np.frombuffer(row["map"], np.uint8)
    return out


#: pos: number of the link's first chunk; place: that one's first code point, length and words in one number; then: length and
#: words of the second chunk, 0 if there is none.
HITS = "row bigint, doc_id bigint, pos int, b1 bigint, b2 bigint, place bigint, then int"


def long_runs(first: np.ndarray, last: np.ndarray, words: np.ndarray, points: np.ndarray, least: int) -> np.ndarray:
    """Which links, given in order, stand in runs of chunks that are long enough for a passage."""
    if not len(first):
        return np.zeros(0, bool)
    new = np.append(True, first[1:] > last[:-1])
    run = np.cumsum(new) - 1
    lo = first[np.flatnonzero(new)]
    hi = np.maximum.reduceat(last, np.flatnonzero(new)) + 1
    total, size = np.append(0, np.cumsum(words)), np.append(0, np.cumsum(points))
    return ((total[hi] - total[lo] >= least) | (size[hi] - size[lo] >= WIDE * least))[run]


def _hits(docs: DataFrame, known: np.ndarray, least_words: int, bits: int, least: int, most: int) -> DataFrame:
    """Links that the bit map knows, in runs long enough for a passage, with digest and place; and a row with pos -1 and the number of chunks (place) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, mask = shared.value, np.uint64(len(shared.value) * 8 - 1)
        for batch in batches:
            row, ids = batch.column(0).to_numpy(), batch.column(1)
            for s in slices(batch.column(2)):
                owner, start, end = chunks = cuts(s, bits, least, most)
                cp = code_points(s.data)
                words, points = measured(s, start, end, cp)
                first, last, key = links(s, chunks, words, points, least_words)
                at = mix64(key) & mask
                hit = np.flatnonzero(table[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1)
                hit = hit[np.lexsort((last[hit], first[hit]))]
                hit = hit[long_runs(first[hit], last[hit], words, points, least_words)]
                a, b = first[hit], last[hit]
                view = s.data.tobytes()
                raw = b"".join([hashlib.blake2b(view[x:y], digest_size=16).digest() for x, y in zip(start[a].tolist(), end[b].tolist(), strict=True)])
                digest = np.frombuffer(raw, "<i8").reshape(-1, 2)
                # less than 4096 code points and words in a chunk
                place = (cp[start[a]].astype(np.int64) - cp[s.off[owner[a]]]) << 24 | points[a] << 12 | words[a]
                then = np.where(b > a, points[b] << 12 | words[b], 0)
                zero = np.zeros(s.n, np.int64)
                cols = [(row[s.lo + owner[a]], row[s.lo : s.hi]), (a - np.searchsorted(owner, owner[a]), zero - 1), (digest[:, 0], zero), (digest[:, 1], zero), (place, np.bincount(owner, minlength=s.n)), (then, zero)]
                arrays = [pa.array(np.concatenate(c).astype(k)) for c, k in zip(cols, (np.int64, np.int32, np.int64, np.int64, np.int64, np.int32), strict=True)]
                arrays.insert(1, pa.concat_arrays([ids.take(pa.array(s.lo + owner[a])), ids[s.lo : s.hi]]))
                yield pa.record_batch(arrays, names=[c.split()[0] for c in HITS.split(", ")])

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, HITS)


def repeats(docs: DataFrame, min_words: int = 20, bits: int = 5, least: int = 16, most: int = 96) -> DataFrame:
    """One row per document: its chunks, the repeated passages and what removing all but their first copies would take.

    A passage is a run of chunks whose links stand elsewhere too, of at least min_words words, where two code points of a
    script without blanks count as one, or of at least WIDE * min_words code points. Columns: doc_id, n_chunks,
    n_shared (chunks in passages), n_words_shared and spans (all repeated passages, start:end in code points),
    removed (the same for the parts that stood before), first_doc_ids (where these stand first), has_repeat.

    Two passes: the first counts short hashes of all links, 8 bytes each; the second moves only links that it found twice in
    runs long enough. What meets in one row at the end is bounded by that row's own text.
    """
    docs = pick(docs, "doc_id", "text")
    twice = materialise(_sized(docs, min_words, bits, least, most), "twice")
    hits = materialise(_hits(docs, bloom(twice, twice.count()), min_words, bits, least, most), "hits")
    link = hits.where("pos >= 0")
    at = F.struct("doc_id", "row", "pos")
    shared = materialise(link.groupBy("b1", "b2").agg(F.count(F.lit(1)).alias("copies"), F.min(at).alias("first")).where("copies > 1").select("b1", "b2", "first"), "shared")
    marked = attach(link, shared, ["b1", "b2"], 6 * shared.count())  # rows as wide as six keys
    hit = F.struct("pos", "place", "then", F.when(F.col("first") < at, F.col("first.doc_id")).alias("first"), (F.col("first") < at).alias("again"))
    kind = "struct<pos:int,place:bigint,then:int,first:bigint,again:boolean>"
    rows = marked.select("row", "doc_id", F.lit(0).cast("bigint").alias("n"), hit.alias("hit")).unionByName(hits.where("pos < 0").select("row", "doc_id", F.col("place").alias("n"), F.lit(None).cast(kind).alias("hit")))
    joined = rows.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n").alias("n"), F.sort_array(F.collect_list("hit")).alias("hits")).select("doc_id", "n", "hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chunks", "n_shared", "n_words_shared", "spans", "removed", "first_doc_ids", "has_repeat"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.bool_())
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                out = [passages(doc, n, found, min_words) for doc, n, found in zip(*(c.to_pylist() for c in whole.slice(lo, 500).columns), strict=True)]
                cols = list(zip(*out, strict=True)) or [()] * len(names)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return joined.mapInArrow(run, "doc_id bigint, n_chunks bigint, n_shared bigint, n_words_shared bigint, spans string, removed string, first_doc_ids array<bigint>, has_repeat boolean")


def passages(doc: int | None, n_chunks: int, hits: list[dict], min_words: int) -> tuple:
    """The row of one document from its shared links in order; first: the document of an earlier copy, again: whether there is one."""
    chunks: dict[int, list] = {}  # start, end, words, whether it stood before
    tied, firsts_of = set(), {}
    for h in hits:
        pos, start, n = h["pos"], h["place"] >> 24, h["place"] >> 12 & 4095
        parts = [(pos, start, n, h["place"] & 4095)]
        if h["then"]:
            tied.add(pos)
            parts.append((pos + 1, start + n, h["then"] >> 12, h["then"] & 4095))
        for k, a, size, words in parts:
            c = chunks.setdefault(k, [a, a + size, words, False])
            c[3] |= h["again"]
            if h["first"] is not None:
                firsts_of.setdefault(k, set()).add(h["first"])
    runs: list[list[int]] = []
    for k in sorted(chunks):
        if runs and runs[-1][-1] == k - 1 and k - 1 in tied:
            runs[-1].append(k)
        else:
            runs.append([k])
    runs = [r for r in runs if sum(chunks[k][2] for k in r) >= min_words or chunks[r[-1]][1] - chunks[r[0]][0] >= WIDE * min_words]
    spans, gone, firsts, words = [], [], set(), 0
    for r in runs:
        spans.append(f"{chunks[r[0]][0]}:{chunks[r[-1]][1]}")
        words += sum(chunks[k][2] for k in r)
        opened = closed = None
        for k in [*r, None]:
            if k is not None and chunks[k][3]:
                firsts |= firsts_of.get(k, set())
                opened = chunks[k][0] if opened is None else opened
                closed = chunks[k][1]
            elif opened is not None:
                gone.append(f"{opened}:{closed}")
                opened = None
    return doc, n_chunks, sum(map(len, runs)), words, ",".join(spans), ",".join(gone), sorted(firsts), bool(runs)
