"""Best-fit packing with swap-based local search.

Texts become token ids (plus an end id); only documents longer than a sequence are cut, so that every piece but the first is
full. Full pieces are sequences already. The rest are dealt by a hash of their row into groups of bounded size; in each
group best-fit decreasing gives a start, and local search (moves, one-for-one and two-for-one exchanges that increase the
sum of squared fill) empties underfull bins. The emptiest bin of each group is opened again, and what was in these bins is
packed together, group by group, until one group is left.

Null and empty texts have one token (the end id). Repeated rows with the same doc_id are packed as separate pieces. Empty
tables give empty results. Extra columns of the input are ignored.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylex.llm.base import pick

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACED = PIECES + ", sequence_id bigint, offset bigint"
_encoders: dict[str, object] = {}


class Encoder:
    """ids of the byte-level BPE file: the fast path uses the same vocabulary as ranks, with the JSON file for the rest."""

    def __init__(self, json_path: str, rank_path: str):
        import public_tokenizers
        import tiktoken

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self.exact = json_path, None

    def __call__(self, text: str) -> np.ndarray:
        if "<|endoftext|>" in text:  # the JSON file makes one id of it; loaded where it is needed only, for it takes 50 MB
            if self.exact is None:
                from tokenizers import Tokenizer

                self.exact = Tokenizer.from_file(self.json_path)
            return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(self.fast.encode_to_numpy(text), np.uint32)


def encoder(json_path: str | None = None, rank_path: str | None = None) -> Encoder:
    import public_tokenizers

    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    rank_path = rank_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if json_path not in _encoders:
        _encoders[json_path] = Encoder(str(json_path), str(rank_path))
    return _encoders[json_path]


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the first may be shorter, all others are full."""
    first = n % capacity or min(n, capacity)
    if first:
        yield 0, first
    for at in range(first, n, capacity):
        yield at, capacity


def pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, json_path: str | None = None, rank_path: str | None = None) -> DataFrame:
    """One row per piece with its place in the document, length and the CRC-32 of its little-endian ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, rank_path)
        tail = np.asarray([end_id], np.uint32)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.concatenate([encode(text.as_py() or ""), tail]).astype("<u4")
                for k, (at, n) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc.as_py(), k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return pick(docs, "doc_id", "text").mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of item numbers; a sorted list of (free, bin) finds the tightest bin."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect.bisect_left(free, (n, -1))
        if at == len(free):
            bins.append([i])
            left, b = capacity - n, len(bins) - 1
        else:
            left, b = free.pop(at)
            bins[b].append(i)
            left -= n
        if left:
            bisect.insort(free, (left, b))
    return bins


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int, rounds: int = 4, pool: int = 256) -> list[list[int]]:
    """Swap-based local search over the underfull bins.

    The emptiest bin is the donor. An item of it moves to a bin that has room; or is exchanged one-for-one for a smaller
    item, or for two smaller items that together are still shorter, of a bin whose room fits the difference. Each step
    raises the sum of squared fill (a fuller bin gets fuller), so the donor drains until it is empty or stuck. The room of
    all bins bounds how many can be emptied at all; a few more donors than that are tried, with at most pool partners each.
    """
    size = lengths.tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    for _ in range(rounds):
        under = sorted((b for b in range(len(bins)) if bins[b] and fill[b] < capacity), key=lambda b: (fill[b], b))
        spare = sum(capacity - fill[b] for b in under) // capacity
        if not spare:
            break
        changed = False
        for d in under[: 2 * spare + 8]:
            if not bins[d] or fill[d] == capacity:
                continue
            partners = [b for b in reversed(under) if b != d and bins[b] and fill[b] < capacity and fill[b] >= fill[d]][:pool]
            for p in partners:
                room = capacity - fill[p]
                if room <= 0 or not bins[d]:
                    continue
                step = _exchange(bins[d], bins[p], size, room, fill[p] - fill[d])
                if step is None:
                    continue
                give, take = step
                for i in give:
                    bins[d].remove(i)
                    bins[p].append(i)
                for i in take:
                    bins[p].remove(i)
                    bins[d].append(i)
                gain = sum(size[i] for i in give) - sum(size[i] for i in take)
                fill[d] -= gain
                fill[p] += gain
                changed = True
        if not changed:
            break
    return [b for b in bins if b]


def _exchange(donor: list[int], partner: list[int], size: list[int], room: int, lead: int) -> tuple[list[int], list[int]] | None:
    """The step with the largest gain up to room: a move, one-for-one, two-for-one (either way round)."""
    best, gain = None, 0
    for i in donor:
        if gain < size[i] <= room:
            best, gain = ([i], []), size[i]
    if gain == room:
        return best
    theirs = sorted(partner, key=size.__getitem__)
    lens = [size[j] for j in theirs]
    for i in donor:
        k = bisect.bisect_left(lens, size[i] - room)
        if k < len(lens) and gain < size[i] - lens[k] <= room:
            best, gain = ([i], [theirs[k]]), size[i] - lens[k]
        lo, hi = 0, len(lens) - 1  # two of theirs for one of ours
        while lo < hi:
            diff = size[i] - lens[lo] - lens[hi]
            if gain < diff <= room:
                best, gain = ([i], [theirs[lo], theirs[hi]]), diff
            if diff > room:
                lo += 1
            else:
                hi -= 1
        if gain == room:
            return best
    for a in range(len(donor)):  # two of ours for one of theirs
        for b in range(a + 1, len(donor)):
            both = size[donor[a]] + size[donor[b]]
            k = bisect.bisect_left(lens, both - room)
            if k < len(lens) and gain < both - lens[k] <= room:
                best, gain = ([donor[a], donor[b]], [theirs[k]]), both - lens[k]
    return best


def pack_group(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item of one group."""
    bins = improve(best_fit(lengths, capacity), lengths, capacity)
    which, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, items in enumerate(bins):
        at = 0
        for i in items:
            which[i], offset[i] = b, at
            at += int(lengths[i])
    return which, offset


def pack(parts: DataFrame, capacity: int = 2048, group_rows: int = 16_384) -> DataFrame:
    """Place pieces (doc_id, piece, start, length, ids_crc32) into sequences of at most capacity tokens, gapless from 0.

    parts is counted once to fix the number of groups; only 5 numbers a piece are shuffled, never texts or ids.
    """
    from quarrylex.llm.base import materialise

    def placer(turn: int, groups: int):
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = list(batches)
            if not tables:
                return
            t = pa.Table.from_batches(tables).combine_chunks()
            group, length = t["g"].to_numpy(), t["length"].to_numpy()
            order = np.lexsort((t["piece"].to_numpy(), t["doc_id"].to_numpy(), group))
            seq, off, left = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64), np.zeros(len(group), bool)
            bounds = np.flatnonzero(np.diff(group[order], prepend=-1))
            for lo, hi in zip(bounds, [*bounds[1:], len(order)], strict=True):
                rows = order[lo:hi]
                which, at = pack_group(length[rows], capacity)
                fill = np.bincount(which, weights=length[rows])
                seq[rows], off[rows] = turn << 56 | (int(group[rows[0]]) << 24) + which, at
                left[rows] = (groups > 1) & (which == fill.argmin()) & (fill.min() < capacity)
            t = t.drop_columns(["g"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off)).append_column("left", pa.array(left))
            yield from t.to_batches(65_536)

        return place

    rest, done, turn = materialise(parts, "pieces"), None, 0
    n = rest.count()
    while True:
        groups = max(1, -(-n // group_rows))
        # by row, since pieces that are all alike would fall into one group by their columns
        dealt = rest.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
        placed = dealt.repartition(groups, "g").mapInArrow(placer(turn, groups), PLACED + ", left boolean")
        again = 0
        if groups > 1:
            placed = materialise(placed, "placed")
            again = placed.where("left").count()
        last = again * 2 > n or not again  # groups of little more than one bin gain nothing
        stay = placed.drop("left") if last else placed.where("not left").drop("left")
        done = stay if done is None else done.unionByName(stay)
        if last:
            return done
        rest, n, turn = placed.where("left").drop("left", "sequence_id", "offset"), again, turn + 1
