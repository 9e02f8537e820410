"""Secret scans: single-part patterns and multipart credential linking.

Every text is scanned for strong secrets (assignments, access identifiers, long hex strings). Weak parts (access
identifiers of other makes, 40-character keys, user and account names, endpoints) are reported only when complementary parts
co-occur: parts are intervals in their document, and an interval join within a scope (a bounded distance that doesn't cross a
blank line) links identifier + secret (+ endpoint). The join is a sweep over the sorted parts of one document, so hot
sources cost nothing extra and nothing is shuffled.

Null texts count as empty. Repeated rows are scanned separately. Positions are code points, ends exclusive. Extra columns
of the input are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quarrylex.llm.base import pick

BASE = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_HEXMAP = bytes(120 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
_RUN = b"x" * 32
#: Weak parts: (role, kind, cue that must occur in the lower-cased text, pattern).
_WEAK = (
    ("id", "client", "client_id", re.compile(r"client_id[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._-]{6,})", re.ASCII | re.IGNORECASE)),
    ("id", "user", "user", re.compile(r"\b(?:username|user|login)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._@-]{3,})", re.ASCII | re.IGNORECASE)),
    ("id", "account", "account", re.compile(r"\baccount(?:_id)?[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9-]{6,})", re.ASCII | re.IGNORECASE)),
    ("endpoint", "host", "host", re.compile(r"\b(?:host|hostname|endpoint)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9.-]+\.[A-Za-z]{2,}(?::[0-9]+)?)", re.ASCII | re.IGNORECASE)),
)
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-")
_URL_REST = re.compile(r"[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+", re.ASCII)
_KEY40 = re.compile(r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")
_KEYMAP = bytes(120 if chr(c).isascii() and (chr(c).isalnum() or chr(c) in "+/") else 32 for c in range(256))
_RUN40 = b"x" * 40
_BREAK = re.compile(r"\n[ \t]*\n")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the single-part matches, leftmost and non-overlapping per kind."""
    out: list[tuple[int, int, str]] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if _RUN in text.encode("utf-8", "replace").translate(_HEXMAP):
        out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], BASE.index(x[2])))


def urls(text: str) -> list[tuple[int, int]]:
    """Spans of a scheme of lower-case letters, digits and marks, ://, and what follows: found by the mark in the middle, so that long runs of letters cost nothing."""
    out, floor, at = [], 0, text.find("://")
    while at >= 0:
        a = at
        while a > floor and text[a - 1] in _SCHEME:
            a -= 1
        while a < at and not "a" <= text[a] <= "z":
            a += 1
        m = _URL_REST.match(text, at + 3) if a < at else None
        if m:
            out.append((a, m.end()))
            floor = m.end()
        at = text.find("://", m.end() if m else at + 3)
    return out


def weak_parts(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, role) of parts that are no secret alone."""
    low = text.lower()
    out = [(m.start(), m.end(), kind, role) for role, kind, cue, pattern in _WEAK if cue in low for m in pattern.finditer(text)]
    out += [(a, b, "url", "endpoint") for a, b in urls(text)]
    if _RUN40 in text.encode("utf-8", "replace").translate(_KEYMAP):
        out += [(m.start(), m.end(), "key40", "secret") for m in _KEY40.finditer(text)]
    return out


def link(strong: list[tuple[int, int, str]], weak: list[tuple[int, int, str, str]], text: str, scope: int) -> list[tuple[int, int, str]]:
    """Weak parts that an interval join links to complementary parts.

    A weak identifier needs a secret in its scope, a weak secret an identifier, an endpoint both. Strong matches take part:
    access identifiers as identifiers, assignments and hex strings as secrets.
    """
    if not weak:
        return []
    roles = {"access": "id", "assign": "secret", "hex": "secret"}
    parts = [(a, b, k, r) for a, b, k, r in weak] + [(a, b, k, roles[k]) for a, b, k in strong]
    breaks = [m.start() for m in _BREAK.finditer(text)]
    starts = {r: sorted((a, b) for a, b, _, x in parts if x == r) for r in ("id", "secret", "endpoint")}
    ends = {r: sorted((b, a) for a, b in rows) for r, rows in starts.items()}

    def near(a: int, b: int, role: str) -> bool:
        """Whether a part lies at most scope after or before, in the same block: no part holds a break, so the nearest tells."""
        block = bisect.bisect_right(breaks, a)
        k = bisect.bisect_left(starts[role], (b, -1))
        found = starts[role][k : k + 1]
        k = bisect.bisect_left(ends[role], (a + 1, -1))
        found = [x for x, _ in found if x - b <= scope] + [x for y, x in ends[role][max(k - 1, 0) : k] if a - y <= scope]
        return any(bisect.bisect_right(breaks, x) == block for x in found)

    needs = {"id": ("secret",), "secret": ("id",), "endpoint": ("id", "secret")}
    return [(a, b, k) for a, b, k, r in weak if all(near(a, b, x) for x in needs[r])]


def spans(text: str, scope: int = 400) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Single-part matches, and the linked weak parts."""
    strong = base_spans(text)
    taken = {(a, b) for a, b, _ in strong}
    linked = [x for x in link(strong, weak_parts(text), text, scope) if (x[0], x[1]) not in taken]
    return strong, sorted(set(linked))


def joined(rows: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in rows)


RESULT = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_linked bigint"


def scan(docs: DataFrame, scope: int = 400) -> DataFrame:
    """One row per document: counts of the single-part kinds, digest of their spans, all spans, linked weak parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                strong, linked = spans(cell.as_py() or "", scope)
                kinds = [k for _, _, k in strong]
                every = sorted(strong + linked, key=lambda x: (x[0], (*BASE, x[2]).index(x[2]), x[2]))
                rows.append((doc, *(kinds.count(k) for k in BASE), hashlib.sha256(joined(strong).encode()).hexdigest(), joined(every), len(linked)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds_ = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds_, strict=True)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"])

    return pick(docs, "doc_id", "text").mapInArrow(run, RESULT)


def redact(text: str, mark: str = "[SECRET]", scope: int = 400) -> str:
    """The text with every reported span, overlapping ones merged, replaced by a mark."""
    strong, linked = spans(text, scope)
    out, at = [], 0
    for a, b, _ in sorted(strong + linked):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def redacted(docs: DataFrame, mark: str = "[SECRET]", scope: int = 400) -> DataFrame:
    """The documents with their secrets masked; all other columns and all rows stay, null texts stay null."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([None if (t := cell.as_py()) is None else redact(t, mark, scope) for cell in batch.column(at)], pa.string())
            columns = batch.columns
            yield pa.RecordBatch.from_arrays([*columns[:at], text, *columns[at + 1 :]], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
