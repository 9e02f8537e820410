"""Personal data by anchor expansion.

One Aho-Corasick pass finds the anchors of a text: at-signs, schemes of personal addresses and identifier cues. Small
deterministic parsers expand each anchor to both sides and validate what they find (e-mail addresses, personal URIs, account
numbers, IBANs, social security numbers). Runs of digits are the anchors of IP addresses, cards and phone numbers.

Base kinds are exactly the leftmost, non-overlapping matches of their patterns; further kinds only add spans. Null texts
count as empty, repeated rows are scanned separately, extra columns are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from quarrylex.llm.base import pick

BASE = ("email", "ip", "card", "phone")
MORE = ("account", "address", "iban", "ssn")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_REGION = re.compile(r"[0-9+][0-9 ().+-]{6,}")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # as the base pattern, whose matches start at runs of digits, in linear time
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_SCHEMES = ("mailto:", "tel:", "sip:", "sips:", "xmpp:", "acct:", "skype:", "://")
_CUES = {"account": ("account number", "account no", "acct no", "acct", "customer id", "member id", "account"), "iban": ("iban",), "ssn": ("ssn", "social security number", "social security")}
_SEP = re.compile(r"[ \t]*(?:(?:is|number|no\.?|nr\.?)[ \t]*)?[:#=]?[ \t]*", re.IGNORECASE)
_ACCOUNT = re.compile(r"[A-Z]{0,4}[0-9](?:[ -]?[0-9]){5,19}(?![A-Za-z0-9])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"([0-9]{3})[- ]([0-9]{2})[- ]([0-9]{4})(?![0-9])")
_URI_END = re.compile(r"[^\s<>\"'`{}|\\^\[\]]+")
_TEL_END = re.compile(r"[A-Za-z0-9+().;=_-]+")
_USERINFO = re.compile(r"[^/?#@\s<>\"'`{}|\\^\[\]]++@[^/?#@\s<>\"'`{}|\\^\[\]]")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    for s in _SCHEMES:
        a.add_word(s, ("scheme", len(s)))
    for kind, cues in _CUES.items():
        for cue in cues:
            for form in (cue, cue.upper(), cue.capitalize(), cue.title()):
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


_anchors: list[ahocorasick.Automaton] = []


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban_valid(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def numbers(text: str) -> list[tuple[str, int, int]]:
    """ip, card and phone spans; every match of their patterns lies in one maximal run of digits, blanks and marks."""
    out = []
    for region in _REGION.finditer(text):
        at, run = region.start(), region.group()
        for m in _IP.finditer(run):
            if all(len(p) < 4 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m.group().split("."))):
                out.append(("ip", at + m.start(), at + m.end()))
        for m in _CARD.finditer(run):
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", at + m.start(), at + m.end()))
        if "+" in run:
            for m in _PHONE.finditer(run):
                if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    out.append(("phone", at + m.start(), at + m.end()))
    return out


def email_at(text: str, sign: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign, no part of it before floor."""
    a = sign
    while a > floor and text[a - 1] in _LOCAL:
        a -= 1
    m = _DOMAIN.match(text, sign + 1) if a < sign else None
    return (a, m.end()) if m else None


def address_at(text: str, end: int, scheme: str) -> tuple[int, int] | None:
    """A URI of a personal scheme, or one that names a user before its host."""
    a = end - len(scheme)
    if scheme == "://":
        while a > 0 and (c := text[a - 1]).isascii() and (c.isalnum() or c in "+.-"):
            a -= 1
        if a == end - 3:
            return None
    elif a > 0 and text[a - 1].isalnum():
        return None
    if scheme == "://" and not _USERINFO.match(text, end):
        return None
    m = (_TEL_END if scheme == "tel:" else _URI_END).match(text, end)
    if not m:
        return None
    b = m.end()
    while b > end and text[b - 1] in ".,;:!?)":
        b -= 1
    if scheme == "://":
        ok = _USERINFO.match(text, end, b) is not None
    elif scheme == "tel:":
        ok = len(_NOT_DIGIT.sub("", text[end:b])) >= 5
    else:
        ok = b - end >= 3
    return (a, b) if ok else None


def identifier_at(text: str, kind: str, start: int, end: int) -> tuple[int, int] | None:
    """The number after a cue: an account of 6 to 20 digits, an IBAN with valid check digits, a possible SSN."""
    if start > 0 and text[start - 1].isalnum():
        return None
    m = {"account": _ACCOUNT, "iban": _IBAN, "ssn": _SSN}[kind].match(text, _SEP.match(text, end).end())
    if not m:
        return None
    if kind == "iban" and not iban_valid(m.group()):
        return None
    if kind == "ssn" and (m.group(1) in ("000", "666") or m.group(1)[0] == "9" or m.group(2) == "00" or m.group(3) == "0000"):
        return None
    return m.span()


def spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and the further ones; each by kind as listed, then start."""
    if not _anchors:
        _anchors.append(_automaton())
    base, more, floor, inside = numbers(text), set(), 0, 0
    for last, (kind, n) in _anchors[0].iter(text):
        if kind == "@":
            if found := email_at(text, last, floor):
                base.append(("email", *found))
                floor = found[1]
        elif kind == "scheme":  # not again within an address
            if last >= inside and (found := address_at(text, last + 1, text[last + 1 - n : last + 1])):
                more.add(("address", *found))
                inside = found[1]
        elif found := identifier_at(text, kind, last + 1 - n, last + 1):
            more.add((kind, *found))
    return sorted(base, key=lambda x: (BASE.index(x[0]), x[1])), sorted(more)


def joined(rows: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in rows)


RESULT = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_more bigint, n_spans bigint"
_EMPTY = hashlib.sha256(b"").hexdigest()


def find(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                base, more = spans(cell.as_py() or "")
                kinds = [x[0] for x in base]
                rows.append((doc, *(kinds.count(k) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest() if base else _EMPTY, joined(base + more), len(more), len(base) + len(more)))
            cols = list(zip(*rows, strict=True)) or [()] * 9
            kinds_ = (*[pa.int64()] * 5, pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds_, strict=True)], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_more", "n_spans"])

    return pick(docs, "doc_id", "text").mapInArrow(run, RESULT)


def masked(text: str) -> str:
    """The text with every span, overlapping ones merged, replaced by its kind in brackets."""
    base, more = spans(text)
    out, at = [], 0
    for kind, a, b in sorted(base + more, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text
