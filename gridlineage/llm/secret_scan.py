"""Secret scans: fixed patterns, and sliding-window entropy per character class.

A candidate is a run of a class's characters of at least a window.  A window moves along
it; the sum of c * log2(c) over the character counts is updated for the character that
enters and the one that leaves, so that each step costs the same.  Windows whose Shannon
entropy reaches the class's bound, and that mix letters and digits, are joined to spans.
Candidates on the allow-list (identifiers such as UUIDs, plain words joined by separators,
numbers and dates, marked samples) are suppressed, and so are spans that a pattern found.

Defined cases: a null or empty text has no span; offsets are code points of the whole text;
rows are independent, so ties, repeats and null ids need no rule; a table may be empty.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 20
KINDS = ("assign", "access", "hex", "entropy")
#: Class: candidates, least entropy of a window in bits.
CLASSES = (("hex", r"(?<![0-9A-Za-z])[0-9a-fA-F]{20,}(?![0-9A-Za-z])", 2.9), ("base64", r"[A-Za-z0-9+/_=-]{20,}", 3.8))
#: Fixed patterns of what is no secret; possessive, so that a long run of separators is read once.
ALLOW = (
    r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}",
    r"(?:[-_/+=]++|[A-Za-z]{1,40}(?![A-Za-z]))*+",
    r"[0-9+/_=-]+",
    r"(?:[A-Za-z]++|[0-9]{1,4})(?:[-_/=]++(?:[A-Za-z]++|[0-9]{1,4}))*+",
    r".*(?i:example|sample|dummy|xxxx).*",
)
MASK = "<SECRET>"


def patterns() -> tuple:
    """Compiled: assignments, access keys, hexadecimal runs, candidates by class, allow-list."""
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    # a greedy run that is too short hides no other match, so the least length can stand in the pattern
    return assign, re.compile(r"AKIA[A-Z0-9]{12,}"), re.compile(r"[0-9a-f]{32,}"), [(n, re.compile(p, re.A), h) for n, p, h in CLASSES], re.compile("|".join(f"(?:{p})" for p in ALLOW), re.A)


_READY: list = []
_COST = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def windows(text: str, start: int, end: int, least: float, width: int = WINDOW) -> list[tuple[int, int]]:
    """Joined windows of text[start:end] whose entropy is at least least and that mix letters and digits."""
    counts: dict[str, int] = {}
    total, digits, letters = 0.0, 0, 0
    base = math.log2(width)
    out: list[tuple[int, int]] = []
    for at in range(start, end):
        c = text[at]
        n = counts.get(c, 0)
        total += _COST[n + 1] - _COST[n]
        counts[c] = n + 1
        digits += c.isdigit()
        letters += c.isalpha()
        if at >= start + width:
            c = text[at - width]
            n = counts[c]
            total += _COST[n - 1] - _COST[n]
            counts[c] = n - 1
            digits -= c.isdigit()
            letters -= c.isalpha()
        first = at - width + 1
        if first >= start and digits >= 2 and letters >= 2 and base - total / width >= least:
            if out and first <= out[-1][1]:
                out[-1] = (out[-1][0], at + 1)
            else:
                out.append((first, at + 1))
    return out


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind."""
    if not text:
        return []
    if not _READY:
        _READY.append(patterns())
    assign, access, hexes, _, _ = _READY[0]
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in access.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in hexes.finditer(text)]
    return sorted(out)


def spans(text: str | None) -> list[tuple[int, int, int]]:
    """All spans: the fixed patterns' and the entropy method's."""
    found = base_spans(text)
    if not text:
        return found
    # the furthest end of the spans that start here or before: a window is known if it ends no later
    starts, ends = [s for s, _, _ in found], list(accumulate((e for _, _, e in found), max))
    known = lambda s, e: (k := bisect_right(starts, s)) and ends[k - 1] >= e
    more: list[tuple[int, int]] = []
    _, _, _, classes, allow = _READY[0]
    for _, candidates, least in classes:
        for m in candidates.finditer(text):
            if not allow.fullmatch(m[0]):
                more += [w for w in windows(text, m.start(), m.end(), least) if not known(*w)]
    joined: list[tuple[int, int]] = []
    for s, e in sorted(more):
        if joined and s <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(e, joined[-1][1]))
        else:
            joined.append((s, e))
    return sorted([*found, *((s, 3, e) for s, e in joined)])


def spell(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def masked(text: str | None) -> str | None:
    """The text with every span replaced by the mask."""
    found = spans(text)
    if not found:
        return text
    out, at = [], 0
    for s, _, e in found:
        if s >= at:
            out += [text[at:s], MASK]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, texts = [[], [], [], []], [], []
            for t in b.column("text"):
                found = spans(t.as_py())
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in found))
                digests.append(hashlib.sha256(spell([x for x in found if x[1] < 3]).encode()).hexdigest())
                texts.append(spell(found))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ids.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")


def mask(docs: DataFrame) -> DataFrame:
    """docs with every span of text masked and n_chars counted anew where it changed; rows and other columns as given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            texts = b.column(at).to_pylist()
            new = [masked(t) for t in texts]
            b = b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))
            n = b.schema.get_field_index("n_chars")
            if n >= 0:
                old = b.column(n).to_pylist()
                b = b.set_column(n, b.schema.field(n), pa.array([o if x == y or y is None else len(y) for o, x, y in zip(old, texts, new)], b.schema.field(n).type))
            yield b

    return docs.mapInArrow(run, docs.schema)
