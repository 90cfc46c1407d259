"""Secret scan: fixed patterns, and entropy windows over candidate strings.

A candidate is a run of the characters of one class. A window slides over it; the counts of its characters, and the
sum of c*log2(c) from which Shannon's entropy follows, are kept by adding the character that enters and taking out
the one that leaves. Windows at or over the class's threshold are merged into spans. Allow-listed candidates (paths,
URLs, uuid forms, all of one case and no digit) yield no entropy span. Examples and ascending runs clear the segment
between marks that holds them, or, in a segment of more than LONGEST characters, the windows that hold them; the rest of
the candidate is scanned. Base64 spans are taken outside of hex spans. Pattern spans are never suppressed.

Null text is empty. Each input row gives one row, repeated rows too; other columns are not read. An empty table gives
an empty result. Spans are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import batch

# fixed values
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)),
    ("access", re.compile(r"AKIA[A-Z0-9]+")),
    ("hex", re.compile(r"[0-9a-f]+")),
)
#: A text without such a match has no span of that kind: RE2 rules whole columns out before Python sees a text.
GATES = {
    "assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.=-]{6}",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
    "entropy": r"[A-Za-z0-9+/_-]{20}",
}
_HEX = re.compile(r"[0-9a-f]{24,}")


@dataclass(frozen=True)
class CharClass:
    """A class of characters, its window and the bits per character from which a window counts as random."""

    kind: str
    chars: re.Pattern
    window: int
    bits: float


CLASSES = (CharClass("entropy_hex", re.compile(r"[0-9A-Fa-f]{20,}"), 20, 3.0), CharClass("entropy_base64", re.compile(r"[A-Za-z0-9+/_-]{20,}"), 20, 3.8))
ORDER = {k: i for i, k in enumerate(("assign", "access", "hex", "entropy_hex", "entropy_base64"))}
ALLOW = (
    re.compile(r"[A-Z]?[a-z]+|[A-Z]+"),  # a word
    re.compile(r"(?:[A-Za-z]+[/_-])+[A-Za-z]*"),  # a path or compound of words
    re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}"),  # a uuid
    re.compile(r"[0-9/_+-]+"),  # digits and marks: dates, numbers, paths
)
EXAMPLE = re.compile(r"example|sample|0123456789|abcdefgh|xxxxxx", re.I)
SEGMENT = re.compile(r"[^/_+-]+")
LONGEST = 64  # characters of a segment that one example pattern clears as a whole


def base_spans(text: str, kinds=("assign", "access", "hex")) -> list[tuple[int, int, str]]:
    out = []
    if "assign" in kinds:
        out += [(m.start(), m.end(), "assign") for m in BASE[0][1].finditer(text) if len(m[2]) >= 6]
    if "access" in kinds:
        out += [(m.start(), m.end(), "access") for m in BASE[1][1].finditer(text) if m.end() - m.start() >= 20]
    if "hex" in kinds:  # the runs of 24 and more are the leftmost matches that stay
        out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def entropy_windows(s: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Merged windows of ``s`` whose entropy reaches ``bits``; incremental, so linear in the length."""
    if len(s) < window:
        return []
    nlog = [0.0] + [c * math.log2(c) for c in range(1, window + 2)]
    limit, counts, total, out = (math.log2(window) - bits) * window + 1e-9, {}, 0.0, []
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        total += nlog[c + 1] - nlog[c]
        counts[ch] = c + 1
        if i >= window:
            old = s[i - window]
            c = counts[old]
            total += nlog[c - 1] - nlog[c]
            counts[old] = c - 1
        if i >= window - 1 and total <= limit:
            lo = i - window + 1
            if out and lo <= out[-1][1]:
                out[-1][1] = i + 1
            else:
                out.append([lo, i + 1])
    return [(a, b) for a, b in out]


def scanned(s: str) -> list[tuple[int, int]]:
    """The parts of a candidate whose windows count: all of it, but for examples."""
    if not EXAMPLE.search(s):
        return [(0, len(s))]
    out, lo = [], 0
    for seg in SEGMENT.finditer(s):
        marks = list(EXAMPLE.finditer(s, seg.start(), seg.end()))
        if marks and len(seg[0]) <= LONGEST:
            out.append((lo, seg.start()))
            lo = seg.end()
        else:
            for m in marks:  # parts overlap, so that all windows but those that hold the mark are in one
                out.append((lo, m.end() - 1))
                lo = m.start() + 1
    return [*out, (lo, len(s))]


def outside(lo: int, hi: int, holes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of lo..hi between ``holes``, which are in order and do not overlap."""
    out = []
    for a, b in holes[max(0, bisect_left(holes, (lo, lo)) - 1) : bisect_left(holes, (hi, hi))]:
        if a < hi and lo < b:
            out.append((lo, a))
            lo = b
    return [*out, (lo, hi)]


def entropy_spans(text: str) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    hexes: list[tuple[int, int]] = []
    for cls in CLASSES:
        for m in cls.chars.finditer(text):
            if any(p.fullmatch(m[0]) for p in ALLOW):
                continue
            within = hexes[bisect_left(hexes, (m.start(), 0)) : bisect_left(hexes, (m.end(), 0))]
            found: list[list[int]] = []
            for a, b in scanned(m[0]):
                if (a, b) != (0, len(m[0])) and any(p.fullmatch(m[0][a:b].strip("/_+-")) for p in ALLOW):
                    continue
                for x, y in outside(m.start() + a, m.start() + b, within):
                    for c, d in entropy_windows(text[x:y], cls.window, cls.bits):
                        if found and x + c <= found[-1][1]:
                            found[-1][1] = x + d
                        else:
                            found.append([x + c, x + d])
            out += [(a, b, cls.kind) for a, b in found]
        hexes = [(a, b) for a, b, _ in out]
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], ORDER[x[2]], x[1])))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_entropy", pa.int64())])
DDL = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"
_EMPTY = hashlib.sha256(b"").hexdigest()


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = b.num_rows
        text = pc.fill_null(b.column(1), "")
        hit = {k: pc.match_substring_regex(text, p) for k, p in GATES.items()}
        rows = pc.indices_nonzero(pc.or_(pc.or_(hit["assign"], hit["access"]), pc.or_(hit["hex"], hit["entropy"]))).to_pylist()
        counts, sha, spans = {k: [0] * n for k in ("assign", "access", "hex", "entropy")}, [_EMPTY] * n, [""] * n
        for r in rows:
            t = text[r].as_py()
            base = base_spans(t, [k for k in ("assign", "access", "hex") if hit[k][r].as_py()])
            more = entropy_spans(t) if hit["entropy"][r].as_py() else []
            for _, _, k in base:
                counts[k][r] += 1
            counts["entropy"][r] = len(more)
            sha[r], spans[r] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)
        yield batch(SCHEMA, doc_id=b.column(0), n_assign=counts["assign"], n_access=counts["access"], n_hex=counts["hex"], base_sha256=sha, spans=spans, n_entropy=counts["entropy"])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document with its secrets; one pass, no shuffle."""
    return docs.select("doc_id", "text").mapInArrow(scan_batches, DDL)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
