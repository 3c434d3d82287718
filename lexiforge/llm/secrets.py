"""Secret scans: fixed forms of credentials, and sliding-window Shannon entropy over candidate strings.

Candidates are runs of at least ``WINDOW`` characters of base64 and hexadecimal. A window slides over each, its entropy
kept by incremental counts; windows above the class's threshold are joined to spans of kind ``entropy``. The class is that
of the candidate's characters. An allow-list suppresses what is no secret: candidates that are wholly a word or number,
windows that touch an identifier, and windows that touch a part (between signs) with a placeholder word; of a part above
``LONG`` characters, where such a word may stand by chance, only those that touch the word. It never suppresses spans of the
fixed forms. An entropy span within one of these is not reported again.

Null text is empty; rows are scanned one by one, so repeats and ties need no rule; a text of any length is scanned whole, in
linear time. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.shared import arrow_map
from lexiforge.llm.words import as_strings, blocks, words

WINDOW = 20
#: Bits below which a window of each class is no secret: 20 random characters have about 3.3 (hex) and 4.1 (base64).
#: lower, upper: one case with digits; letters, digits: only those and signs.
MIN_BITS = {"hex": 2.9, "base64": 3.75, "lower": 3.75, "upper": 3.75, "letters": 3.9, "digits": 3.1}
LONG = 64
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class AllowList:
    """Patterns, without regard to case: for whole candidates, for identifiers in them, and for placeholder words."""

    wholes: tuple[str, ...] = (r"[A-Za-z]+(?:[-_/][A-Za-z]+)*", r"[0-9]+(?:[-_/][0-9]+)*")  # words joined by signs; numbers, dates
    inside: tuple[str, ...] = (r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",)  # UUIDs
    words: tuple[str, ...] = ("example", "sample", "placeholder", "changeme", "dummy", "redacted", "xxxx", "lorem", "test")

    def compiled(self) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
        made = ("|".join(f"(?:{p})" for p in patterns) or r"(?!)" for patterns in (self.wholes, self.inside, self.words))
        return tuple(re.compile(p, re.I | re.A) for p in made)


_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
_PART = re.compile(r"[+/_=-]")
_ALL_HEX = re.compile(r"[0-9a-fA-F]+")

_CODE = np.zeros(256, bool)
_CODE[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(":"), ord("=")]] = True


def entropy_windows(s: str, size: int = WINDOW) -> list[float]:
    """Shannon entropy in bits of each window, from counts that change by two characters a step."""
    if len(s) < size:
        return []
    weigh = [0.0, *(c * math.log2(c) for c in range(1, size + 2))]
    counts: dict[str, int] = {}
    total = 0.0
    out = []
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += weigh[n + 1] - weigh[n]
        if i >= size:
            old = s[i - size]
            n = counts[old]
            counts[old] = n - 1
            total += weigh[n - 1] - weigh[n]
        if i >= size - 1:
            out.append(math.log2(size) - total / size)
    return out


def class_of(s: str) -> str:
    if _ALL_HEX.fullmatch(s):
        return "hex"
    digit, lower, upper = (any(f(c) for c in s) for f in (str.isdigit, str.islower, str.isupper))
    if not digit:
        return "letters"
    if not lower and not upper:
        return "digits"
    return "base64" if lower and upper else "lower" if lower else "upper"


def _left_out(s: str, inside: re.Pattern, placeholder: re.Pattern) -> list[tuple[int, int]]:
    """Places of a candidate that no window may touch."""
    out = [(m.start(), m.end()) for m in inside.finditer(s)]
    for m in placeholder.finditer(s):
        near = s[max(m.start() - LONG, 0) : m.start()], s[m.end() : m.end() + LONG]
        start, end = m.start() - len(_PART.split(near[0])[-1]), m.end() + len(_PART.split(near[1])[0])
        out.append((start, end) if end - start <= LONG else (m.start(), m.end()))
    return out


def entropy_spans(text: str, allow: tuple[re.Pattern, re.Pattern, re.Pattern], min_bits: dict[str, float]) -> Iterator[tuple[int, int]]:
    """Spans in order of start."""
    wholes, inside, placeholder = allow
    for m in _CANDIDATE.finditer(text):
        s = m[0]
        if wholes.fullmatch(s):
            continue
        least, closed = min_bits[class_of(s)], bytearray(len(s))
        for a, b in _left_out(s, inside, placeholder):
            first = max(a - WINDOW + 1, 0)
            closed[first:b] = b"\1" * (b - first)
        start = end = -1
        for i, bits in enumerate(entropy_windows(s)):
            if bits < least or closed[i]:
                continue
            if start >= 0 and i > end:
                yield m.start() + start, m.start() + end
                start = -1
            start = i if start < 0 else start
            end = i + WINDOW
        if start >= 0:
            yield m.start() + start, m.start() + end


def scan_text(text: str, coded: bool, signed: bool, allow: tuple[re.Pattern, re.Pattern, re.Pattern], min_bits: dict[str, float]) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all spans. coded, signed: whether the text has a long run and a sign of assignment."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if signed else []
    if coded:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if len(m[0]) >= 24]
        base, at, reached = sorted(found), 0, -1
        for a, b in entropy_spans(text, allow, min_bits):
            while at < len(base) and base[at][0] <= a:
                reached = max(reached, base[at][2])
                at += 1
            if b > reached:  # else within a span of a fixed form
                found.append((a, 3, b))
    return sorted(found)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(allow: AllowList, min_bits: dict[str, float]):
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = allow.compiled()
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            texts = as_strings(batch.column(1))
            counts, digests, spans = np.zeros((4, len(texts)), np.int64), [nothing] * len(texts), [""] * len(texts)
            for block in blocks(texts):
                runs = words(block, _CODE)
                coded = set((block.first + runs.row[runs.ends - runs.starts >= WINDOW]).tolist())
                signed = set((block.first + np.searchsorted(block.offsets, np.flatnonzero(_SIGN[block.data]), "right") - 1).tolist())
                for i in coded | signed:
                    found = scan_text(texts[i].as_py(), i in coded, i in signed, rules, min_bits)
                    for _, k, _ in found:
                        counts[k, i] += 1
                    digests[i] = hashlib.sha256(_joined([x for x in found if x[1] < 3]).encode()).hexdigest()
                    spans[i] = _joined(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in counts), pa.array(digests), pa.array(spans)], names)

    return run


def scan_secrets(docs: DataFrame, allow: AllowList = AllowList(), min_bits: dict[str, float] | None = None) -> DataFrame:
    """Spans of each of docs (doc_id, text); positions count code points, ends are exclusive."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _scan(allow, MIN_BITS | (min_bits or {})), schema)
