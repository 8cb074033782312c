"""Secret scan: every rule in one byte pass of a combined, minimised automaton (see automaton.py).

Base kinds, leftmost and non-overlapping per kind, failing matches dropped: assign, access, hex. More rules add
spans of their own kinds and leave the base ones alone. Offsets are code points, ends exclusive. A null text is
empty; a row with a null doc_id keeps it; repeated rows give repeated results; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.automaton import Scanner


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_VALUE = "[A-Za-z0-9+/_.=-]"
_KEYWORDS = "|".join([*(_either_case(w) for w in ("password", "passwd", "secret", "token")), f"{_either_case('api')}_?{_either_case('key')}"])
#: kind, pattern, least characters of a match (of the value for assign). The automaton takes shorter runs too, which
#: are dropped afterwards: counting to 32 in it would multiply its states. Hex runs under 8 never count as found.
RULES = (
    ("assign", f"({_KEYWORDS})[\"']?\\x20*[:=]\\x20*[\"']?{_VALUE}+", 8),
    ("access", "AKIA[A-Z0-9]+", 16),
    ("hex", "[0-9a-f]{8,}", 32),
    ("forge", "gh[opsur]_[A-Za-z0-9]+", 40),
    ("chat", "xox[abprs]-[A-Za-z0-9-]+", 15),
    ("pem", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", 27),
)
KINDS = [k for k, _, _ in RULES]
BASE = 3
_VALUE_BYTES = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner([p for _, p, _ in RULES])


def _value_length(data: bytes, start: int, end: int) -> int:
    """Of an assign match, the characters of its value: what follows its first : or =, blanks and a quote."""
    at = min(x for x in (data.find(b":", start, end), data.find(b"=", start, end)) if x >= 0) + 1
    while data[at] == 0x20:
        at += 1
    return end - at - (data[at] not in _VALUE_BYTES)


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, rule, end) in code points, by start, then rule."""
    data = text.encode()
    found = []
    for rule, start, end in scanner().spans(data):
        length = _value_length(data, start, end) if rule == 0 else end - start
        if length >= RULES[rule][2]:
            found.append((start, rule, end))
    if len(data) != len(text):
        found = _in_code_points(data, sorted(found))
    return sorted(found)


def _in_code_points(data: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets, ascending, as code points, in one walk over the text; matches are ASCII."""
    out, at, points = [], 0, 0
    for start, rule, end in found:
        points += len(data[at:start].decode())
        at = start
        out.append((points, rule, points + end - start))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[r]}:{s}:{e}" for s, r, e in spans)


def scan(documents: DataFrame) -> DataFrame:
    """Counts, digest and spans per document; a narrow pass, so a hot source or copies don't matter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                spans = find_secrets(text or "")
                base = [x for x in spans if x[1] < BASE]
                n = [sum(x[1] == k for x in base) for k in range(BASE)]
                rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield out

    kept = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return kept.mapInPandas(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
