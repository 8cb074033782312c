"""SimHash near-duplicates by anchor-point covering.

A document's fingerprint holds a bit where over half of its shingles' 64-bit hashes hold it. Equal fingerprints
are merged first, so copies never meet again. Two blocks of 23 fingerprint bits are covered by the perfect binary
Golay code (12 information bits, covering radius 3): every block lies within 3 bits of exactly one code word, and
a pair of code words is an anchor. Each fingerprint is at home at its nearest anchor and is replicated to every
anchor within the covering radius plus the linking threshold (61 on average, shared over both blocks). Fingerprints
that differ in `threshold` bits meet at the home anchor of either one, so comparing homes with replicas per anchor
finds every link. Each task keeps of its links only a spanning forest, which connects the same fingerprints, and
components are joined by the distributed star algorithm in components.py.

Defined cases: a null or empty text has the fingerprint zero and links like any other; a null doc_id is carried
with its fingerprint and takes part, but isn't a candidate for the smallest id (a component of nulls has null).
Repeated rows repeat in the result. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import LOWER, UPPER, persisted, scratch
from factloom.llm.components import components, spanning_edges

SHINGLE_WORDS = 3
THRESHOLD = 2
SEED = 42
BLOCK_BITS = 23
RADIUS = 3
#: The generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
_CHECK_BITS = 11
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TO_LOWER = str.maketrans(UPPER, LOWER)
_COMPARED = 1 << 22
_HASHED = 1 << 15


def shingles(text: str, words: int = SHINGLE_WORDS) -> list[str]:
    found = _WORD.findall(text.translate(_TO_LOWER) if not text.isascii() else text.lower())
    if len(found) <= words:
        return [" ".join(found)] if found else []
    return list(map(" ".join, zip(*(found[k:] for k in range(words)), strict=False)))


def majority(hashes: np.ndarray) -> int:
    """Of 64-bit hashes (unsigned) the bits that over half of them hold; 0 of none."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _HASHED):
        counts += np.unpackbits(hashes[at : at + _HASHED].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """As an unsigned integer; bit k stands for the hashes' bit of value 2**k."""
    parts = shingles(text, words)
    if not parts:
        return 0
    counts, n = np.zeros(64, dtype=np.int64), len(parts)
    for at in range(0, n, _HASHED):
        digests = b"".join(xxhash.xxh64_digest(p.encode(), seed=SEED) for p in parts[at : at + _HASHED])  # big-endian
        counts += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(documents: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    kept = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return kept.mapInArrow(run, "doc_id long, fp long")


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders modulo the generator: equal ones differ by a code word."""
    rest = words.astype(np.int64).copy()
    for bit in range(BLOCK_BITS - 1, _CHECK_BITS - 1, -1):
        rest ^= np.where((rest >> bit) & 1, GENERATOR << (bit - _CHECK_BITS), 0)
    return rest


@lru_cache(maxsize=1)
def _coset_table(threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per syndrome the error patterns up to the radius plus threshold, lightest first: starts, counts, patterns, bits
    beyond the radius. A block minus such a pattern is a code word that near."""
    near = np.array([sum(1 << b for b in bits) for n in range(RADIUS + threshold + 1) for bits in combinations(range(BLOCK_BITS), n)], dtype=np.int64)
    weights, of = np.bitwise_count(near).astype(np.int64), _syndromes(near)
    order = np.lexsort((weights, of))
    counts = np.bincount(of, minlength=1 << _CHECK_BITS)
    return np.cumsum(counts) - counts, counts, near[order], np.maximum(weights[order] - RADIUS, 0)


def _expanded(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of a table: which range each entry comes from, and its place in the table."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


def anchors(fps: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home anchor of each, row and anchor of every replica) of unsigned fingerprints."""
    starts, counts, patterns, beyond = _coset_table(threshold)
    mask = (1 << BLOCK_BITS) - 1
    bits = fps.astype(np.uint64)
    a, b = (bits & np.uint64(mask)).astype(np.int64), ((bits >> np.uint64(BLOCK_BITS)) & np.uint64(mask)).astype(np.int64)
    sa, sb = _syndromes(a), _syndromes(b)
    home = ((a ^ patterns[starts[sa]]) << BLOCK_BITS) | (b ^ patterns[starts[sb]])
    row, at = _expanded(starts[sa], counts[sa])
    first, used = a[row] ^ patterns[at], beyond[at]
    # of each block's list (lightest first) only what the threshold still allows: counts by remaining bits
    by_bits = np.zeros((threshold + 1, len(counts)), dtype=np.int64)
    coset = np.repeat(np.arange(len(counts)), counts)
    for t in range(threshold + 1):
        by_bits[t] = np.bincount(coset[beyond <= t], minlength=len(counts))
    sb_row = sb[row]
    row2, at2 = _expanded(starts[sb_row], by_bits[threshold - used, sb_row])
    return home, row[row2], (first[row2] << BLOCK_BITS) | (b[row[row2]] ^ patterns[at2])


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for at in range(0, len(fps), 4096):
            part = fps[at : at + 4096]
            home, row, anchor = anchors(part.view(np.uint64))
            out = [np.concatenate([home, anchor]), np.concatenate([part, part[row]]), np.arange(len(home) + len(row)) >= len(home)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["anchor", "fp", "replica"])


def _links(homes: np.ndarray, replicas: np.ndarray, threshold: int) -> np.ndarray:
    """Links between fingerprints of one anchor, as a spanning forest, in blocks of bounded size."""
    forest = np.empty((0, 2), dtype=np.int64)
    step = max(1, _COMPARED // max(1, len(replicas)))
    for at in range(0, len(homes), step):
        differ = np.bitwise_count((homes[at : at + step, None] ^ replicas[None, :]).view(np.uint64))
        h, r = np.nonzero((differ > 0) & (differ <= threshold))
        forest = spanning_edges(np.concatenate([forest, np.stack([homes[at + h], replicas[r]], axis=1)]))
    return forest


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, replica): of each anchor the homes come first and stay, replicas stream past them."""
    homes, anchor, forest = np.empty(0, dtype=np.int64), None, np.empty((0, 2), dtype=np.int64)
    for batch in batches:
        at, fps, replica = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        if not len(at):
            continue
        found = []
        if anchor is not None and at[0] == anchor:  # goes on from the last batch
            n = int(np.searchsorted(at, anchor, side="right"))
            homes = np.concatenate([homes, fps[:n][~replica[:n]]])
            if len(homes) and replica[:n].any():
                found.append(_links(homes, fps[:n][replica[:n]], THRESHOLD))
        # whole groups of this batch, all at once: groups with few comparisons by index arithmetic, others one by one
        keys, starts, sizes = np.unique(at, return_index=True, return_counts=True)
        n_homes = np.add.reduceat((~replica).astype(np.int64), starts)
        if anchor is not None and keys[0] == anchor:
            keys, starts, sizes, n_homes = keys[1:], starts[1:], sizes[1:], n_homes[1:]
        work = n_homes * (sizes - n_homes)
        small = np.flatnonzero((work > 0) & (work <= 1 << 14))
        for k in np.flatnonzero(work > 1 << 14):
            h = starts[k] + n_homes[k]
            found.append(_links(fps[starts[k] : h], fps[h : starts[k] + sizes[k]], THRESHOLD))
        for part in np.array_split(small, 1 + int(work[small].sum()) // _COMPARED):
            row, place = _expanded(np.zeros(len(part), dtype=np.int64), work[part])
            k = part[row]
            others = sizes[k] - n_homes[k]
            x, y = fps[starts[k] + place // others], fps[starts[k] + n_homes[k] + place % others]
            differ = np.bitwise_count((x ^ y).view(np.uint64))
            near = (differ > 0) & (differ <= THRESHOLD)
            found.append(np.stack([x[near], y[near]], axis=1))
        if len(keys):
            anchor, last = keys[-1], starts[-1]
            homes = fps[last:][~replica[last:]]
        forest = spanning_edges(np.concatenate([forest, *found]))
        if len(forest) > 1 << 18:
            yield pa.RecordBatch.from_arrays([pa.array(forest[:, 0]), pa.array(forest[:, 1])], ["u", "v"])
            forest = forest[:0]
    if len(forest):
        yield pa.RecordBatch.from_arrays([pa.array(forest[:, 0]), pa.array(forest[:, 1])], ["u", "v"])


def linked(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) between fingerprints that connect exactly what links of at most THRESHOLD bits connect.
    distinct: one column of different fingerprints."""
    spread = distinct.mapInArrow(_replicate, "anchor long, fp long, replica boolean")
    dealt = spread.repartition("anchor").sortWithinPartitions("anchor", "replica")
    return dealt.mapInArrow(_compare, "u long, v long").distinct()


def near_duplicates(documents: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links)."""
    fps = persisted(fingerprints(documents, words), "fingerprints")
    with scratch():
        distinct = persisted(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
        edges = persisted(linked(distinct.select("fp")), "links")
        of = components(edges)  # node, component: only of fingerprints with links
        joined = distinct.join(of, distinct["fp"] == of["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
        smallest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
        named = persisted(joined.join(smallest, "component").select("fp", "component_id"), "named", keep=True)
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
