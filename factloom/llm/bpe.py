"""Byte-level BPE by speculation and verification.

Texts are cut into words by the tokenizer's own pattern. For each word that isn't a token itself, greedy longest
match proposes tokens; a sequence is the BPE result exactly if no merge could ever cross the boundary of an
adjacent pair, which one vectorised check answers for all pairs of a batch at once. Only words with a failing pair
are merged step by step. Words and pairs already answered are kept in caches that are bounded in bytes and emptied when
a task ends; words of over CACHED_LETTERS letters are kept only for the texts at hand.

Texts are taken a few at a time (common.slices), so memory is bounded by the longest text, which is encoded whole.
Defined cases: a null text is empty (no tokens); a row with a null doc_id keeps it; repeated rows are encoded each; an
empty table gives no rows; further columns of any name are left out of the result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import slices

CACHED_BYTES = 48 << 20  # of words and their tokens
CACHED_LETTERS = 48
CACHED_PAIRS = 100_000
_LEARNED = 20_000  # different words that are learned at once
SCANNED_BYTES = 48
_NONE = np.iinfo(np.int64).max
_NO_MERGE = (_NONE, -1)


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself, or the next free code point from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, free = [], 256
    for byte in range(256):
        out.append(chr(byte if byte in shown else free))
        free += byte not in shown
    return out


class Bpe:
    """Encoder and decoder of one vocabulary file of the tokenizers library (byte-level BPE)."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: bytes([b]) for b, c in enumerate(byte_alphabet())}
        vocab = spec["model"]["vocab"]
        raw = {token: b"".join(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode() for token in vocab}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (max(*vocab.values(), *self.special.values()) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = raw[token]
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.id_of = {b: i for i, b in enumerate(self.bytes_of) if b and i not in self.special.values()}
        n = len(self.bytes_of)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}  # pair: (rank, what it becomes)
        left, right, rank = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        for k, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merge[x, y] = k, z
            left[z], right[z], rank[z] = x, y, k
        self._pairs_setup(left, right, rank)
        self.id_of_byte = [self.id_of[bytes([b])] for b in range(256)]
        self.longest: dict[int, dict[bytes, int]] = {4: {}, 7: {}}  # of tokens by their first 4 and 7 bytes
        for b in self.id_of:
            for k, most in self.longest.items():
                if len(b) >= k:
                    most[b[:k]] = max(len(b), most.get(b[:k], k))
        self.words = regex.compile(pattern)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}
        self.known_bytes = 0
        self.fits: dict[int, bool] = {}

    def release(self) -> None:
        """Empties the caches, so that a reused worker doesn't carry them into its next task."""
        self.known, self.known_bytes, self.fits = {}, 0, {}

    def _pairs_setup(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> None:
        """For each token its chain of last (first) parts, and for each part the rank at which it is merged away."""
        n = len(rank)
        self.n = n
        keys = np.array([x * n + y for x, y in self.merge], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], _NONE)
        self.ranks = np.append(np.array([k for k, _ in self.merge.values()], dtype=np.int64)[order], _NONE)

        def chains(part: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
            at, until = np.arange(n), np.full(n, _NONE)
            out = []
            while (at >= 0).any():
                out.append((at, until))
                more = (at >= 0) & (part[at] >= 0)
                at, until = np.where(more, part[at], -1), np.where(more, rank[at], -1)
            return out

        self.tails, self.heads = chains(right), chains(left)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge ever crosses the boundary between tokens a and b (element by element).

        A part x at the end of a lives until the merge that takes it into its parent, as does y at the start of b;
        the merge (x, y) happens if its rank comes before both ends. Of equal ranks the left one comes first.
        """
        ok = np.ones(len(a), dtype=bool)
        for tail, tail_until in self.tails:
            x, x_until = tail[a], tail_until[a]
            if not (x >= 0).any():
                break
            for head, head_until in self.heads:
                y = head[b]
                at = np.flatnonzero(ok & (x >= 0) & (y >= 0))
                if not len(at):
                    if not (y >= 0).any():
                        break
                    continue
                key = x[at].astype(np.int64) * self.n + y[at]
                k = np.searchsorted(self.keys, key)
                rank = np.where(self.keys[k] == key, self.ranks[k], _NONE)
                ok[at] = ~((rank < x_until[at]) & (rank <= head_until[b[at]]) & (rank != _NONE))
        return ok

    def greedy(self, word: bytes) -> list[int]:
        """Longest match from the left; every byte is a token, so it always ends."""
        out, at, ids, n = [], 0, self.id_of, len(word)
        by4, by7 = self.longest[4], self.longest[7]
        while at < n:
            most = by4.get(word[at : at + 4], 3)
            if most > 6:
                most = by7.get(word[at : at + 7], 6)
            end = min(at + most, n)
            while (i := ids.get(word[at:end])) is None:
                end -= 1
            out.append(i)
            at = end
        return out

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: the lowest rank first, the leftmost of equals; a scan for short words, a heap for long ones."""
        ids = list(map(self.id_of_byte.__getitem__, word))
        if len(ids) > SCANNED_BYTES:
            return self._merged_long(ids)
        merge = self.merge.get
        ranks = [m or _NO_MERGE for m in map(merge, zip(ids, ids[1:]))]
        while ranks:
            best = min(ranks)
            if best is _NO_MERGE:
                break
            k = ranks.index(best)
            ids[k : k + 2] = [best[1]]
            del ranks[k]
            if k:
                ranks[k - 1] = merge((ids[k - 1], ids[k])) or _NO_MERGE
            if k < len(ranks):
                ranks[k] = merge((ids[k], ids[k + 1])) or _NO_MERGE
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*m, k, ids[k], ids[k + 1]) for k in range(n - 1) if (m := self.merge.get((ids[k], ids[k + 1])))]
        heap = [(rank, k, z, x, y) for rank, z, k, x, y in heap]
        heapify(heap)
        while heap:
            _, k, z, x, y = heappop(heap)
            nxt = after[k]
            if ids[k] != x or nxt >= n or ids[nxt] != y:
                continue
            ids[k], ids[nxt] = z, -1
            after[k] = after[nxt]
            if after[k] < n:
                before[after[k]] = k
                if m := self.merge.get((z, ids[after[k]])):
                    heappush(heap, (m[0], k, m[1], z, ids[after[k]]))
            if (p := before[k]) >= 0 and (m := self.merge.get((ids[p], z))):
                heappush(heap, (m[0], p, m[1], ids[p], z))
        return [i for i in ids if i >= 0]

    def learned(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """The tokens of all words: single tokens, verified proposals, exact merges for the rest."""
        if len(self.fits) > CACHED_PAIRS:
            self.fits.clear()
        known: dict[str, tuple[int, ...]] = {}
        proposals: list[tuple[str, bytes, list[int]]] = []
        ids = self.id_of
        for w in words:
            raw = w.encode()
            if (i := ids.get(raw)) is not None:
                known[w] = (i,)
            else:
                proposals.append((w, raw, self.greedy(raw)))
        if not proposals:
            return known
        flat = np.fromiter((i for _, _, p in proposals for i in p), np.int64)
        lengths = np.fromiter((len(p) for _, _, p in proposals), np.int64, len(proposals))
        last = np.cumsum(lengths) - 1
        inside = np.ones(len(flat), dtype=bool)
        inside[last] = False
        at = np.flatnonzero(inside)
        pairs, of = np.unique(flat[at] * self.n + flat[at + 1], return_inverse=True)
        fits, fit_of = self.fits, np.empty(len(pairs), dtype=bool)
        new = []
        for k, key in enumerate(pairs.tolist()):
            if (f := fits.get(key)) is None:
                new.append(k)
            else:
                fit_of[k] = f
        if new:
            fresh = pairs[new]
            fit_of[new] = answers = self.compatible(fresh // self.n, fresh % self.n)
            fits.update(zip(fresh.tolist(), answers.tolist(), strict=True))
        word_of = np.repeat(np.arange(len(proposals)), lengths)
        bad = np.zeros(len(proposals), dtype=bool)
        bad[word_of[at[~fit_of[of]]]] = True
        for (w, raw, p), failed in zip(proposals, bad.tolist(), strict=True):
            known[w] = tuple(self.merged(raw)) if failed else tuple(p)
        return known

    def pieces(self, text: str) -> list[tuple[str | None, str]]:
        """(special token or None, text) in order; special strings are cut out first, the leftmost and longest."""
        if self.cut is None or not any(s in text for s in self.special):
            return [(None, text)]
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [(None, text[at : m.start()]), (m[0], "")]
            at = m.end()
        return [*out, (None, text[at:])]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        group: list[list[tuple[str | None, list[str]]]] = []
        fresh: set[str] = set()
        for text in texts:
            cut = [(s, self.words.findall(t)) for s, t in self.pieces(text)]
            group.append(cut)
            for _, words in cut:
                fresh.update(words)
            if len(fresh) > _LEARNED:
                out += self._encoded(group, fresh)
                group, fresh = [], set()
        return out + self._encoded(group, fresh)

    def _encoded(self, group: list, fresh: set[str]) -> list[list[int]]:
        new = self.learned(fresh.difference(self.known))
        known, out = {**{w: self.known[w] for w in fresh.intersection(self.known)}, **new}, []
        if self.known_bytes > CACHED_BYTES:  # what these texts need stays
            self.known, self.known_bytes = {}, 0
            new = known
        for w, t in new.items():
            if len(w) <= CACHED_LETTERS:
                self.known[w] = t
                self.known_bytes += 150 + 2 * len(w) + 8 * len(t)  # about
        for cut in group:
            ids: list[int] = []
            for special, words in cut:
                if special is not None:
                    ids.append(self.special[special])
                for tokens in map(known.__getitem__, words):
                    ids += tokens
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def loaded(path: str, pattern: str) -> Bpe:
    return Bpe(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


ENCODED_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _batches(documents: DataFrame, row, schema: str, path: str | None, pattern: str | None) -> DataFrame:
    """doc_id and, for each text's ids, the arrays of row(bpe, all ids of a part)."""
    default = None if path and pattern else default_vocabulary()
    path, pattern = path or default[0], pattern or default[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        try:
            for batch in slices(batches, 512):
                columns = row(bpe, bpe.encode_batch(batch.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns.values()], ["doc_id", *columns])
        finally:
            bpe.release()

    kept = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return kept.mapInArrow(run, schema)


def encode_digests(documents: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Token counts and digests of ids (little-endian unsigned 32-bit) and of the text decoded from them."""

    def row(bpe: Bpe, found: list[list[int]]) -> dict:
        return {
            "n_tokens": pa.array(list(map(len, found)), pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() for ids in found], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(ids).encode()).hexdigest() for ids in found], pa.string()),
        }

    return _batches(documents, row, ENCODED_SCHEMA, path, pattern)


def encode(documents: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and the ids themselves."""
    return _batches(documents, lambda bpe, found: {"ids": pa.array(found, pa.list_(pa.int32()))}, "doc_id long, ids array<int>", path, pattern)
