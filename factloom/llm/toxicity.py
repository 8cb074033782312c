"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Learning uses labelled rows of the training folds only, at most EXAMPLES of label 1 and NEGATIVES of label 0, those of
smallest hash (a documented bound). Terms are whole lower-cased words and word beginnings of PREFIXES letters, each with
the levels that its frequency reaches in the text: 1, 2, 4 ... occurrences, and (from two occurrences on) one in 16, 32
... 1,024 words. Levels state the term frequency, so that one chance occurrence and a text full of a word differ although
vectors are unit vectors. A term weighs its inverse document frequency times the part of its log odds between the labels
that SIGMA standard errors leave; terms whose odds show nothing weigh nothing. No term is left out for its rank.

Examples are unit vectors in an inverted index cut into blocks of BLOCK examples, each with its largest weight by term; a
query skips blocks whose bound can't reach its K-th best, so its neighbours are exact. Votes are weighted by closeness,
label 0 by its share of all training rows, and a table of vote to frequency, made from leave-one-out votes of the
examples and made monotone, turns the vote into a probability.

Counting the examples' terms runs on the executors; the driver gets the terms with a weight and the examples' vectors,
both bounded by the number of examples, never their texts. Scoring is one narrow pass over whole texts of any length.
Labels, lang, source and doc_id never enter a score. Defined cases: a null or empty text, and one without any weighted
term, gets the frequency of label 1 among such examples; without labelled rows of both kinds every score is the share of
label 1 (0.5 where there are none). Equally near examples count by smaller doc_id. Rows with null ids are scored, but
never held out nor learned from; of repeated ids the smallest text is the example; repeated rows are scored each; an
empty table gives no rows; extra columns of any name pass through `without_toxic` untouched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import persisted, scratch, slices

EXAMPLES = 1500
NEGATIVES = 4500
PREFIXES = range(3, 8)
RATES = range(4, 11)  # one in 2**k words
SIGMA = 3.5
K = 9
BLOCK = 64
BINS = 50
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
_WORD = re.compile(r"[^\W\d_]+")
_CACHED_WORDS, _CACHED_LETTERS, _CACHED_SCORES, _CACHED_TERMS = 50_000, 32, 5_000, 32
_COUNTED = 400_000  # different terms that one task holds before it hands them on
_FIRST_BLOCKS = 4


def grams(word: str) -> list[str]:
    """The whole word, then its proper beginnings."""
    return ["=" + word, *("^" + word[:k] for k in PREFIXES if k < len(word))]


def gram_counts(words: Iterable[tuple[Iterable, int]]) -> dict:
    """Occurrences of each gram; words: the grams of a word and how often it occurs."""
    out: dict = {}
    for found, n in words:
        for g in found:
            out[g] = out.get(g, 0) + n
    return out


def levels(n: int, words: int) -> list[int]:
    """What n occurrences among so many words reach: k for 2**k occurrences, -k for one in 2**k words."""
    reached = list(range(n.bit_length()))
    return reached + [-k for k in RATES if n << k >= words] if n > 1 else reached


def terms(text: str) -> list[str]:
    """Every term of the text: a gram, for its presence, and the gram with each further level."""
    words = _WORD.findall(text.lower())
    counts = gram_counts((grams(word), n) for word, n in Counter(words).items())
    return [*counts, *(f"{g} {k}" for g, n in counts.items() if n > 1 for k in levels(n, len(words)) if k)]


def weight(n1: F.Column, n0: F.Column, all1: int, all0: int, sigma: float = SIGMA) -> F.Column:
    """Of a term in n1 and n0 examples of either label; negative or zero where its odds may be chance."""
    a, b, c, d = n1 + 0.5, n0 + 0.5, F.lit(all1 + 0.5) - n1, F.lit(all0 + 0.5) - n0
    odds = F.abs(F.log(a / c) - F.log(b / d))
    error = F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return (odds - sigma * error) * (F.log(F.lit(1.0 + all1 + all0) / (1 + n1 + n0)) + 1)


class Vocabulary:
    """Weighted terms, numbered in their order; finds those of a text."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = np.array([weights[t] for t in sorted(weights)], dtype=np.float64)
        levels: dict[str, list[tuple[int, int]]] = {}  # of each gram, with the terms' numbers
        for number, t in enumerate(sorted(weights)):
            gram, _, level = t.partition(" ")
            levels.setdefault(gram, []).append((int(level or 0), number))
        self.levels = list(levels.values())
        self.whole = {g[1:]: k for k, g in enumerate(levels) if g[0] == "="}
        self.begins = {g[1:]: k for k, g in enumerate(levels) if g[0] == "^"}
        self.lengths = sorted({len(g) for g in self.begins})
        # a word with any gram begins with one of threes or fours, or its first five letters are one of fives
        self.threes, self.fours = (frozenset(g for g in self.begins if len(g) == k) for k in (3, 4))
        self.fives = frozenset(g[:5] for g in (*self.whole, *(g for g in self.begins if len(g) > 4)))
        self.known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": {}}

    def _learn(self, word: str) -> tuple[int, ...]:
        """The word's grams that any weighted term has."""
        found = (self.whole[word],) if word in self.whole else ()
        found += tuple(self.begins[word[:n]] for n in self.lengths if n < len(word) and word[:n] in self.begins)
        if len(word) <= _CACHED_LETTERS:
            if len(self.known) >= _CACHED_WORDS:
                self.known.clear()
            self.known[word] = found
        return found

    def terms_of(self, text: str) -> np.ndarray:
        """The numbers of the text's weighted terms, ascending."""
        words, known = _WORD.findall(text.lower()), self.known
        size, some = len(words), []
        threes, fours, fives = self.threes, self.fours, self.fives
        for word, n in [x for x in Counter(words).items() if (w := x[0])[:5] in fives or w[:4] in fours or w[:3] in threes]:
            found = known.get(word)
            if found is None:
                found = self._learn(word)
            if found:
                some.append((found, n))
        at = []
        for g, n in gram_counts(some).items():
            for level, t in self.levels[g]:
                if (n >> level) if level >= 0 else (n > 1 and n << -level >= size):
                    at.append(t)
        return np.array(sorted(at), dtype=np.int64)


class Model:
    """examples: (label, numbers of its terms) in the order that breaks ties. share: how many rows a label-0 example
    stands for, if a label-1 example stands for one."""

    def __init__(self, vocabulary: Vocabulary, examples: list[tuple[int, np.ndarray]], share: float = 1.0) -> None:
        self.vocabulary, self.weights = vocabulary, vocabulary.weights
        self.labels = np.array([label for label, _ in examples], dtype=np.float64)
        n1, n0 = int(self.labels.sum()), int((1 - self.labels).sum())
        self.of = np.where(self.labels > 0, 1.0, share)
        self.base = n1 / (n1 + share * n0) if examples else 0.5
        self.fitted = bool(n1 and n0)
        vectors = [np.asarray(found, dtype=np.int64) for _, found in examples]
        self._index(vectors)
        self.cached: dict[bytes, tuple[float, list]] = {}
        if self.fitted:
            self._calibrate(vectors)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "cached": {}}

    def unit(self, at: np.ndarray) -> np.ndarray:
        w = self.weights[at]
        return w / np.sqrt((w * w).sum()) if len(w) else w

    def _index(self, vectors: list[np.ndarray]) -> None:
        """Postings by term, then place; where each term's blocks start, and the largest weight in each. Examples are
        placed by their heaviest terms, so that a block's examples are alike and its bounds close."""
        n = len(vectors)
        heavy = [tuple(sorted(v.tolist(), key=lambda t: (-self.weights[t], t))[:3]) for v in vectors]
        self.example = np.array(sorted(range(n), key=lambda e: (heavy[e], e)), dtype=np.int64)  # by place
        self.blocks = -(-max(1, n) // BLOCK)
        placed = [vectors[e] for e in self.example.tolist()]
        term = np.concatenate([np.empty(0, np.int64), *placed])
        at = np.repeat(np.arange(n), np.array([len(v) for v in placed], dtype=np.int64))
        w = np.concatenate([np.empty(0), *map(self.unit, placed)])
        order = np.lexsort((at, term))
        self.slot, self.w = (at[order] % BLOCK).astype(np.int32), w[order]
        place = term[order] * self.blocks + at[order] // BLOCK
        self.starts = np.searchsorted(place, np.arange(len(self.weights) * self.blocks + 1)).astype(np.int32)
        self.most = np.zeros(len(self.weights) * self.blocks)
        np.maximum.at(self.most, place, self.w)
        self.most = self.most.reshape(-1, self.blocks)

    def neighbours(self, at: np.ndarray, but: int = -1) -> list[tuple[float, int]]:
        """The K nearest examples of positive cosine as (cosine, example), nearest first, ties to the smaller example."""
        if not len(at):
            return []
        x = self.unit(at)
        bounds = x @ self.most[at]
        order = np.argsort(-bounds, kind="stable")
        scores, found = np.empty(0), np.empty(0, dtype=np.int64)  # the best so far
        done, step = 0, _FIRST_BLOCKS
        while done < len(order):
            part = order[done : done + step]
            part = part[bounds[part] > (max(0.0, scores[-1] - 1e-9) if len(scores) >= K else 0.0)]
            if not len(part):
                break
            rows = (at[:, None] * self.blocks + part).ravel()
            low, sizes = self.starts[rows].astype(np.int64), self.starts[rows + 1] - self.starts[rows]
            place = np.arange(sizes.sum()) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
            local = np.repeat(np.tile(np.arange(len(part)) * BLOCK, len(at)), sizes) + self.slot[place]
            sums = np.bincount(local, weights=self.w[place] * np.repeat(np.repeat(x, len(part)), sizes))
            new = np.flatnonzero(sums > (scores[-1] - 1e-9 if len(scores) >= K else 0.0))
            e = self.example[part[new // BLOCK] * BLOCK + new % BLOCK]
            scores, found = np.concatenate([scores, sums[new][e != but]]), np.concatenate([found, e[e != but]])
            best = np.lexsort((found, -scores))[:K]
            scores, found = scores[best], found[best]
            done, step = done + step, step * 2
        return list(zip(scores.tolist(), found.tolist(), strict=True))

    def vote(self, near: list[tuple[float, int]]) -> float:
        """The share of label 1, by closeness (cosine over what is left of one), with one vote of the base rate at small weight."""
        weights = np.array([s / (1.05 - min(s, 1.0)) for s, _ in near])
        return float(((weights * self.labels[[e for _, e in near]]).sum() + 0.05 * self.base) / (weights.sum() + 0.05))

    def _calibrate(self, vectors: list[np.ndarray]) -> None:
        """Frequencies of label 1 by vote, over the examples each left out: pool adjacent violators on BINS bins."""
        near = [self.neighbours(v, but=e) for e, v in enumerate(vectors)]
        rows = np.array([e for e, x in enumerate(near) if x], dtype=np.int64)
        empty = np.array([e for e, x in enumerate(near) if not x], dtype=np.int64)
        positive = self.of * self.labels
        self.empty = float((positive[empty].sum() + self.base) / (self.of[empty].sum() + 1))
        bins = np.array([self.bin_of(near[e]) for e in rows.tolist()], dtype=np.int64)
        pools: list[list[float]] = []  # [sum of labels, count, bins]
        for k in range(BINS):
            mine = rows[bins == k]
            pools.append([positive[mine].sum() + (k + 0.5) / BINS, self.of[mine].sum() + 1.0, 1])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
                a, b = pools.pop(-2), pools.pop(-1)
                pools.append([a[0] + b[0], a[1] + b[1], a[2] + b[2]])
        self.scores = np.concatenate([np.full(int(n), s / c) for s, c, n in pools])

    def bin_of(self, near: list[tuple[float, int]]) -> int:
        return min(int(self.vote(near) * BINS), BINS - 1)

    def score(self, text: str) -> tuple[float, list[tuple[float, int]]]:
        """(probability of label 1, the neighbours it rests on)."""
        if not self.fitted:
            return self.base, []
        at = self.vocabulary.terms_of(text)
        key = at.tobytes() if len(at) <= _CACHED_TERMS else None
        out = self.cached.get(key) if key is not None else None
        if out is None:
            near = self.neighbours(at)
            out = (float(self.scores[self.bin_of(near)]) if near else self.empty, near)
            if key is not None:
                if len(self.cached) >= _CACHED_SCORES:
                    self.cached.clear()
                self.cached[key] = out
        return out

    def release(self) -> None:
        """Empties the caches, so that a reused worker doesn't carry them into its next task."""
        self.vocabulary.known.clear()
        self.cached.clear()


def fold(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(FOLDS))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        every = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *(pa.array([c[t] for t in every], pa.int64()) for c in reversed(counts))], ["term", "n1", "n0"])

    for batch in slices(batches):
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[label].update(terms(text))
            if len(counts[0]) + len(counts[1]) > _COUNTED:
                yield out()
                counts = (Counter(), Counter())
    yield out()


def examples(documents: DataFrame, labels: DataFrame, positives: int = EXAMPLES, negatives: int = NEGATIVES) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic, text of the examples, written to the shared folder; number of training rows by label). Of each
    label the rows of smallest hash, the same at every size."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != HELD_OUT)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id")
    parts = [known.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(most) for k, most in ((0, negatives), (1, positives))]
    wanted = F.broadcast(parts[0].unionByName(parts[1]))  # at most positives + negatives rows
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return persisted(texts.join(wanted, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "examples"), n


def fit(documents: DataFrame, labels: DataFrame, positives: int = EXAMPLES, negatives: int = NEGATIVES) -> tuple[Model, list[int]]:
    """The model and the doc_ids of its examples."""
    with scratch():
        rows, n = examples(documents, labels, positives, negatives)
        used = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
        share = lambda k: n.get(k, 0) / max(1, used.get(k, 0))
        ratio = share(0) / share(1) if used.get(0) and used.get(1) else 1.0
        counted = rows.mapInArrow(_counted, "term string, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
        weighed = counted.select("term", weight(F.col("n1"), F.col("n0"), used.get(1, 0), used.get(0, 0)).alias("weight")).where("weight > 0")
        vocabulary = Vocabulary({r["term"]: r["weight"] for r in weighed.collect()} if used.get(0) and used.get(1) else {})
        shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

        def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                found = [shared.value.terms_of(x) for x in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "toxic", "terms"])
            shared.value.known.clear()

        found = rows.mapInArrow(vectors, "doc_id long, toxic int, terms array<long>").collect()
        found.sort(key=lambda r: r["doc_id"])
        return Model(vocabulary, [(r["toxic"], r["terms"]) for r in found], ratio), [r["doc_id"] for r in found]


def scored(documents: DataFrame, labels: DataFrame, learned_from: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (doc_id of the nearest example, null without one). learned_from: the
    documents that labels are about, if not these."""
    model, ids = fit(documents if learned_from is None else learned_from, labels)
    shared = documents.sparkSession.sparkContext.broadcast((model, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, ids = shared.value
        try:
            for batch in slices(batches):
                found = [model.score(t) for t in batch.column("text").to_pylist()]
                evidence = [ids[near[0][1]] if near else None for _, near in found]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s for s, _ in found], pa.float64()), pa.array(evidence, pa.int64())], ["doc_id", "score", "evidence"])
        finally:
            model.release()

    kept = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = kept.mapInArrow(run, "doc_id long, score double, evidence long")
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def without_toxic(documents: DataFrame, labels: DataFrame, learned_from: DataFrame | None = None) -> DataFrame:
    """The rows whose score stays under the threshold, with all their columns; whole rows pass through, no join."""
    model, _ = fit(documents if learned_from is None else learned_from, labels)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        try:
            for batch in slices(batches):
                keep = [model.score(t or "")[0] < THRESHOLD for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))
        finally:
            model.release()

    return documents.mapInArrow(run, documents.schema)
