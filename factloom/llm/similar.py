"""Near-duplicates by the exact Jaccard similarity of word shingles.

Documents with equal sets of shingles are merged first (by a 64-bit digest of the set). Candidates are named twice over.
SimHash: each set has a fingerprint, and operator 6's anchors (simhash.linked) name the fingerprints within
simhash.THRESHOLD bits; sets of one fingerprint are candidates as well. At a similarity of 0.8 fingerprints differ in
about ten of 64 bits, and up to 23 where none in a million is to be missed, far beyond what anchors can cover. So, for
the pairs further apart, MinHash bands: BANDS keys of BAND_ROWS minima each, so two sets of similarity s share no key
with probability (1 - s ** BAND_ROWS) ** BANDS, 3e-6 at 0.8 and less above. Every candidate is then compared exactly:
first the pairs by SimHash, and each document with the smallest one of its band; then, in the bands that this leaves in
more than one component, all against all, in blocks of bounded size. Components are joined by the distributed star
algorithm. Texts stay where they are: what is written has a row's number in their place, but for candidates' texts.

Defined cases: texts without words (null, empty) are copies of each other; a null doc_id takes part, but isn't a
candidate for the smallest id while its group has another. Repeated rows repeat in the result of near_duplicates; one of
them stays as the representative. Texts of any length are shingled whole. Columns of any name pass through
`representatives`. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import BROADCAST_ROWS, broadcast_if_small, keyed, persisted, scratch, slices
from factloom.llm.components import components, spanning_edges
from factloom.llm.simhash import SEED, linked, majority, shingles

WORDS = 5
#: Least similarity, as a fraction of integers, so that the limit itself counts exactly.
SIMILARITY = (4, 5)
BANDS = 24
BAND_ROWS = 4
_BLOCK = 256
_COLUMNS = 1 << 13
_draw = np.random.default_rng(SEED)
_FLIPS = _draw.integers(0, 1 << 64, BANDS * BAND_ROWS, dtype=np.uint64)
_FACTORS = _draw.integers(0, 1 << 64, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """The different shingles' hashes, sorted."""
    parts = set(shingles(text, words))
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(p.encode(), seed=SEED) for p in parts), np.uint64, len(parts)))


def band_keys(found: np.ndarray) -> list[int]:
    """One key per band, none of an empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 4096):
        least = np.minimum(least, ((found[at : at + 4096, None] ^ _FLIPS) * _FACTORS).min(axis=0))
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), seed=k) for k, r in enumerate(rows)], dtype=np.uint64).view(np.int64).tolist()


def alike(common: np.ndarray, one: np.ndarray, other: np.ndarray, similarity: tuple[int, int] = SIMILARITY) -> np.ndarray:
    """Whether sets of these sizes with so many common elements reach the similarity."""
    return common * similarity[1] >= similarity[0] * (one + other - common)


def signatures(each: DataFrame, words: int = WORDS) -> DataFrame:
    """row, doc_id, node (digest of the set of shingles), fp (its SimHash), keys. each: row, doc (a row's columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t or "", words) for t in batch.column(2).to_pylist()]
            nodes = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            fps = np.array([majority(s) for s in sets], dtype=np.uint64).view(np.int64)
            keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes), pa.array(fps), keys], ["row", "doc_id", "node", "fp", "keys"])

    texts = each.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), "doc.text")
    return texts.mapInArrow(run, "row long, doc_id long, node long, fp long, keys array<long>")


def near_fingerprints(sets: DataFrame) -> DataFrame:
    """Pairs (hub, node) of different nodes that equal fingerprints or operator 6's anchors put together. sets: node, fp."""
    of = persisted(sets.groupBy("fp").agg(F.min("node").alias("hub"), F.count("*").alias("n")), "simhash")
    same = sets.join(of.where("n > 1"), "fp").where("node <> hub").select("hub", "node")
    edges = persisted(linked(of.select("fp")), "anchored")
    at = lambda end, name: of.select(F.col("fp").alias(end), F.col("hub").alias(name))
    return edges.join(at("u", "node"), "u").join(at("v", "hub"), "v").select("hub", "node").unionByName(same)


def _with_first(pairs: DataFrame, texts: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """Of the pairs (hub, node) those that are alike, as edges (u, v). Groups of many nodes are dealt over several tasks."""
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias("parts"))
    nodes = pairs.join(parts, "hub").select("hub", F.expr("int(pmod(xxhash64(node), parts))").alias("part"), "node")
    firsts = parts.select("hub", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.col("hub").alias("node"))
    rows = nodes.unionByName(firsts).join(texts, "node").select("hub", "part", "node", "text", (F.col("hub") != F.col("node")).alias("other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, first = None, None
        for batch in slices(batches):
            u, v = [], []
            for h, node, text, other in zip(*(batch.column(c).to_pylist() for c in ("hub", "node", "text", "other")), strict=True):
                found = shingle_set(text, words)
                if not other:
                    hub, first = h, found
                    continue
                assert h == hub, "a group without its first document"
                if alike(len(np.intersect1d(first, found, assume_unique=True)), len(first), len(found), similarity):
                    u.append(h)
                    v.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "other").mapInArrow(run, "u long, v long")


def _among_all(bands: DataFrame, texts: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """Edges (u, v) that connect what all alike nodes with a key of bands (key, node) in common connect."""
    blocks = bands.groupBy("key").agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias("blocks"))
    placed = bands.join(blocks, "key").withColumn("b", F.expr("int(pmod(xxhash64(node), blocks))")).withColumn("c", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = placed.select("key", F.least("b", "c").alias("i"), F.greatest("b", "c").alias("j"), "node").join(texts, "node")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sets = [shingle_set(t, words) for t in group["text"]]
        nodes, sizes = group["node"].to_numpy(), np.array([len(s) for s in sets])
        of = np.repeat(np.arange(len(sets)), sizes)
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times[column] > 1
        of, column = of[shared], np.unique(column[shared], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        of, column = of[order], column[order]
        common = np.zeros((len(sets), len(sets)), dtype=np.int64)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
            low, high = np.searchsorted(column, [at, at + _COLUMNS])
            part = np.zeros((len(sets), _COLUMNS), dtype=np.float32)
            part[of[low:high], column[low:high] - at] = 1
            common += (part @ part.T).astype(np.int64)
        a, b = np.nonzero(np.triu(alike(common, sizes[:, None], sizes[None, :], similarity), 1))
        forest = spanning_edges(np.stack([nodes[a], nodes[b]], axis=1))
        return pd.DataFrame({"u": forest[:, 0], "v": forest[:, 1]})

    return rows.groupBy("key", "i", "j").applyInPandas(run, "u long, v long")


def _grouped(each: DataFrame, words: int, similarity: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(signatures; node, component and first: the smallest row of the node by id, null ids last). each: row, doc."""
    signed = persisted(signatures(each, words), "signatures", keep=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first")
    sets = persisted(signed.groupBy("node").agg(first, F.first("fp").alias("fp"), F.first("keys").alias("keys")), "sets")
    spread = sets.select("node", F.explode("keys").alias("key"))
    hubs = spread.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    bands = persisted(spread.join(hubs, "key").select("key", "node", "hub"), "bands")
    near = near_fingerprints(sets.select("node", "fp"))
    pairs = persisted(bands.where("node <> hub").select("hub", "node").unionByName(near).distinct(), "pairs")
    compared = bands.select("node").unionByName(pairs.select("node")).unionByName(pairs.select(F.col("hub").alias("node"))).distinct()
    wanted = persisted(sets.select("node", "first.row").join(compared, "node", "left_semi"), "wanted")
    texts = persisted(each.select("row", F.coalesce("doc.text", F.lit("")).alias("text")).join(broadcast_if_small(wanted, wanted.count(), BROADCAST_ROWS), "row").select("node", "text"), "candidates")
    links = persisted(_with_first(pairs, texts, words, similarity), "links")
    # bands that are still in several components; equal ones once
    named = bands.join(components(links), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    hashed = F.xxhash64("node").cast("decimal(38,0)")
    apart = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), F.sum(hashed).alias("members")).where("low <> high")
    left = apart.groupBy("n", "members").agg(F.min("key").alias("key")).select("key")
    rest = persisted(_among_all(persisted(bands.join(left, "key", "left_semi").select("key", "node"), "apart"), texts, words, similarity).distinct(), "links2")
    of = components(links.unionByName(rest))
    joined = sets.join(of, sets["node"] == of["node"], "left").select(sets["node"], "first", F.coalesce(of["component"], sets["node"]).alias("component"))
    return signed, joined


def near_duplicates(documents: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable over pairs of at least this similarity)."""
    with scratch():
        signed, joined = _grouped(keyed(documents)[0], words, similarity)
        smallest = joined.groupBy("component").agg(F.min("first")["doc_id"].alias("component_id"))
        named = persisted(joined.join(smallest, "component").select("node", "component_id"), "named", keep=True)
    return signed.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")


def representatives(documents: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Of each component the row with the smallest doc_id (of equal or no ids, one of them), with all its columns."""
    each, _ = keyed(documents)
    with scratch():
        signed, joined = _grouped(each, words, similarity)
        kept = joined.groupBy("component").agg(F.min("first")["row"].alias("row")).select("row")
        gone = persisted(signed.select("row").join(kept, "row", "left_anti"), "gone", keep=True)
    return each.join(broadcast_if_small(gone, gone.count(), BROADCAST_ROWS), "row", "left_anti").select("doc.*")
