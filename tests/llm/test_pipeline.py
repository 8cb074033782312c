"""The pipeline's stages on planted cases."""

import random

import corpus_pipeline
from factloom.llm.queries import oracle_sql, queries


def test_registered_names():
    assert {int(n[2:].split("_")[0]) for n in queries()} == set(range(1, 11))
    assert set(oracle_sql()) <= set(queries())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "bpe"]


def test_stages_on_planted_documents(spark, tmp_path):
    words = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    passage = "\n".join(words(f"shared{r}", 30) for r in range(3))
    texts = {1: words("alpha", 80), 2: words("alpha", 80), 3: words("beta", 40) + "\n" + passage, 4: words("gamma", 40) + "\n" + passage + "\n" + words("delta", 20), 5: words("eps", 20) + " the quick brown fox jumps over the lazy dog today " + words("zeta", 20), 6: words("eta", 60), 7: None}
    toxic = {100 + k: words(f"t{k}x", 20) + " idiotic moronic scumbag" for k in range(40)}
    clean = {200 + k: words(f"c{k}y", 25) for k in range(40)}
    every = {**texts, **toxic, **clean}
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in every.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 200)) for i in [*toxic, *clean]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog today")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out/{name}")
        out = spark.read.parquet(f"{tmp_path}/out/{name}")
        if name != "bpe":
            assert out.columns == docs.columns
        seen[name] = {r["doc_id"]: r for r in out.collect()}
        docs = out
    assert set(seen["toxicity"]) == set(texts) | set(clean)
    lines = {i: r["text"] for i, r in seen["line_dedup"].items()}
    assert lines[4] == words("gamma", 40) + "\n" + words("delta", 20) and lines[3] == texts[3] and lines[2] == ""
    assert seen["line_dedup"][4]["n_chars"] == len(lines[4])
    assert {1, 3, 4, 5, 6} <= set(seen["simhash_near_dedup"]) and not {2, 7} <= set(seen["simhash_near_dedup"])
    assert 5 not in seen["decontamination"] and {1, 3, 4, 6} <= set(seen["decontamination"])
    assert set(seen["bpe"]) == set(seen["decontamination"])
    assert set(corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").toPandas()["doc_id"]) == set(seen["bpe"])


def test_near_duplicate_stage_equals_brute_force(spark, tmp_path):
    """Copies with one to four words changed: similarities on both sides of 0.8, chains, and a bridge that isn't a hub."""
    rng = random.Random(11)
    texts = []
    for f in range(12):
        base = [f"w{f}x{rng.randrange(400)}" for _ in range(100)]
        texts.append(base)
        for _ in range(12):
            copy = list(rng.choice([base, texts[-1]]))
            for at in rng.sample(range(100), rng.randrange(1, 5)):
                copy[at] = f"new{rng.randrange(10**9)}"
            texts.append(copy)
    texts += [[f"o{k}y{j}" for j in range(30)] for k in range(20)] + [[], ["one", "two"], ["One", "two"]]
    sets = [{tuple(w.lower() for w in t[k : k + 5]) for k in range(max(1, len(t) - 4))} for t in texts]
    label, links = list(range(len(texts))), 0
    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links += 1
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    assert links > 50
    docs = spark.createDataFrame([(k, " ".join(t), "en", "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(set(label))


def test_near_duplicate_stage_takes_simhash_candidates(spark):
    """Pairs within simhash.THRESHOLD bits, found by anchors, with no bands at all; and the fingerprints are majorities."""
    import numpy as np
    from pyspark.sql import functions as F

    from factloom.llm import similar, simhash

    rng = random.Random(5)
    assert all(simhash.majority(np.array([simhash.xxhash.xxh64_intdigest(p.encode(), seed=simhash.SEED) for p in simhash.shingles(t)], dtype=np.uint64)) == simhash.fingerprint(t) for t in ("", "a b", "a b c d e f", "a a a a b"))
    texts = [" ".join(f"d{k // 3}w{j}" for j in range(300)) + f" end{k}" for k in range(30)] + ["", "one two"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "row long, text string").select("row", F.struct(F.col("row").alias("doc_id"), "text").alias("doc"))
    rows = similar.signatures(docs).collect()
    fps = {r["node"]: r["fp"] % (1 << 64) for r in rows}
    fps |= {10**6 + k: rng.getrandbits(64) for k in range(20)}
    fps |= {10**7 + k: fps[10**6 + k] ^ (1 << rng.randrange(64)) for k in range(20)} | {10**8: fps[10**6]}
    got = {frozenset((r["hub"], r["node"])) for r in similar.near_fingerprints(spark.createDataFrame([(n, f - (f >> 63 << 64)) for n, f in fps.items()], "node long, fp long")).collect()}
    wanted = {frozenset((a, b)) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= simhash.THRESHOLD}
    joined = lambda pairs: {frozenset(c) for c in _components(pairs)}
    assert joined(got) == joined(wanted) and len(wanted) > 22


def _components(pairs):
    at = {}
    for a, b in map(tuple, pairs):
        whole = at.get(a, {a}) | at.get(b, {b})
        at |= dict.fromkeys(whole, whole)
    return map(frozenset, at.values())


def test_no_stage_leaves_copies_of_texts(spark, tmp_path, monkeypatch):
    """With unique ids no scratch table that a stage leaves behind holds the texts again."""
    import os

    from factloom.llm import common

    rng = random.Random(3)
    noise = lambda: " ".join(f"{rng.getrandbits(60):x}" for _ in range(2000))
    docs = spark.createDataFrame([(k, noise(), "en", "s", 1) for k in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog today")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, size = spark.read.parquet(f"{tmp_path}/documents.parquet"), sum(f.stat().st_size for f in (tmp_path / "documents.parquet").iterdir())
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, str(tmp_path)).count() == 40
        assert sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path / "shared") for f in names) < size / 4


def test_stages_on_odd_rows(spark, tmp_path):
    """Null, repeated and shared ids, null, empty and very long texts, clashing columns, and an empty table."""
    from pyspark.sql import functions as F

    words = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    leak = words("p", 9) + " the quick brown fox jumps over the lazy dog today"
    rows = [(None, leak), (None, words("a", 70)), (None, words("a", 70)), (4, leak + " x"), (4, words("b", 40)), (5, words("c", 40)), (5, words("c", 40)), (6, None), (7, ""), (8, "word " * 300_000)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog today")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("row", "doc", "node", "keys", "spans", "_score", "first", "word", "component_id"):
        docs = docs.withColumn(name, F.lit(name))
    kept = {name: stage(spark, docs, str(tmp_path)) for name, stage in corpus_pipeline.STAGES[:-1]}
    assert all(k.columns == docs.columns for k in kept.values())
    assert all((r["row"], r["doc"], r["spans"]) == ("row", "doc", "spans") for k in kept.values() for r in k.collect())
    ids = {name: sorted((str(r["doc_id"]), (r["text"] or "")[:2]) for r in k.collect()) for name, k in kept.items()}
    every = sorted((str(i), (t or "")[:2]) for i, t in rows)
    assert ids["toxicity"] == every
    assert sorted(i for i, _ in ids["line_dedup"]) == sorted(i for i, _ in every)
    # the copies without an id become one, as do the rows 5 and the texts without words; the first row gives way to a row 4
    assert [i for i, _ in ids["simhash_near_dedup"]] == ["4", "4", "5", "6", "8", "None"]
    # rows with the passage go, null id or not; the other row 4 stays
    assert ids["decontamination"] == sorted(x for x in every if x[1] != "p0")
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
