"""Each operator against a brute-force version, round trips, held-out accuracy, and the defined edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from factloom.llm import ann, bpe, chat, decontam, line_dedup, quality, secret_scan, simhash, toxicity, url_filter
from factloom.llm.components import components, spanning_edges

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """rows: (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def words_of(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_contamination(text, items, size=10):
    w = words_of(text)
    hit, found = set(), set()
    for item, t in items:
        iw = words_of(t)
        windows = {tuple(iw)} if 0 < len(iw) <= size else {tuple(iw[k : k + size]) for k in range(len(iw) - size + 1)}
        for win in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    found.add(str(item))
                    hit.update(range(k, k + len(win)))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["the", "of", "a", "rare", "élan", "zebra", "42", "x"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", ".", "\n"]) for _ in range(n))
    items = [(k, text(rng.choice([1, 3, 9, 10, 11, 14]))) for k in range(6)] + [(20, None), (21, "..."), (2, text(12)), (22, "the")]
    rows = [(k, text(rng.randrange(60))) for k in range(40)]
    rows += [(100, None), (101, ""), (102, "the"), (None, items[0][1]), (5, rows[5][1])]
    rows += [(200 + k, text(5) + " " + (items[k % 6][1]) + " " + text(5)) for k in range(12)]
    got = decontam.contamination(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = sorted((str(i), *brute_contamination(t, [x for x in items if x[1]])) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == want


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(docs(spark, []), none).count() == 0
    assert [r["contaminated"] for r in decontam.contamination(docs(spark, [(1, "a b")]), none).collect()] == [False]


def test_proximity(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    d = docs(spark, [(1, "alpha beta gamma"), (2, "alpha x beta y gamma"), (3, "alpha " + "x " * 30 + "beta gamma")])
    windows = decontam.persisted(decontam.test_windows(items), "w")
    terms = decontam.persisted(decontam.vocabulary(windows), "t")
    index = decontam.build_index(d, terms)
    near = decontam.proximity_matches(index, windows, terms, slack=3).select("row").distinct()
    ids = index.join(near, "row").select("doc_id").distinct()
    assert sorted(r[0] for r in ids.collect()) == [1, 2]


def test_neighbours_recall_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    vectors = (centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16)) * 0.6).astype(np.float32)
    vectors[300:420] = vectors[0]  # copies: ties
    rows = [(k, v.tolist(), 0) for k, v in enumerate(vectors)]
    rows += [(5000, None, 0), (5050, [0.0] * 16, 0), (5100, [float("nan")] * 16, 0), (5150, [None] * 16, 0), (5200, [1.0, 2.0], 0), (None, [1.0] * 16, 0), (0, vectors[0].tolist(), 0)]
    index = ann.build_index(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), shard_points=400)
    assert index.count() > 3
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == set(range(0, 1500, 50))
    v = vectors.astype(np.float64)
    hits = 0
    for q in by:
        s = (v * v[q]).sum(axis=1) / (np.linalg.norm(v, axis=1) * np.linalg.norm(v[q]))
        want = sorted((-x, k) for k, x in enumerate(s) if k != q)[:5]
        mine = sorted(by[q])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        hits += len({k for _, k in want} & {m[1] for m in mine})
        assert all(abs(s[m[1]] - m[2]) < 1e-12 for m in mine)
        if s[300] > 1 - 1e-12:
            assert {m[1] for m in mine} == set([x for x in [0, *range(300, 420)] if x != q][:5])
    assert hits >= 0.9 * 5 * len(by)


def test_neighbours_of_few_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0)], "vec_id long, embedding array<float>, label int")
    assert [(r["query_id"], r["vec_id"]) for r in ann.nearest(few).collect()] == [(0, 1)]
    assert ann.nearest(few.limit(0)).count() == 0


def test_neighbours_over_several_shards_and_many_copies(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(900, 12)).astype(np.float32)
    vectors[600:640] = vectors[50]
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(vectors)] + [(100, vectors[7].tolist(), 0)], "vec_id long, embedding array<float>, label int")
    index = ann.build_index(df, shard_points=200, copies=21)
    assert index.count() >= 4
    asked = df.where("vec_id % 50 = 0 AND vec_id <> 100").select("vec_id", "embedding")
    by = {}
    for r in ann.search(index, asked, k=20).collect():
        by.setdefault(r["query_id"], set()).add(r["vec_id"])
    v = vectors.astype(np.float64)
    hits = 0
    for q, mine in by.items():
        s = (v * v[q]).sum(axis=1) / (np.linalg.norm(v, axis=1) * np.linalg.norm(v[q]))
        want = {k for _, k in sorted((-x, k) for k, x in enumerate(s) if k != q)[:20]}
        hits += len(want & mine)
    assert hits >= 0.9 * 20 * len(by) and by[50] == set(range(600, 620))
    with pytest.raises(ValueError):
        ann.search(ann.build_index(df, copies=6), asked, k=20)
    assert sorted(ann.nearest(df).collect()) == sorted(ann.nearest(df).collect())


TEXTS = ["", "plain", "<|im_end|>", "<|im_start|>user\nx<|im_end|>\n", "<\\|im_end|>", "<\\\\|im_start|>", "<|im_", "a\\b <|x|>", "é\n<|im_end|><|im_end|>"]


@pytest.mark.parametrize("role", ["user", "assistant", "a\nb", "r\\n", "<|im_end|>", "<"])
@pytest.mark.parametrize("text", TEXTS)
def test_chat_turns_round_trip(role, text):
    out, _ = chat.render_turn(role, text)
    assert [x[:2] for x in chat.parse(out)] == [(role, text)]
    both = out + chat.render_turn("user", "next")[0]
    assert [x[:2] for x in chat.parse(both)] == [(role, text), ("user", "next")]


def test_chat_plain_text_is_left_alone():
    assert chat.render_turn("user", "a <|other|> b") == ("<|im_start|>user\na <|other|> b<|im_end|>\n", 0)


def test_conversations(spark):
    rows = [(1, 1, "assistant", TEXTS[2]), (1, 0, "user", TEXTS[3]), (1, 2, "assistant", None), (2, None, None, "x"), (None, 0, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.conversation_digests(df).collect()}
    assert set(got) == {1, 2, None}
    turns = f"user\n{TEXTS[3]}\nassistant\n{TEXTS[2]}\nassistant\n\n"
    assert got[1]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256(TEXTS[2].encode()).hexdigest() and got[1]["loss_chars"] == len(TEXTS[2])
    parts = chat.format_turns(df.where("conv_id = 1")).orderBy("seq").collect()
    whole = "".join(p["formatted"] for p in parts)
    assert [x[:2] for x in chat.parse(whole)] == [("user", TEXTS[3]), ("assistant", TEXTS[2]), ("assistant", "")]
    assert got[1]["formatted_chars"] == len(whole)
    assert chat.conversation_digests(df.limit(0)).count() == 0


ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def brute_secrets(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def test_secrets_equal_brute_force():
    rng = random.Random(5)
    parts = ["token", "secret", "api_key", "APIKEY", "PassWD", "password", ":", "=", " ", '"', "'", "AKIA", "ABCDEFGH12345", "a0f9" * 5, "deadbeef", "é🙂", "x", "abcdefgh", "\n", "AKI", "ghp_" + "A1" * 18]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert [x for x in secret_scan.find_secrets(t) if x[1] < secret_scan.BASE] == brute_secrets(t), t
    assert (4, 3, 44) in secret_scan.find_secrets("see ghp_" + "A1" * 18)


def test_secrets_of_odd_rows(spark):
    rows = [(1, None), (None, "token=abcdefgh"), (3, ""), (3, ""), (4, "é token: 'abcdefgh'")]
    got = sorted((str(r["doc_id"]), r["n_assign"], r["spans"]) for r in secret_scan.scan(docs(spark, rows)).collect())
    assert got == [("1", 0, ""), ("3", 0, ""), ("3", 0, ""), ("4", 1, "assign:2:18"), ("None", 1, "assign:0:14")]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path, pattern = bpe.default_vocabulary()
    mine, theirs = bpe.Bpe(path, pattern), Tokenizer.from_file(path)
    rng = random.Random(1)
    texts = ["", "<|endoftext|>a <|endoftext|>", " \n\n  x\t\ty'll 'LL I've café 日本語 🙂🙂 \x00\x01", "a" * 3000, "ab" * 777, " " * 1000, "zzzz!!!!????" * 50]
    texts += ["".join(rng.choice("abcdehinorst AEé!1'  \n") for _ in range(rng.randrange(60))) for _ in range(1500)]
    want = [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]
    got = mine.encode_batch(texts)
    assert got == want
    assert [mine.decode(x) for x in got] == [theirs.decode(x, skip_special_tokens=False) for x in want]
    row = bpe.encode_digests(docs(spark, [(1, None), (None, "hi there")])).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in row) == [("1", 0), ("None", 2)]
    assert {tuple(r["ids"]) for r in bpe.encode(docs(spark, [(1, "hi there")])).collect()} == {tuple(mine.encode_batch(["hi there"])[0])}


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_equals_brute_force(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice(["alpha", "beta", "Gamma", "delta", "épsilon", "zeta"]) + str(rng.randrange(40)) for _ in range(80)) for _ in range(6)]
    rows = []
    for k in range(240):
        w = base[k % 6].split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
        rows.append((k, " ".join(w)))
    rows += [(300, None), (301, ""), (302, "one"), (303, "One"), (304, "two words"), (7, rows[7][1]), (None, "one")]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in got) == sorted((str(i), f"{f:016x}") for (i, _), f in zip(rows, fps, strict=True))
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2 and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    want = {}
    for (i, _), x in zip(rows, label, strict=True):
        if i is not None:
            want[x] = min(i, want.get(x, i))
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in got) == sorted((str(i), want.get(x)) for (i, _), x in zip(rows, label, strict=True))
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_anchors_meet():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2**63, 200).astype(np.uint64)
    home, row, anchor = simhash.anchors(x)
    for k in range(200):
        y = int(x[k])
        for b in rng.choice(64, 2, replace=False):
            y ^= 1 << int(b)
        other, _, replicas = simhash.anchors(np.array([y], dtype=np.uint64))
        assert home[k] in replicas and other[0] in anchor[row == k]


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(1, k) for k in range(2, 60)] + [(7, 7), (900, 800)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 100 for k in range(100, 141)}, **{k: 1 for k in range(1, 60)}, 900: 800, 800: 800}
    assert spanning_edges(np.array([[1, 2], [2, 3], [5, 6], [6, 7], [3, 1]])).tolist() == [[2, 1], [3, 1], [6, 5], [7, 5]]


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(9)
    common = [a + b for a in ("ta", "re", "mo", "li", "su", "ne") for b in ("na", "ri", "to", "ve", "pa")]
    bad = ["blargidiot", "grumblefool", "snarlscum"]
    rows, labels = [], []
    for k in range(900):
        w = [rng.choice(common) for _ in range(rng.randrange(20, 60))]
        if k % 4 == 0:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(k % 4 == 0)))
    rows += [(5000, None), (5001, ""), (None, "tana")]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.scored(docs(spark, rows), table).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 3 == 1}
    known = [r for r in held if r["doc_id"] < 900]
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in known) >= 0.97 * len(known)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    kept = toxicity.without_toxic(docs(spark, rows), table)
    assert kept.columns == docs(spark, []).columns and kept.count() == sum(1 - r["predicted"] for r in got)


def dense_toxicity(rows, train):
    """Scores by dense cosines: rows (doc_id, text), train {doc_id: label}. Returns {doc_id: (score, evidence)}."""
    word = re.compile(r"[^\W\d_]+")

    def terms(text):
        words, counts = word.findall(text.lower()), {}
        for w in words:
            for g in ["=" + w] + ["^" + w[:k] for k in range(3, 8) if k < len(w)]:
                counts[g] = counts.get(g, 0) + 1
        found = set()
        for g, n in counts.items():
            found |= {(g, k) for k in range(20) if n >= 2**k}
            found |= {(g, -k) for k in range(4, 11) if n >= 2 and n * 2**k >= len(words)}
        return found

    ids = sorted(train)
    texts = dict(rows)
    sets = {i: terms(texts[i] or "") for i in ids}
    n = [sum(1 - train[i] for i in ids), sum(train[i] for i in ids)]
    df = {}
    for i in ids:
        for t in sets[i]:
            df.setdefault(t, [0, 0])[train[i]] += 1
    weight = {}
    for t, (n0, n1) in df.items():
        a, b, c, d = n1 + 0.5, n0 + 0.5, n[1] - n1 + 0.5, n[0] - n0 + 0.5
        w = abs(np.log(a / c) - np.log(b / d)) - toxicity.SIGMA * np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
        if w > 0:
            weight[t] = w * (np.log((1 + len(ids)) / (1 + n0 + n1)) + 1)
    vocabulary = sorted(weight)
    place = {t: k for k, t in enumerate(vocabulary)}

    def vector(found):
        v = np.zeros(len(vocabulary))
        for t in found & weight.keys():
            v[place[t]] = weight[t]
        return v / (np.linalg.norm(v) or 1)

    x = np.array([vector(sets[i]) for i in ids])
    y = np.array([train[i] for i in ids])
    base = n[1] / len(ids)

    def near(v, but=-1):
        s = np.round(x @ v, 12)
        if but >= 0:
            s[but] = 0
        order = [k for k in np.lexsort((np.arange(len(ids)), -s)) if s[k] > 0][: toxicity.K]
        return s[order], order

    def vote(s, order):
        c = s / (1.05 - np.minimum(s, 1))
        return ((c * y[order]).sum() + 0.05 * base) / (c.sum() + 0.05)

    own = [near(x[k], k) for k in range(len(ids))]
    empty = [k for k in range(len(ids)) if not len(own[k][1])]
    none = (y[empty].sum() + base) / (len(empty) + 1)
    bins = {k: min(int(vote(*own[k]) * 50), 49) for k in range(len(ids)) if len(own[k][1])}
    pools = []
    for b in range(50):
        mine = [y[k] for k in bins if bins[k] == b]
        pools.append([sum(mine) + (b + 0.5) / 50, len(mine) + 1, 1])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last, strict=True)]
    table = [s / c for s, c, m in pools for _ in range(m)]
    out = {}
    for i, text in rows:
        s, order = near(vector(terms(text or "")))
        out[i] = (table[min(int(vote(s, order) * 50), 49)], ids[order[0]]) if len(order) else (none, None)
    return out


def test_toxicity_equals_dense_scores(spark):
    rng = random.Random(1)
    common = ["good", "fine", "neutral", "trashcan", "word", "text", "other"] + [a + b for a in ("ta", "re", "mo") for b in ("na", "rito", "vera")]
    rows, labels = [], []
    for k in range(500):
        w = [rng.choice(common) for _ in range(rng.randrange(4, 40))]
        bad = rng.random() < 0.3
        for _ in range(rng.randrange(1, 4) if bad else rng.random() < 0.05):
            w[rng.randrange(len(w))] = "blarg" + rng.choice(["", "ish", "ton", "s"])
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(bad)))
    rows += [(900, None), (901, ""), (902, "..."), (903, "BLARGish blargton " * 3)]
    got = {r["doc_id"]: r for r in toxicity.scored(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    want = dense_toxicity(rows, {i: y for i, _, y in labels if zlib.crc32(str(i).encode()) % 3 != 1})
    assert len({round(s, 6) for s, _ in want.values()}) >= 4
    for i, (score, evidence) in want.items():
        assert abs(got[i]["score"] - score) < 1e-9, i
        assert got[i]["evidence"] == evidence, i
    assert got[903]["predicted"] == 1 and got[901]["predicted"] == 0


def test_toxicity_of_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.scored(docs(spark, []), labels).count() == 0
    long = docs(spark, [(1, "word " * 200_000), (1, "word " * 200_000), (None, "x"), (3, "bad")])
    assert toxicity.scored(long, labels).count() == 4


def test_caches_are_bounded_and_emptied():
    model = bpe.Bpe(*bpe.default_vocabulary())
    bound, bpe.CACHED_BYTES = bpe.CACHED_BYTES, 1 << 16
    try:
        for k in range(60):
            model.encode_batch([" ".join(f"w{k}x{j}q" for j in range(400)), "z" * 5000])
            assert model.known_bytes <= bpe.CACHED_BYTES + (400 * 3 * 400) and all(len(w) <= bpe.CACHED_LETTERS for w in model.known)
    finally:
        bpe.CACHED_BYTES = bound
    model.release()
    assert not model.known and not model.fits
    words = toxicity.Vocabulary({"=bad": 1.0, "^bad": 1.0})
    for k in range(toxicity._CACHED_WORDS + 1000):
        words.terms_of(f"bad{chr(97 + k % 26)}{''.join(chr(97 + int(c)) for c in str(k))}")
    assert 0 < len(words.known) <= toxicity._CACHED_WORDS
    assert words.terms_of("badly bad").tolist() == [0, 1] and words.terms_of("x" * 100).tolist() == []


def test_toxicity_finds_each_term_of_a_text():
    words = ["a", "ab", "abc", "abcd", "abcde", "abcdef", "abcdefg", "abcdefgh", "abd", "bcdefghij", "xyzzy"]
    every = sorted({t for w in words for t in toxicity.terms(" ".join([w] * 3))})
    for keep in (every, [t for t in every if t[0] == "="], [t for t in every if t[0] == "^"], *([t] for t in every)):
        vocabulary = toxicity.Vocabulary(dict.fromkeys(keep, 1.0))
        for text in (*words, " ".join(words * 2), "ABCDEFG abce abcdx, bcdefgh", ""):
            assert vocabulary.terms_of(text).tolist() == [k for k, t in enumerate(sorted(keep)) if t in toxicity.terms(text)]


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in toxicity.scored(docs(spark, [(1, "a")]), none).collect()] == [0.5]


def test_resampling(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["good", "word", "text", "nice"]) for _ in range(30)) if k % 5 else "!!! ### zzz " * 10) for k in range(500)] + [(None, "good"), (900, None), (901, "")]
    labels = spark.createDataFrame([(k, int(k % 5 > 0), 0) for k in range(200)], "doc_id long, quality int, toxic int")
    got = quality.resampled(docs(spark, rows), labels).collect()
    assert len(got) == 503 and sum(r["selected"] for r in got) == int(np.ceil(0.8 * 503))
    keys = sorted((r["key"] for r in got), reverse=True)
    assert min(r["key"] for r in got if r["selected"]) == keys[sum(r["selected"] for r in got) - 1]
    junk = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 500 and r["doc_id"] % 5 == 0]
    assert sum(r["selected"] for r in junk) < 0.2 * len(junk)
    assert [r["log_weight"] for r in got if r["doc_id"] in (900, 901)] == [0, 0]
    ratio = quality.model(docs(spark, rows), labels)
    raw = sum(np.bincount(quality.buckets(t or ""), minlength=quality.BUCKETS) for _, t in rows)
    target = sum(np.bincount(quality.buckets(t or ""), minlength=quality.BUCKETS) for i, t in rows if i is not None and i < 200 and i % 5)
    assert np.allclose(ratio, np.log((target + 1) / (target + 1).sum()) - np.log((raw + 1) / (raw + 1).sum()))
    assert quality.resampled(docs(spark, []), labels).count() == 0


def test_kth_largest(spark):
    values = [float(x * 37 % 1000) for x in range(20_000)]
    df = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 20, 21, 7777, 20_000):
        assert quality.kth_largest(df, "key", k, few=100) == sorted(values, reverse=True)[k - 1]


def brute_line_dedup(rows):
    """Every run of whole lines of over 50 words, of any length, loses all but its first occurrence."""
    from collections import defaultdict

    seen, gone = defaultdict(list), set()
    for i, text in rows:
        lines = [(k, x) for k, x in enumerate((text or "").split("\n")) if x.strip(" \t\r")]
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += lines[b][1].count(" ") + 1
                if n > 50:
                    seen[tuple(x for _, x in lines[a : b + 1])].append((i, lines[a][0], lines[b][0]))
    for places in seen.values():
        for i, a, b in sorted(places)[1:]:
            gone.update((i, k) for k in range(a, b + 1))
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) if t else t for i, t in rows}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(8)
    line = lambda n: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(n))
    passages = [[line(rng.choice([9, 20, 30, 60])) for _ in range(rng.randrange(1, 6))] for _ in range(5)]
    rows = []
    for k in range(60):
        parts = [line(rng.randrange(1, 25)) for _ in range(rng.randrange(0, 6))]
        if k % 2:
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = rng.choice(passages) + ([""] if k % 4 == 1 else [])
        rows.append((k, "\n".join(parts)))
    rows += [(70, None), (71, ""), (72, "\n\n"), (73, rows[3][1]), (74, "short line")]
    want = brute_line_dedup(rows)
    assert {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(docs(spark, rows)).collect()} == want
    got = line_dedup.trimmed(docs(spark, rows), lengths="n_chars")
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in got.collect()} == {i: (t, len(t or "")) for i, t in want.items()}


def test_line_dedup_takes_a_passage_to_its_last_line(spark):
    words = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    passage = [words("a", 30), words("b", 30), words("c", 9), words("d", 9)]
    rows = [(1, "\n".join([words("x", 5), *passage, words("y", 5)])), (2, "\n".join([words("z", 7), *passage, words("q", 6)])), (3, "\n".join(passage[2:]))]
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(docs(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: words("z", 7) + "\n" + words("q", 6), 3: rows[2][1]}


def test_line_dedup_equals_brute_force_on_whole_documents(spark):
    import os

    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("the driver's tables aren't here")
    table = spark.read.parquet(f"{path}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect())
    assert {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(table).collect()} == brute_line_dedup(rows)


def test_line_dedup_of_repeated_and_null_ids(spark):
    long = "\n".join(" ".join(f"w{k}{j}" for j in range(30)) for k in range(3))
    got = line_dedup.deduplicated(docs(spark, [(1, long), (1, long), (None, long), (2, "x")])).collect()
    assert sorted((str(r["doc_id"]), len(r["text"])) for r in got) == [("1", 0), ("1", 0), ("2", 1), ("None", len(long))]
    assert line_dedup.deduplicated(docs(spark, [])).count() == 0


def test_url_filter(spark):
    rows = [
        (1, "http://a.example.com/en/5"), (2, "https://Example.COM/en/77?x=/de/"), (3, "http://x.net/de/1"), (4, "http://example.net/de/8#a"), (5, "ftp://y.org/es/"),
        (6, None), (7, "no scheme"), (8, "http://notexample.com"), (9, "http://m.example.org/en/3"), (10, "http://b.com/en/"), (11, "://com/en/?q"),
    ]
    got = {r["page_id"]: r for r in url_filter.judged(spark.createDataFrame([(i, u, "") for i, u in rows], "page_id long, url string, html string")).collect()}
    assert {i: (r["rule"], r["verdict"]) for i, r in got.items() if r["rule"]} == {1: ("com/en/", "block"), 2: ("example.com/en/7", "allow"), 3: ("net/de/", "allow"), 4: ("example.net/de/8", "block"), 5: ("org/es/", "block"), 10: ("com/en/", "block"), 11: ("com/en/", "block")}
    assert (got[2]["host"], got[2]["path"]) == ("example.com", "/en/77") and (got[6]["host"], got[7]["path"]) == ("", "")
    assert got[9]["verdict"] == "allow"
    w = url_filter.train()
    right = 0
    for url, label in url_filter.LABELLED:
        at = url_filter.features(*url_filter._split(url))
        right += (w[at].sum() / np.sqrt(len(at)) + w[-1] > 0) == label
    assert right == len(url_filter.LABELLED)


def test_extra_columns_with_clashing_names(spark):
    from pyspark.sql import functions as F

    rows = docs(spark, [(1, "token=abcdefgh one two"), (2, "b")])
    for name in ("_score", "doc", "node", "keys", "row", "fp", "words", "term", "spans", "h", "key", "score", "good", "selected", "component_id", "line"):
        rows = rows.withColumn(name, F.lit("x"))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert decontam.contamination(rows, items).where("contaminated").count() == 1
    assert secret_scan.scan(rows).count() == simhash.near_duplicates(rows).count() == toxicity.scored(rows, labels).count() == quality.resampled(rows, labels).count() == bpe.encode_digests(rows).count() == 2
    assert line_dedup.deduplicated(rows).count() == 2
    kept = line_dedup.trimmed(rows.withColumn("_lines", F.lit("y")).withColumn("doc", F.lit("z")))
    assert {(r["row"], r["spans"], r["_lines"], r["doc"]) for r in kept.collect()} == {("x", "x", "y", "z")}
    assert toxicity.without_toxic(rows, labels).columns == rows.columns


def test_quality_model_counts_every_labelled_document(spark, monkeypatch):
    n = 60_000
    rows = spark.range(n).selectExpr("nullif(id, 7) AS doc_id", "concat('w', id % 997, ' v', id % 13) AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    labels = spark.range(n).selectExpr("id AS doc_id", "CAST(id < 55000 AS int) AS quality", "0 AS toxic")
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for k in range(n):
        at = quality.buckets(f"w{k % 997} v{k % 13}")
        np.add.at(raw, at, 1)
        if k < 55_000 and k != 7:
            np.add.at(target, at, 1)
    share = lambda c: np.log((c + quality.SMOOTHING) / (c + quality.SMOOTHING).sum())
    assert np.allclose(quality.model(rows, labels), share(target) - share(raw), atol=1e-12)
    monkeypatch.setattr(quality, "MOST_IN_PLACE", 0)
    assert np.allclose(quality.model(rows, labels), share(target) - share(raw), atol=1e-12)


def test_line_dedup_leaves_no_copy_of_texts(spark, tmp_path, monkeypatch):
    """Unique ids number the rows; only repeated or null ids need a written copy. Either way the same lines go."""
    from factloom.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    passage = "\n".join(" ".join(f"p{r}w{k}" for k in range(30)) for r in range(3))
    texts = ["a\n" + passage, "b\n" + passage + "\nc", "d", None]
    left = ["a\n" + passage, "b\nc", "d", None]
    for ids, copied in (([1, 2, 3, 4], False), ([1, 2, 2, None], True)):
        rows = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
        assert sorted(map(str, (r["text"] for r in line_dedup.deduplicated(rows).collect()))) == sorted(map(str, left))
        assert any("numbered" in p.name for p in tmp_path.iterdir()) == copied
