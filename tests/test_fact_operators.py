from pyspark.sql import functions as F

from factloom.operators import context, hierarchy, inventory, lookup, match, study


def test_pages_cover_everything(spark):
    m = spark.range(23).select((F.col("id") % 2).alias("target"), F.col("id"))
    seen = []
    for offset in (0, 5, 10):
        page = match.pages(m, "target", ["id"], offset, 5).where("target = 0").collect()
        seen += [r["id"] for r in page]
        assert all(r["total"] == 12 for r in page)
    assert seen == list(range(0, 24, 2))[:12]
    assert match.pages(m, "target", ["id"], 10, 5).where("target = 0").first()["next_offset"] is None


def test_references_match_table(spark):
    symbols = spark.createDataFrame([("t", "php", "method", "run"), ("o", "php", "method", "run")], "id string, language string, kind string, name string")
    uses = spark.createDataFrame([(1, "php", "x", "call"), (2, "php", "RUN", "call"), (3, "php", "y", "call"), (4, "php", "run", "read")], "use_id long, language string, spelling string, ref_kind string")
    bindings = spark.createDataFrame([(1, "t", "exact"), (2, "o", "scoped"), (3, "o", "exact")], "use_id long, target_id string, resolution string")
    only = symbols.where("id = 't'")
    r = {(x["use_id"], x["resolution"], x["resolved_target"]) for x in match.references(only, uses, bindings).collect()}
    c = {(x["use_id"], x["resolution"], x["resolved_target"]) for x in match.references(only, uses, bindings, "candidates").collect()}
    assert r == {(1, "exact", "t"), (4, "name_match", None)} and c == r | {(2, "name_match", "o")}
    assert match.references(only, uses, bindings, "candidates", ["call"], "scoped").count() == 1
    assert {tuple(x) for x in match.reference_counts(symbols, uses, bindings).collect()} == {("t", 1, 0, 1, 2), ("o", 1, 1, 1, 3)}


def test_ancestors_end_on_cycles(spark):
    edges = spark.createDataFrame([("a", "extends", "b", "b"), ("b", "extends", "c", "c"), ("c", "extends", "a", "a"), ("a", "implements", "V", None)], "child string, relation string, qname string, parent string")
    got = {(r["id"], r["ancestor"]): r["depth"] for r in hierarchy.ancestors(edges).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 2, ("b", "c"): 1, ("b", "a"): 2, ("c", "a"): 1, ("c", "b"): 2}
    ups = {r["id"]: (r["ids"], r["names"], r["open"]) for r in hierarchy.upsets(edges, spark.createDataFrame([("c",)], "id string")).collect()}
    assert ups == {"c": (["a", "b", "c"], ["a", "b", "c", "v"], True)}


def test_lookup_forms(spark):
    rows = [("f.php#N\\C", "f.php", "php", "class", "C", "N\\C", 0, 90, 1, 9), ("f.php#N\\C::run", "f.php", "php", "method", "run", "N\\C::run", 10, 50, 2, 5), ("g.ts#run", "g.ts", "typescript", "function", "run", "run", 0, 5, 1, 1)]
    s = spark.createDataFrame(rows, "id string, file string, language string, kind string, name string, qualified_name string, start_byte long, end_byte long, start_line long, end_line long")
    form = lambda q: (lambda f, m: (f, sorted(r["id"] for r in m.collect())))(*lookup.resolve(s, q))
    assert form("f.php#N\\C") == ("id", ["f.php#N\\C"])
    assert form("N\\C::run") == ("qualified_name", ["f.php#N\\C::run"])
    assert form("n\\c::RUN") == ("folded_qualified_name", ["f.php#N\\C::run"])
    assert form("f.php:3") == ("file_line", ["f.php#N\\C::run"])
    assert form("C->run") == ("suffix", ["f.php#N\\C::run"])
    assert form("RUN") == ("folded_suffix", ["f.php#N\\C::run"])
    assert form("nothing")[0] == "none"
    assert [r["qualified_name"] for r in lookup.suggestions(s, "rum").collect()][:2] == ["N\\C::run", "run"]
    try:
        lookup.file_line("../x:3")
        raise AssertionError
    except ValueError:
        pass


def test_greedy_fit_skips_and_goes_on(spark):
    items = spark.createDataFrame([("t", 1, 50, 10), ("t", 2, 60, 55), ("t", 3, 45, 5), ("t", 4, 30, 5)], "target string, rank int, full int, short int")
    r = context.greedy_fit(items, "target", 100).first()
    assert (r["taken"], r["used"], r["omitted"], r["n_signatures"]) == (3, 100, 1, 1)


def test_overlap_fit(spark):
    items = spark.createDataFrame([("t", "m", 1, "f", 10, 20, 4, 1), ("t", "c", 2, "f", 0, 100, 30, 3), ("t", "m2", 3, "f", 30, 40, 4, 1), ("t", "z", 4, "g", 0, 10, 90, 60)], "target string, id string, rank int, file string, start_byte long, end_byte long, full long, short long")
    got = {r["id"]: (r["form"], r["reason"]) for r in context.overlap_fit(items, 50).collect()}
    assert got == {"m": (None, "overlap"), "c": ("full", None), "m2": (None, "overlap"), "z": (None, "budget")}


def test_inventory(spark):
    schema = "path string, content_hash string, parse_status string, language string, size long, mtime_ns long"
    old = spark.createDataFrame([("a", "1", "ok", "php", 1, 1), ("b", "1", "ok", None, 1, 1), ("c", None, "size", None, 9, 1)], schema)
    new = spark.createDataFrame([("a", "2", "ok", "php", 1, 1), ("b", "1", "ok", None, 1, 2), ("d", "4", "ok", "php", 1, 1)], schema)
    change = lambda **k: {r["path"]: r["change"] for r in inventory.difference(old, new, **k).collect()}
    assert change() == {"a": "changed", "b": "same", "c": "deleted", "d": "new"}
    assert change(trust_metadata=True)["a"] == "same"
    digest = lambda df: inventory.snapshot_digest(df).first()[0]
    assert digest(old) == digest(old.orderBy(F.desc("path"))) != digest(new)


def test_bootstrap_draws_and_scores(spark):
    draws = study.bootstrap_draws([("a", "x"), ("b", "x"), ("c", "y")], 50, 1)
    assert len(draws) == 150 and draws == study.bootstrap_draws([("c", "y"), ("b", "x"), ("a", "x")], 50, 1)
    assert all(sum(t == "c" for r, t in draws if r == k) == 1 for k in range(50))
    row = spark.createDataFrame([(["a", "b", "b"], ["b", "c", "d"])], "answer array<string>, gold array<string>")
    s = study.set_scores(row, numerator=2, denominator=5).first()
    assert (s["hits"], s["precision"], s["passed"]) == (1, 0.5, True)
    assert spark.range(1).select(study.answer_json(F.lit("x\n```json\n{}\n```\n```json\n{\"a\": 1}\n```\n"))).first()[0] == '{"a": 1}'
    texts = spark.createDataFrame([("1", "a b c d e f g h i"), ("2", "a b")], "id string, text string")
    needles = spark.createDataFrame([("n", "x b c d e f g h i y")], "needle string, text string")
    assert [tuple(r) for r in study.contaminated(texts, needles).collect()] == [("1", 1)]
