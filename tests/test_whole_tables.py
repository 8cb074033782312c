"""Queries over whole tables, without a row, language or file limit."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.functions import scalars as S
from factloom.operators import hierarchy, match
from factloom.plans import bridge as B
from factloom.plans import queries as plans

DATA = "/root/testdata/sf0.001"


def oracle(sql):
    con = duckdb.connect()
    for name in ("pages", "documents", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return con.execute(sql).fetchall()


def test_line_starts_and_ends_of_whole_tables(spark):
    for name in ("x32_all_line_starts", "x32_line_of_end"):
        assert sorted(tuple(r) for r in plans.queries()[name](spark, DATA).collect()) == sorted(oracle(plans.oracle_sql()[name]))


def test_symbols_in_order(spark):
    got = [tuple(r) for r in plans.queries()["t02_all_symbols_in_order"](spark, DATA).collect()]
    sql = plans.oracle_sql()["t02_all_symbols_in_order"]
    assert got == oracle("WITH " + plans.B.SYMBOLS_SQL + sql[sql.rindex(" SELECT id, name") :]) and len(got) > 50


@pytest.mark.parametrize("text", ["a\nРРР", "РА\n\nРЯ", "0\u00a0\nx", "x" * 100_000 + "\n" + "Р" * 50_000])
def test_line_of_counts_whole_bytes_only(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(S.line_of(F.col("t").cast("binary"), F.octet_length("t")).alias("n"))
    assert row.first()["n"] == text.count("\n") + 1


def small_facts(spark):
    """Shared names, a use bound under another spelling, one bound as name_match, two languages, names without uses."""
    symbols = spark.createDataFrame([("a", "php", "method", "run"), ("b", "php", "method", "Run"), ("c", "php", "class", "RUN"), ("d", "typescript", "function", "run"), ("e", "php", "function", "none")], "id string, language string, kind string, name string")
    rows = [(k, ("php", "typescript")[k % 4 == 3], ("run", "RUN", "other")[k % 3], ("call", "type", "read")[k % 5 % 3], "$this" if k % 2 else None) for k in range(60)]
    uses = spark.createDataFrame(rows, "use_id long, language string, spelling string, ref_kind string, receiver string")
    bindings = spark.createDataFrame([(k, "abcd"[k % 7 % 4], ("exact", "scoped", "name_match")[k % 3 if k % 11 else 2]) for k in range(0, 60, 2)], "use_id long, target_id string, resolution string")
    return symbols, uses, bindings


def test_candidate_counts_of_all_symbols(spark):
    columns = ["target", "n_exact", "n_scoped", "n_name_match", "total"]
    for facts in (small_facts(spark), B.facts(spark, DATA)):
        for kinds in (["call"], None):
            wanted = match.counts_by_resolution(match.references(*facts, "candidates", kinds), facts[0]).select(*columns).collect()
            assert sorted(map(tuple, match.candidate_counts(*facts, kinds).select(*columns).collect())) == sorted(map(tuple, wanted))
    assert plans.queries()["j03_all_candidates"](spark, DATA).count() == B.symbols(spark, DATA).count()


def test_exclusions_of_all_symbols(spark):
    unrelated = F.col("use_id") % 5 == 0
    for facts in (small_facts(spark), B.facts(spark, DATA)):
        kinds = facts[0].select(F.col("id").alias("target"), F.col("kind").alias("_kind"))
        wanted = match.exclusion_counts(match.references(*facts).join(kinds, "target"), F.col("_kind"), unrelated).collect()
        assert sorted(map(tuple, match.exclusion_counts_of_all(*facts, unrelated).collect())) == sorted(map(tuple, wanted))
    assert plans.queries()["j20_all_exclusions"](spark, DATA).count() > 0


def test_neighbours_of_all_symbols(spark):
    """Every symbol with neighbours gets its rows, as when it is asked for alone."""
    for name, depth in (("g08_all_neighbours", 1), ("g09_all_traversal", 2)):
        rows = plans.queries()[name](spark, DATA).collect()
        s, u, b = B.facts(spark, DATA)
        some = s.orderBy(F.xxhash64("id")).limit(3).select("id")
        ids = {r["id"] for r in some.collect()}
        alone = plans.context.traversal(s, u, b, some, depth=depth).collect()
        assert sorted(map(tuple, alone)) == sorted(tuple(r) for r in rows if r["target"] in ids) and len({r["target"] for r in rows}) > 3


def test_traversal_of_all_equals_traversal(spark, monkeypatch):
    """With caps that cut, all resolutions, types, parents, repeated ids, ids without a symbol, and small buckets."""
    rng = random.Random(2)
    ids = [f"s{k}" for k in range(60)]
    symbols = [(i, f"f{rng.randrange(3)}" if k % 9 else None, rng.randrange(50), rng.choice([None, "gone", *ids])) for k, i in enumerate([*ids, *ids[:5]])]
    s = spark.createDataFrame(symbols, "id string, file string, start_byte long, parent_id string")
    uses = [(k, f"u{k}", rng.choice(["call", "type", "read"]), rng.choice([None, "gone", *ids[:20]])) for k in range(400)]
    u = spark.createDataFrame(uses, "use_id long, file string, ref_kind string, containing_symbol string")
    b = spark.createDataFrame([(k, rng.choice(["gone", *ids]), rng.choice(S.RESOLUTIONS)) for k in range(0, 400, 2)], "use_id long, target_id string, resolution string")
    monkeypatch.setattr(plans.context, "_TOGETHER_HOPS", 7)
    for most in (1, 4, 12, 1000):
        wanted = plans.context.traversal(s, u, b, s.select("id").distinct(), most=most).collect()
        got = plans.context.traversal_of_all(s, u.join(b, "use_id"), most)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted)) and len(wanted) > 50


def test_whole_traversal_shuffles_no_paths(spark):
    """Its plan joins nothing by the two ends of a path; the rows that are dealt out are lists, names and targets."""
    plan = plans.queries()["g09_all_traversal"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "second_degree" not in plan and "MapInArrow" in plan


def test_whole_traversal_in_rounds(spark, monkeypatch):
    """Shuffled a part at a time, with the same rows; the result reads what was written and shuffles nothing more."""
    monkeypatch.setattr(plans.context, "_ROUND_ROWS", 2500)
    assert len(B.linked(spark, DATA)) == 3
    s, u, b = B.facts(spark, DATA)
    got = plans.queries()["g09_all_traversal"](spark, DATA)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    wanted = plans.context.traversal(s, u, b, s.select("id")).collect()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted)) and len(wanted) > 1000


def test_ancestors_of_deep_chains(spark, monkeypatch):
    """A chain longer than any bound on levels, which would be lowered here to keep the test short."""
    monkeypatch.setattr(hierarchy, "MOST_LEVELS", 2, raising=False)
    edges = spark.createDataFrame([(f"c{k}", "extends", f"c{k + 1}", f"c{k + 1}") for k in range(5)], "child string, relation string, qname string, parent string")
    got = {(r["ancestor"], r["depth"]) for r in hierarchy.ancestors(edges).where("id = 'c0'").collect()}
    assert got == {(f"c{k}", k) for k in range(1, 6)}
