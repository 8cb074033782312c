from pyspark.sql import functions as F

from factloom.functions import globs
from factloom.functions import scalars as S


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_folding_and_names(spark):
    r = one(
        spark,
        fold=S.ascii_fold(F.lit("ÄBC")), method=S.name_matches(F.lit("php"), F.lit("method"), F.lit("RUN"), F.lit("run")), const=S.name_matches(F.lit("php"), F.lit("const"), F.lit("A"), F.lit("a")),
        prop=S.name_matches(F.lit("php"), F.lit("property"), F.lit("$$x"), F.lit("$x")), prop2=S.name_matches(F.lit("php"), F.lit("property"), F.lit("x"), F.lit("$x")), ts=S.name_matches(F.lit("typescript"), F.lit("method"), F.lit("Run"), F.lit("run")),
    )
    assert r["fold"] == "Äbc" and r["method"] and not r["const"] and not r["prop"] and r["prop2"] and not r["ts"]


def test_ids_round_trip(spark):
    rows = [("a#b.php", "N\\C%23::m", None), ("x", "y", 3)]
    df = spark.createDataFrame(rows, "f string, q string, o int").withColumn("id", S.canonical_id(F.col("f"), F.col("q"), F.col("o")))
    got = df.withColumn("p", S.parsed_id(F.col("id"))).collect()
    assert [(r["p"]["file"], r["p"]["qualified_name"], r["p"]["ordinal"]) for r in got] == rows
    bad = spark.createDataFrame([("a",), ("a#",), ("a#b#0",), ("a#b%41",), ("a#b#1#2",)], "id string")
    assert all(r["p"] is None for r in bad.withColumn("p", S.parsed_id(F.col("id"))).collect())


def test_separators_paths_and_tokens(spark):
    r = one(
        spark,
        sep=S.normalized_separators(F.lit("\\A::b->c//d")), last=S.last_component(F.lit("A\\B::run")), up=S.joined_path(F.lit("a/b/c.ts"), F.lit("../d/./e")), out=S.joined_path(F.lit("a.ts"), F.lit("../x")),
        tokens=S.estimated_tokens(F.lit("äbc")), line=S.line_of(F.lit("a\nb\n\nc").cast("binary"), F.lit(5)), zero=S.line_of(F.lit("a\nb").cast("binary"), F.lit(0)),
    )
    assert (r["sep"], r["last"], r["up"], r["out"], r["tokens"], r["line"], r["zero"]) == ("A.b.c.d", "run", "a/d/e", None, 2, 4, 1)


def test_globs(spark):
    paths = ["tests/a.php", "src/tests/a.php", "src/a.test.ts", "a.test.ts", "src/x/deep/y.php", "keep/tests/z"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    hit = {r["path"]: r["m"] for r in df.select("path", globs.matches_any(F.col("path"), ["/tests/", "**/*.test.ts", "src/**/deep", "!a.test.ts"]).alias("m")).collect()}
    assert hit == {"tests/a.php": True, "src/tests/a.php": False, "src/a.test.ts": False, "a.test.ts": False, "src/x/deep/y.php": True, "keep/tests/z": False}
