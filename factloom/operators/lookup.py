"""Symbol queries: forms, suggestions, file:line, ordinals, spans."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import scalars as S

U32 = 2**32 - 1


def with_ordinals(symbols: DataFrame, ties: list[str] | None = None) -> DataFrame:
    """ordinal 1..n by (start, end, kind), then any ties keys, inside groups of equal (file, qualified_name); null where alone."""
    group = Window.partitionBy("file", "qualified_name")
    n = F.count("*").over(group)
    return symbols.withColumn("ordinal", F.when(n > 1, F.row_number().over(group.orderBy("start_byte", "end_byte", "kind", *(ties or [])))))


def symbol_order() -> list:
    return [F.col("file"), F.col("start_byte"), F.col("id")]


def suggestions(symbols: DataFrame, query: str, most: int = 5) -> DataFrame:
    """The nearest names by edit distance between the query's last component and a short name, letters folded for kinds
    that fold: the first symbol of each qualified name, then the smallest distance, ties by the qualified name's bytes."""
    first = Window.partitionBy("qualified_name").orderBy(*symbol_order())
    once = symbols.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    wanted, folds = S.last_component(F.lit(query)), F.coalesce(S.folds_case(F.col("language"), F.col("kind")), F.lit(False))
    distance = F.when(folds, S.levenshtein(S.ascii_fold(F.col("name")), S.ascii_fold(wanted))).otherwise(S.levenshtein(F.col("name"), wanted))
    return once.withColumn("distance", distance).orderBy("distance", "qualified_name").limit(most)


def innermost(symbols: DataFrame, places: DataFrame, bin_lines: int = 256) -> DataFrame:
    """(file, line, id): of the symbols that contain a line those that contain no other such symbol strictly.

    Intervals meet lines by (file, block of lines), an equality join; a symbol is copied to the blocks it covers.
    """
    spans = symbols.select("file", "id", "start_line", "end_line", "start_byte", "end_byte").withColumn("_block", F.explode(F.sequence(F.floor(F.col("start_line") / bin_lines), F.floor(F.col("end_line") / bin_lines))))
    at = places.select("file", "line", F.floor(F.col("line") / bin_lines).alias("_block")).distinct()
    inside = at.join(spans, ["file", "_block"]).where(F.col("line").between(F.col("start_line"), F.col("end_line"))).drop("_block")
    a, b = inside.alias("a"), inside.alias("b")
    strictly = (F.col("a.file") == F.col("b.file")) & (F.col("a.line") == F.col("b.line")) & (F.col("a.start_byte") <= F.col("b.start_byte")) & (F.col("b.end_byte") <= F.col("a.end_byte")) & ((F.col("a.start_byte") < F.col("b.start_byte")) | (F.col("b.end_byte") < F.col("a.end_byte")))
    return a.join(b, strictly, "left_anti").select("file", "line", "id")


def containers(symbols: DataFrame, spans: DataFrame, bin_bytes: int = 4096) -> DataFrame:
    """(file, start_byte, end_byte, id) of the shortest symbol around each span; null id without one. Spans meet symbols by
    (file, block of bytes); ties go to the later start, then the smaller id."""
    wide = symbols.select("file", "id", F.col("start_byte").alias("_s"), F.col("end_byte").alias("_e")).withColumn("_block", F.explode(F.sequence(F.floor(F.col("_s") / bin_bytes), F.floor(F.col("_e") / bin_bytes))))
    at = spans.select("file", "start_byte", "end_byte").distinct().withColumn("_block", F.floor(F.col("start_byte") / bin_bytes))
    inside = at.join(wide, ["file", "_block"]).where((F.col("_s") <= F.col("start_byte")) & (F.col("end_byte") <= F.col("_e")))
    best = inside.groupBy("file", "start_byte", "end_byte").agg(F.min_by("id", F.struct(F.col("_e") - F.col("_s"), -F.col("_s"), "id")).alias("id"))
    return at.drop("_block").join(best, ["file", "start_byte", "end_byte"], "left")


def folded_overloads(declarations: DataFrame, by: list[str]) -> DataFrame:
    """Of declarations with the same keys every implementation (has_body) stays; without one, the first signature."""
    group = Window.partitionBy(*by)
    first = F.row_number().over(group.orderBy("start_byte", "id")) == 1
    return declarations.withColumn("_keep", F.col("has_body") | (~F.bool_or("has_body").over(group) & first)).where("_keep").drop("_keep")


def nearest_to_line(symbols: DataFrame, file: str, line: int, most: int = 5) -> DataFrame:
    """qualified_name, distance of the nearest symbols of a file, each name once."""
    here = symbols.where(F.col("file") == file).withColumn("distance", S.line_distance(F.lit(line), F.col("start_line"), F.col("end_line")))
    first = Window.partitionBy("qualified_name").orderBy("distance", "start_byte", "id")
    return here.withColumn("_n", F.row_number().over(first)).where("_n = 1").orderBy("distance", "start_byte", "id").limit(most).select("qualified_name", "distance")


def file_line(query: str) -> tuple[str, int] | None:
    """(path, line) of a file:line query, None if it isn't one; ValueError if it is a bad one."""
    path, colon, digits = query.rpartition(":")
    if not colon or not re.fullmatch(r"[0-9]+", digits) or not path or path.endswith(":"):
        return None
    if path.startswith("/") or ".." in path.split("/") or not 1 <= int(digits) <= U32:
        raise ValueError(f"not a place in the repository: {query}")
    return path, int(digits)


def resolve(symbols: DataFrame, query: str) -> tuple[str, DataFrame]:
    """(form, matches) of the first form with a match: id, qualified name (exact, then folded), file:line, dotted suffix
    (exact, then folded), short name; ("none", empty) without one. symbols needs language."""
    place = file_line(query)
    name, dotted = F.col("qualified_name"), S.normalized_separators(F.col("qualified_name"))
    folds = S.folds_case(F.col("language"), F.col("kind"))
    wanted, suffix = F.lit(query), S.normalized_separators(F.lit(query))
    forms = [
        ("id", symbols.where(F.col("id") == query)),
        ("qualified_name", symbols.where(name == wanted)),
        ("folded_qualified_name", symbols.where(folds & (S.ascii_fold(name) == S.ascii_fold(wanted)))),
    ]
    if place:
        at = symbols.sparkSession.createDataFrame([place], "file string, line long")
        forms.append(("file_line", symbols.join(innermost(symbols, at).select("id"), "id", "left_semi")))
    forms += [
        ("suffix", symbols.where(S.ends_with_component(dotted, suffix))),
        ("folded_suffix", symbols.where(folds & S.ends_with_component(S.ascii_fold(dotted), S.ascii_fold(suffix)))),
        ("short_name", symbols.where(S.name_matches(F.col("language"), F.col("kind"), wanted, F.col("name")))),
    ]
    for form, found in forms:
        if not found.isEmpty():
            return form, found
    return "none", symbols.limit(0)


def module_candidates(imports: DataFrame) -> DataFrame:
    """(file, specifier, candidate): the paths that a relative module specifier may mean, in TypeScript's order."""
    base = S.joined_path(F.col("file"), F.col("specifier"))
    stem = F.regexp_replace(base, r"\.(js|jsx)$", "")
    plain = F.array(*(F.concat(base, F.lit(x)) for x in (".ts", ".tsx", ".d.ts", "/index.ts", "/index.tsx", "/index.d.ts")), base)
    mapped = F.array(*(F.concat(stem, F.lit(x)) for x in (".ts", ".tsx", ".d.ts")))
    relative = imports.where(F.col("specifier").startswith("./") | F.col("specifier").startswith("../")).where(base.isNotNull())
    return relative.select("file", "specifier", F.explode(F.when(base.rlike(r"\.jsx?$"), mapped).otherwise(plain)).alias("candidate"))


def resolved_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file, specifier, path) of the imports for which exactly one candidate is a known file."""
    found = module_candidates(imports).join(files.select(F.col("path").alias("candidate")), "candidate")
    return found.groupBy("file", "specifier").agg(F.count_distinct("candidate").alias("_n"), F.min("candidate").alias("path")).where("_n = 1").drop("_n")
