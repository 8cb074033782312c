"""Scalar expressions over names, identifiers, spans and paths; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Strongest first. Fixed values.
RESOLUTIONS = ("exact", "scoped", "name_match")
#: Fixed values, in declaration order.
REF_KINDS = ("call", "type", "import", "assignment", "read", "write", "unknown")
EXACT_CASE_KINDS = ("const", "type_alias")


def ascii_fold(c: Column) -> Column:
    """Lower-cases A-Z only; F.lower would fold other letters too."""
    return F.translate(c, UPPER, LOWER)


def folds_case(language: Column, kind: Column) -> Column:
    return (language == "php") & ~kind.isin("property", *EXACT_CASE_KINDS)


def name_matches(language: Column, kind: Column, spelling: Column, name: Column) -> Column:
    """Whether a use's spelling can name a declaration: PHP properties ignore one leading $, PHP constants and type
    aliases and all of other languages compare exactly, other PHP names fold ASCII letters."""
    bare = lambda c: F.regexp_replace(c, "^[$]", "")
    return (
        F.when((language == "php") & (kind == "property"), bare(spelling) == bare(name))
        .when(folds_case(language, kind), ascii_fold(spelling) == ascii_fold(name))
        .otherwise(spelling == name)
    )


def match_key(language: Column, kind: Column, name: Column) -> Column:
    """The equality key of name_matches, so that names can be joined instead of compared pairwise."""
    return F.when((language == "php") & (kind == "property"), F.regexp_replace(name, "^[$]", "")).when(folds_case(language, kind), ascii_fold(name)).otherwise(name)


def short_name(spelling: Column) -> Column:
    """Last \\-segment of a PHP name, without a leading $."""
    return F.regexp_replace(F.substring_index(spelling, "\\", -1), "^[$]", "")


def normalized_separators(name: Column) -> Column:
    """Runs of :: -> \\ / . as one dot; one leading dot goes."""
    return F.regexp_replace(F.regexp_replace(name, r"(::|->|\\|/|\.)+", "."), r"^\.", "")


def ends_with_component(name: Column, suffix: Column) -> Column:
    return (name == suffix) | name.endswith(F.concat(F.lit("."), suffix))


def last_component(name: Column) -> Column:
    return F.substring_index(normalized_separators(name), ".", -1)


def tier_rank(resolution: Column) -> Column:
    """0 for the strongest; null for anything else."""
    out = F.lit(None).cast("int")
    for k, name in enumerate(RESOLUTIONS):
        out = F.when(resolution == name, k).otherwise(out)
    return out


def at_least(resolution: Column, minimum: str) -> Column:
    return tier_rank(resolution) <= RESOLUTIONS.index(minimum)


def estimated_tokens(text: Column) -> Column:
    """A third of the UTF-8 bytes, rounded up, in integers."""
    return F.floor((F.octet_length(text) + 2) / 3).cast("long")


def span_bytes(source: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end) of a binary source."""
    return F.substring(source, (start + 1).cast("int"), (end - start).cast("int"))


def escaped_component(c: Column) -> Column:
    """% first, then #."""
    return F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("#"), F.lit("%23"))


def unescaped_component(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("%23"), F.lit("#")), F.lit("%25"), F.lit("%"))


def canonical_id(file: Column, qualified_name: Column, ordinal: Column) -> Column:
    """path#name, or path#name#ordinal inside a group of duplicates."""
    head = F.concat(escaped_component(file), F.lit("#"), escaped_component(qualified_name))
    return F.when(ordinal.isNull(), head).otherwise(F.concat(head, F.lit("#"), ordinal.cast("string")))


def parsed_id(canonical: Column) -> Column:
    """struct(file, qualified_name, ordinal); null where the text isn't an id."""
    parts = F.split(canonical, "#")
    fine = F.size(parts).between(2, 3) & ~canonical.rlike("%(?!25|23)") & (F.get(parts, F.lit(0)) != "") & (F.get(parts, F.lit(1)) != "") & ((F.size(parts) == 2) | F.coalesce(F.get(parts, F.lit(2)).rlike("^[1-9][0-9]{0,8}$"), F.lit(False)))
    return F.when(
        fine,
        F.struct(unescaped_component(F.get(parts, F.lit(0))).alias("file"), unescaped_component(F.get(parts, F.lit(1))).alias("qualified_name"), F.get(parts, F.lit(2)).cast("int").alias("ordinal")),
    )


def collapsed_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\t\n\x0B\f\r ]+", " "))


def line_of(source: Column, byte: Column) -> Column:
    """1-based line of a byte offset in a binary source: line feeds before it, plus one."""
    head = F.hex(F.substring(source, F.lit(1), byte.cast("int")))
    return (F.regexp_count(head, F.lit(r"\G(?:[0-9A-F]{2})*?0A")) + 1).cast("int")


def content_hash(content: Column) -> Column:
    """sha256: and 64 hexadecimal digits."""
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def language_of(path: Column) -> Column:
    """By extension; null for files without an extractor."""
    return F.when(path.endswith(".php"), "php").when(path.endswith(".ts") | path.endswith(".tsx"), "typescript")


def joined_path(base: Column, relative: Column) -> Column:
    """A relative path resolved against a base file's directory; null if it climbs out of the root."""
    steps = F.concat(F.slice(F.split(base, "/"), F.lit(1), F.greatest(F.size(F.split(base, "/")) - 1, F.lit(0))), F.split(relative, "/"))
    start = F.array().cast("array<string>")
    walked = F.aggregate(
        steps, start,
        lambda a, x: F.when(a.isNull() | (x == "") | (x == "."), a).when((x == "..") & (F.size(a) == 0), F.lit(None).cast("array<string>")).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))),
    )
    return F.array_join(walked, "/")


def levenshtein(a: Column, b: Column) -> Column:
    """Over code points."""
    return F.levenshtein(a, b)


def line_distance(line: Column, start: Column, end: Column) -> Column:
    return F.greatest(start - line, line - end, F.lit(0))
