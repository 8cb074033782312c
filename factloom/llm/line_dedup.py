"""Line deduplication with content-defined chunks, in DataFrame operations only.

A document's non-blank lines are hashed. A rolling hash over two line hashes chooses chunk boundaries: they depend
on the lines there and nothing before, so text inserted elsewhere doesn't shift them. A passage may be too short to hold
two boundaries, and its first and last lines may lie outside of its chunks; so, besides, the shortest run of lines of over
MIN_WORDS words from each line on, and up to each line, is a chunk (one line, if it is that long). Every repeated passage
of whole lines and more words is covered by such runs, to its first and last line. Chunks that occur more than once over
all documents lose all but their first occurrence (smallest doc_id, then line), after their lines' bytes have been
compared: a line hash that stands for two different lines keeps every chunk with it in place.

So a line goes exactly if it stands in some run of lines of over MIN_WORDS words that occurs before. Words of a line are
its blanks (U+0020) plus one. Lines end at line feeds. A passage that overlaps its own repetition keeps its beginning.
Defined cases: null texts stay null and empty ones empty; rows with a null doc_id come first; of equal ids the rows count
one after another, in the order they are read; repeated rows are documents of their own; very long texts are taken line
by line; an empty table stays empty; other columns, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import BROADCAST_ROWS, broadcast_if_small, keyed, persisted, scratch

MIN_WORDS = 50  # passages of more words go
DIVISOR = 8  # a boundary after one line in so many, on average
FACTOR, MODULUS = 31, 2147483647
BROADCAST_HASHES = 2_000_000


def line_hash(line: Column) -> Column:
    """60 bits of MD5, as any SQL engine can compute it."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 15), 16, 10).cast("long")


def _lines(documents: DataFrame) -> DataFrame:
    each = documents.select("row", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    return each.where(F.btrim("line", F.lit(" \t\r")) != "")


def _hashed(documents: DataFrame) -> DataFrame:
    line = F.col("line")
    return _lines(documents).select("row", "line_no", line_hash(line).alias("h"), (F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1).cast("long").alias("w"))


def chunks(lines: DataFrame) -> DataFrame:
    """row, first and last line_no, key (the line hashes) of content-defined chunks and of minimal passages."""
    place = Window.partitionBy("row").orderBy("line_no")
    before = F.coalesce(F.sum("w").over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rolled = (F.coalesce(F.lag("h").over(place), F.lit(0)) % MODULUS * FACTOR + F.col("h") % MODULUS) % MODULUS
    marked = lines.select("row", "line_no", "h", "w", before.alias("from"), (rolled % DIVISOR == 0).cast("int").alias("cut"))
    ahead = Window.partitionBy("row").orderBy("from").rangeBetween(0, MIN_WORDS)
    back = Window.partitionBy("row").orderBy("upto").rangeBetween(-MIN_WORDS, 0)
    whole = marked.withColumn("upto", F.col("from") + F.col("w")).select(
        "*", F.collect_list("h").over(ahead).alias("key"), F.last("line_no").over(ahead).alias("to_line"), F.sum("w").over(ahead).alias("words"),
        F.collect_list("h").over(back).alias("key_back"), F.first("line_no").over(back).alias("from_line"), F.sum("w").over(back).alias("words_back"),
        F.coalesce(F.sum("cut").over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("chunk"),
    )
    short = whole.where(F.col("words") > MIN_WORDS).select("row", F.col("line_no").alias("first"), F.col("to_line").alias("last"), "key")
    # those that stay over MIN_WORDS without their last line; the others are the shortest from their first line on
    ended = whole.where(F.col("words_back") - F.col("w") > MIN_WORDS).select("row", F.col("from_line").alias("first"), F.col("line_no").alias("last"), F.col("key_back").alias("key"))
    cut = whole.groupBy("row", "chunk").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.transform(F.array_sort(F.collect_list(F.struct("line_no", "h"))), lambda x: x["h"]).alias("key"), F.sum("w").alias("words"))
    return short.unionByName(ended).unionByName(cut.where((F.col("words") > MIN_WORDS) & (F.size("key") > 1)).select("row", "first", "last", "key"))


def _colliding(documents: DataFrame, repeated: DataFrame) -> DataFrame:
    """Line hashes of repeated chunks that stand for different bytes, by comparing the lines themselves."""
    hashes = persisted(repeated.select(F.explode("key").alias("h")).distinct(), "hashes")
    each = _lines(documents).select(line_hash(F.col("line")).alias("h"), "line").join(broadcast_if_small(hashes, hashes.count(), BROADCAST_HASHES), "h", "left_semi")
    return each.groupBy("h", "line").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")


def removals(documents: DataFrame) -> DataFrame:
    """row, spans: sorted (first, last) lines to remove. documents: row (unique; its order is that of the documents), text."""
    spans = persisted(chunks(_hashed(documents)), "chunks")
    repeated = persisted(spans.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("row", "first")).alias("keep")).where("n > 1").select("key", "keep"), "repeated")
    bad = persisted(_colliding(documents, repeated), "colliding")
    if not bad.isEmpty():
        touched = repeated.select("key", F.explode("key").alias("h")).join(bad, "h", "left_semi").select("key").distinct()
        repeated = repeated.join(touched, "key", "left_anti")
    again = spans.join(repeated, "key").where(F.struct("row", "first") != F.col("keep"))
    return again.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"))


def _cut(documents: DataFrame) -> DataFrame:
    """doc (a row's columns), text (what is left of it), n_lines, n_removed."""
    each, by_id = keyed(documents)
    if not by_id:
        each = each.select(F.struct(F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("row").alias("n")).alias("row"), "doc")
    with scratch():
        spans = persisted(removals(each.select("row", "doc.text")), "spans", keep=True)
    if spans.count() <= BROADCAST_ROWS:  # texts that stay as they are aren't shuffled
        ids = F.broadcast(spans.select("row"))
        rest = each.join(ids, "row", "left_anti").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
        joined = each.join(ids, "row", "left_semi").join(spans, "row").unionByName(rest)
    else:
        joined = each.join(spans, "row", "left")
    # spans are merged first, so that every line is looked up in few of them
    merged = F.aggregate(
        "spans", F.array().cast("array<struct<first:int,last:int>>"),
        lambda a, x: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["last"] >= x["first"] - 1), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(a, F.lit(-1))["first"].alias("first"), F.greatest(F.try_element_at(a, F.lit(-1))["last"], x["last"]).alias("last"))))).otherwise(F.concat(a, F.array(x))),
    )
    text = F.col("doc.text")
    cut = joined.select("doc", F.split(F.coalesce(text, F.lit("")), "\n").alias("lines"), F.when(F.col("spans").isNotNull(), merged).alias("spans"))
    kept = F.filter(F.col("lines"), lambda line, i: ~F.exists(F.col("spans"), lambda x: (i >= x["first"]) & (i <= x["last"])))
    return cut.select(
        "doc", F.when(F.col("spans").isNull(), text).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("spans").isNull(), 0).otherwise(F.aggregate("spans", F.lit(0), lambda a, x: a + x["last"] - x["first"] + 1)).cast("long").alias("n_removed"),
    )


def trimmed(documents: DataFrame, lengths: str | None = None) -> DataFrame:
    """documents with text replaced. lengths: a column that follows the text's length, in code points, where it changes."""
    cut = _cut(documents)

    def column(name: str) -> Column:
        if name == lengths:
            return F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("doc")[name]).alias(name)
        return F.col("text") if name == "text" else F.col("doc")[name].alias(name)

    return cut.select(*map(column, documents.columns))


def deduplicated(documents: DataFrame) -> DataFrame:
    """doc_id, text (what is left), n_lines, n_removed and n_removed_chars of each row."""
    removed = F.coalesce(F.length("doc.text") - F.length("text"), F.lit(0)).cast("long")
    return _cut(documents).select("doc.doc_id", "text", "n_lines", "n_removed", removed.alias("n_removed_chars"))


ORACLE = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents),
h AS (SELECT doc_id, line_no, ('0x' || substr(md5(line), 1, 15))::BIGINT AS h, length(line) - length(replace(line, ' ', '')) + 1 AS w FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
m AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s,
    CASE WHEN ((coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY line_no), 0) % {MODULUS} * {FACTOR} + h % {MODULUS}) % {MODULUS}) % {DIVISOR} = 0 THEN 1 ELSE 0 END AS cut FROM h),
b AS (SELECT doc_id, line_no AS last, min(line_no) OVER back AS first, list(h) OVER back AS key, sum(w) OVER back - w AS shorter
    FROM m WINDOW back AS (PARTITION BY doc_id ORDER BY s + w RANGE BETWEEN {MIN_WORDS} PRECEDING AND CURRENT ROW)),
x AS (SELECT *, list(h) OVER near AS key, max(line_no) OVER near AS to_line, sum(w) OVER near AS words, coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk
    FROM m WINDOW near AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND {MIN_WORDS} FOLLOWING)),
c AS (SELECT doc_id, line_no AS first, to_line AS last, key FROM x WHERE words > {MIN_WORDS}
    UNION ALL SELECT doc_id, first, last, key FROM b WHERE shorter > {MIN_WORDS}
    UNION ALL SELECT doc_id, min(line_no), max(line_no), list(h ORDER BY line_no) FROM x GROUP BY doc_id, chunk HAVING sum(w) > {MIN_WORDS} AND count(*) > 1),
r AS (SELECT key, min((doc_id, first)) AS keep FROM c GROUP BY key HAVING count(*) > 1),
g AS (SELECT DISTINCT c.doc_id, unnest(range(first, last + 1)) AS line_no FROM c JOIN r USING (key) WHERE (c.doc_id, c.first) <> keep),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.line_no) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.line_no) FILTER (WHERE g.line_no IS NULL), '') AS text FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.line_no = g.line_no GROUP BY l.doc_id)
SELECT doc_id, (CASE WHEN coalesce(documents.text, '') = '' THEN 0 ELSE n_lines END)::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, (length(documents.text) - length(k.text))::BIGINT AS n_removed_chars, sha256(k.text) AS text_sha256
FROM documents JOIN k USING (doc_id)
"""
