"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

The index stores a posting (document row, term, position) for every occurrence of a benchmark term in the training
texts, sorted by term within each shard of documents. Test windows are looked up from their rarest terms, by counts
over the whole index: the postings of the two rarest, shifted by their offsets in the window, must agree on a start;
the documents that survive have their whole term sequence compared at those starts, which makes matches exact.

Defined cases: a null or word-less text has no words and no hits; null and word-less items have no windows; repeated
rows are documents of their own; rows with a null doc_id keep it; empty tables give no rows, or no hits. An item of
fewer words than a window is one window. Items with equal ids count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import ascii_lower, broadcast_if_small, persisted, scratch

WINDOW_WORDS = 10
#: Tables of test terms or windows up to so many rows are broadcast (some 100 bytes a row); larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000
BROADCAST_DOCUMENTS = 1_000_000
_BREAKS = "".join(map(chr, (*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80))))
_END = "\x00"  # never part of a word; its posting tells a document's number of words


def words(text: Column) -> Column:
    """Words of A-Z lower-cased text; an empty array for null."""
    plain = F.btrim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(_BREAKS))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))


def test_windows(items: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """window_id, words, n, item_ids: each different window once."""
    w = F.col("words")
    cut = F.when(F.size(w) <= size, F.array(w)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0))), lambda i: F.slice(w, i + 1, size)))
    some = items.select(F.col("item_id"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    each = some.select("item_id", F.explode(F.array_distinct(cut)).alias("words"))
    return each.groupBy("words").agg(F.collect_set("item_id").alias("item_ids")).select(F.monotonically_increasing_id().alias("window_id"), "words", F.size("words").alias("n"), "item_ids")


def vocabulary(windows: DataFrame) -> DataFrame:
    return windows.select(F.explode("words").alias("term")).distinct().select("term", F.monotonically_increasing_id().alias("term_id"))


def build_index(documents: DataFrame, terms: DataFrame | None = None, row: str | None = None) -> DataFrame:
    """Postings (row, doc_id, term_id, pos), stored sorted by term in each shard; term_id -1 has the number of words.

    terms (term, term_id) restricts the index to the terms that will ever be asked for; without it every term is
    stored and numbered by its hash. row: a column of documents that numbers its rows; they are numbered here without it.
    """
    numbered = documents.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.concat(words(F.col("text")), F.array(F.lit(_END))).alias("words"))
    each = numbered.select("row", "doc_id", F.posexplode("words").alias("pos", "term"))
    if terms is None:
        found = each.select("row", "doc_id", F.when(F.col("term") == _END, F.lit(-1)).otherwise(F.shiftrightunsigned(F.xxhash64("term"), 1)).alias("term_id"), "pos")
    else:
        wanted = terms.unionByName(terms.sparkSession.createDataFrame([(_END, -1)], "term string, term_id long"))
        found = each.join(broadcast_if_small(wanted, terms.count(), BROADCAST_ROWS), "term").select("row", "doc_id", "term_id", "pos")
    return persisted(found.sortWithinPartitions("term_id"), "postings")


def _window_terms(windows: DataFrame, terms: DataFrame, index: DataFrame) -> DataFrame:
    """window_id, n, term_id, offset, rank: 1 for the window's rarest term in the whole index (ties: smaller id, then offset)."""
    counts = index.where("term_id >= 0").groupBy("term_id").agg(F.count("*").alias("df"))
    each = windows.select("window_id", "n", F.posexplode("words").alias("offset", "term")).join(terms, "term").join(counts, "term_id", "left")
    order = Window.partitionBy("window_id").orderBy(F.coalesce("df", F.lit(0)), "term_id", "offset")
    return each.select("window_id", "n", "term_id", "offset", F.row_number().over(order).alias("rank"))


def phrase_matches(index: DataFrame, windows: DataFrame, terms: DataFrame) -> DataFrame:
    """(row, window_id, start, n) of every occurrence of a window."""
    ranked = persisted(_window_terms(windows, terms, index), "ranked")
    n_windows = windows.count()
    starts = lambda rank: index.where("term_id >= 0").join(broadcast_if_small(ranked.where(F.col("rank") == rank), n_windows, BROADCAST_ROWS), "term_id").select("row", "window_id", "n", (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0")
    both = starts(1).where("n > 1").join(starts(2).select("row", "window_id", "start"), ["row", "window_id", "start"])
    likely = persisted(both.unionByName(starts(1).where("n = 1")), "likely")
    rows = likely.select("row").distinct()
    near = index.where("term_id >= 0").join(broadcast_if_small(rows, rows.count(), BROADCAST_DOCUMENTS), "row", "left_semi")
    order = Window.partitionBy("row").orderBy("pos")
    longest = windows.agg(F.max("n")).first()[0] or 1
    ahead = lambda c: F.array(*(F.lead(c, k).over(order) if k else F.col(c) for k in range(longest)))
    followed = near.select("row", F.col("pos").alias("start"), ahead("term_id").alias("next"), ahead("pos").alias("places"))
    wanted = ranked.groupBy("window_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("offset", "term_id"))), lambda x: x["term_id"]).alias("want"))
    checked = likely.join(broadcast_if_small(wanted, n_windows, BROADCAST_ROWS), "window_id").join(followed, ["row", "start"])
    exact = (F.slice("next", 1, F.col("n")) == F.col("want")) & (F.element_at("places", F.col("n")) == F.col("start") + F.col("n") - 1)
    return checked.where(exact).select("row", "window_id", "start", "n")


def proximity_matches(index: DataFrame, windows: DataFrame, terms: DataFrame, slack: int = 5) -> DataFrame:
    """(row, window_id, near): places whose surroundings hold every term of the window within its length plus slack.

    The rarest term's postings are the candidates; of the window's other terms each needs a posting whose shifted
    place lies within slack of the candidate's. Candidates are matched by blocks of slack + 1 places, so that the
    join stays an equality join.
    """
    ranked = persisted(_window_terms(windows, terms, index), "ranked")
    shifted = index.where("term_id >= 0").join(broadcast_if_small(ranked, windows.count() * WINDOW_WORDS, BROADCAST_ROWS), "term_id").select("row", "window_id", "n", "rank", (F.col("pos") - F.col("offset")).alias("at"))
    width = slack + 1
    first = shifted.where("rank = 1").withColumn("block", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("at") / width) + d)))
    rest = shifted.where("rank > 1").select("row", "window_id", F.col("rank").alias("other"), F.col("at").alias("there"), F.floor(F.col("at") / width).alias("block"))
    near = first.join(rest, ["row", "window_id", "block"]).where(F.abs(F.col("there") - F.col("at")) <= slack)
    found = near.groupBy("row", "window_id", "n", "at").agg(F.countDistinct("other").alias("others")).where("others = n - 1")
    alone = shifted.where("n = 1").select("row", "window_id", F.col("at").alias("near"))
    return found.select("row", "window_id", F.col("at").alias("near")).unionByName(alone)


def contamination(documents: DataFrame, items: DataFrame, size: int = WINDOW_WORDS, row: str | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document; row as well, if documents have such
    a column that numbers them."""
    with scratch():
        windows = persisted(test_windows(items, size), "windows")
        terms = persisted(vocabulary(windows), "terms")
        index = build_index(documents, terms, row)
        found = phrase_matches(index, windows, terms)
        named = found.join(broadcast_if_small(windows.select("window_id", "item_ids"), windows.count(), BROADCAST_ROWS), "window_id")
        # words covered by the union of the intervals, walked in order
        spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end"))))
        covered = F.aggregate(
            spans, F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("to")),
            lambda a, x: F.struct((a["sum"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"].cast("long"), a["to"]))).cast("long").alias("sum"), F.greatest(a["to"], x["end"].cast("long")).alias("to")),
            lambda a: a["sum"],
        )
        hits = named.groupBy("row").agg(covered.alias("n_hit"), F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_set("item_ids")), lambda x: x.cast("string")))).alias("items"))
        every = index.where("term_id = -1").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
        none = F.array().cast("array<string>")
        result = every.join(hits, "row", "left").select(
            *(["row"] if row else []), "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
            F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
        return persisted(result, "contamination", keep=True)


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, CASE WHEN len(w) <= 10 THEN w ELSE w[k:k + 9] END AS win FROM i, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k) WHERE len(w) > 0),
n AS (SELECT DISTINCT len(win) AS n FROM v),
p AS (SELECT row, k AS start, n, w[k:k + n - 1] AS win FROM (SELECT row, w, unnest(range(1, len(w) + 1)) AS k FROM d) CROSS JOIN n WHERE k + n - 1 <= len(w)),
m AS (SELECT row, start, n, item_id FROM p JOIN v USING (win)),
c AS (SELECT row, count(DISTINCT pos) AS n_hit FROM (SELECT row, unnest(range(start, start + n)) AS pos FROM m) GROUP BY row),
t AS (SELECT row, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT row, item_id::VARCHAR AS x FROM m) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (row) LEFT JOIN t USING (row)
"""
