"""Registered queries: each operator over whole driver tables, with SQL that states the same independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import globs
from factloom.functions import scalars as S
from factloom.operators import context, hierarchy, inventory, lookup, match, study
from factloom.plans import bridge as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WITH_FACTS = f"WITH {B.SYMBOLS_SQL}, {B.USES_SQL} "


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT source || '/' || lang || '/' || doc_id AS path, CASE WHEN strlen(text) > 20000 THEN 'size' WHEN instr(text, chr(0)) > 0 THEN 'binary' ELSE 'ok' END AS status, 'sha256:' || sha256(text) AS content_hash FROM documents")
def s04_classified_sources(spark, d):
    t = B.table(spark, d, "documents")
    content = F.col("text").cast("binary")
    return t.select(F.concat("source", F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id")).alias("path"), inventory.status(F.octet_length("text"), content, 20000).alias("status"), S.content_hash(content).alias("content_hash"))


@query("SELECT page_id, CASE WHEN url LIKE '%.php' THEN 'php' WHEN url LIKE '%.ts' OR url LIKE '%.tsx' THEN 'typescript' END AS language FROM (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '.php' WHEN 1 THEN '.ts' WHEN 2 THEN '.d.tsx' ELSE '.js' END AS url FROM pages)")
def s09_languages(spark, d):
    t = B.table(spark, d, "pages")
    path = F.concat("url", F.element_at(F.array(*map(F.lit, (".php", ".ts", ".d.tsx", ".js"))), (F.col("page_id") % 4 + 1).cast("int")))
    return t.select("page_id", S.language_of(path).alias("language"))


@query(WITH_FACTS + "SELECT id, file, kind, start_byte FROM sy WHERE lookup_name = (SELECT min(lookup_name) FROM sy)")
def s12_symbols_by_lookup_name(spark, d):
    s = B.symbols(spark, d)
    return s.join(s.agg(F.min("lookup_name").alias("lookup_name")), "lookup_name", "left_semi").select("id", "file", "kind", "start_byte")


@query("SELECT event_type, count(*) AS n, count(k) AS n_valid, sum(k) AS total FROM (SELECT event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events) GROUP BY event_type")
def s20_json_lines(spark, d):
    t = B.table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return t.groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("n_valid"), F.sum("k").alias("total"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE regexp_matches(o_orderpriority, '^[A-Za-z0-9 -]+$')")
def s22_token_columns(spark, d):
    return B.table(spark, d, "orders").where(F.col("o_orderpriority").rlike("^[A-Za-z0-9 -]+$")).select("o_orderkey", "o_orderpriority")


@query("SELECT page_id, n AS line, length(string_split(html, '>')[n]) AS width FROM (SELECT page_id, html, unnest(range(1, len(string_split(html, '>')) + 1)) AS n FROM pages)")
def x32_all_line_starts(spark, d):
    parts = B.table(spark, d, "pages").select("page_id", F.posexplode(F.split("html", ">")).alias("pos", "part"))
    return parts.select("page_id", (F.col("pos") + 1).cast("long").alias("line"), F.length("part").cast("long").alias("width"))


@query("SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS line FROM documents")
def x32_line_of_end(spark, d):
    return B.table(spark, d, "documents").select("doc_id", S.line_of(F.col("text").cast("binary"), F.octet_length("text")).cast("long").alias("line"))


@query(f"WITH {B.SYMBOLS_SQL} SELECT id, CASE WHEN n > 1 THEN k END AS ordinal FROM (SELECT id, count(*) OVER (PARTITION BY file, qualified_name) AS n, row_number() OVER (PARTITION BY file, qualified_name ORDER BY start_byte, end_byte, kind, id) AS k FROM sy)")
def x34_ordinals(spark, d):
    return lookup.with_ordinals(B.symbols(spark, d), ["id"]).select("id", "ordinal")


@query("SELECT c_custkey, replace(replace(n, '%', '%25'), '#', '%23') || '#' || replace(replace(s, '%', '%25'), '#', '%23') || CASE WHEN c_custkey % 2 = 0 THEN '#' || (c_custkey + 1) ELSE '' END AS id, n AS file, s AS qualified_name, CASE WHEN c_custkey % 2 = 0 THEN c_custkey + 1 END AS ordinal FROM (SELECT c_custkey, replace(c_name, '0', '#') AS n, c_mktsegment || '%' AS s FROM customer)")
def x35_ids(spark, d):
    c = B.table(spark, d, "customer")
    made = c.select("c_custkey", S.canonical_id(F.replace("c_name", F.lit("0"), F.lit("#")), F.concat("c_mktsegment", F.lit("%")), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey") + 1)).alias("id"))
    p = S.parsed_id(F.col("id"))
    return made.select("c_custkey", "id", p["file"].alias("file"), p["qualified_name"].alias("qualified_name"), p["ordinal"].cast("long").alias("ordinal"))


@query("SELECT p_partkey, translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lookup_name, regexp_replace(p_type, '\\s+', ' ', 'g') AS collapsed FROM part")
def x06_lookup_names(spark, d):
    return B.table(spark, d, "part").select("p_partkey", S.ascii_fold(F.col("p_name")).alias("lookup_name"), S.collapsed_whitespace(F.col("p_type")).alias("collapsed"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(n, '(::|->|\\\\|/|\\.)+', '.', 'g'), '^\\.', '') AS normalized, list_last(string_split(regexp_replace(n, '(::|->|\\\\|/|\\.)+', '.', 'g'), '.')) AS last FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '\\' WHEN 1 THEN '.' ELSE '' END || replace(p_name, ' ', CASE p_partkey % 4 WHEN 0 THEN '::' WHEN 1 THEN '->' WHEN 2 THEN '/' ELSE '\\' END) AS n FROM part)")
def p03_separators(spark, d):
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 3 == 0, "\\").when(k % 3 == 1, ".").otherwise(""), F.replace("p_name", F.lit(" "), F.when(k % 4 == 0, "::").when(k % 4 == 1, "->").when(k % 4 == 2, "/").otherwise("\\")))
    return B.table(spark, d, "part").select("p_partkey", S.normalized_separators(name).alias("normalized"), S.last_component(name).alias("last"))


@query(WITH_FACTS + "SELECT file, count(*) AS n_suffix FROM sy WHERE qualified_name = 'Brand#11' OR ends_with(qualified_name, '.' || (SELECT min(name) FROM sy)) GROUP BY file")
def p04_suffix_matches(spark, d):
    s = B.symbols(spark, d)
    least = s.agg(F.min("name").alias("least"))
    found = s.join(F.broadcast(least), S.ends_with_component(F.col("qualified_name"), F.col("least")))  # one row
    return found.groupBy("file").agg(F.count("*").alias("n_suffix"))


@query(WITH_FACTS + "SELECT coalesce(resolution, 'name_match') AS resolution, ref_kind, count(*) AS n FROM us WHERE coalesce(resolution, 'name_match') <> 'name_match' AND ref_kind IN ('call', 'read') GROUP BY ALL")
def p06_minimum_tier(spark, d):
    _, u, b = B.facts(spark, d)
    linked = match.bound_uses(u, b).withColumn("resolution", F.coalesce("resolution", F.lit("name_match")))
    return linked.where(S.at_least(F.col("resolution"), "scoped") & F.col("ref_kind").isin("call", "read")).groupBy("resolution", "ref_kind").agg(F.count("*").alias("n"))


@query("SELECT path, regexp_matches(path, '(^|/)src1[0-9]?(/|$)') OR (regexp_matches(path, '^[^/]*/fr/[^/]*1(/|$)')) AS is_test FROM (SELECT source || '/' || lang || '/' || doc_id AS path FROM documents)")
def p08_test_globs(spark, d):
    t = B.table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id")).alias("path"))
    return t.select("path", globs.matches_any(F.col("path"), ["src1", "src1[0-9]", "*/fr/*1"]).alias("is_test"))


@query(WITH_FACTS + "SELECT kind, ref_kind, receiver IS NOT NULL AS has_receiver, CASE kind WHEN 'method' THEN ref_kind IN ('call', 'read') AND receiver IS NOT NULL WHEN 'function' THEN ref_kind = 'call' AND receiver IS NULL ELSE ref_kind = 'type' END AS compatible, count(*) AS n FROM us JOIN sy ON us.target_id = sy.id GROUP BY ALL")
def p09_compatible_forms(spark, d):
    s, u, b = B.facts(spark, d)
    j = match.bound_uses(u, b).join(s.select(F.col("id").alias("target_id"), "kind"), "target_id")
    has = F.col("receiver").isNotNull()
    return j.groupBy("kind", "ref_kind", has.alias("has_receiver"), match.form_compatible(F.col("kind"), F.col("ref_kind"), has).alias("compatible")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, (strlen(text) + 2) // 3 AS tokens FROM documents")
def p14_token_estimates(spark, d):
    return B.table(spark, d, "documents").select("doc_id", S.estimated_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, substring(hex(encode(text)), 21, 60) AS bytes FROM documents")
def p15_byte_slices(spark, d):
    return B.table(spark, d, "documents").select("doc_id", F.hex(S.span_bytes(F.col("text").cast("binary"), F.lit(10), F.lit(40))).alias("bytes"))


@query(WITH_FACTS + "SELECT use_id, file, ref_kind, target_id, resolution FROM us")
def j01_bound_uses(spark, d):
    _, u, b = B.facts(spark, d)
    return match.bound_uses(u, b).select("use_id", "file", "ref_kind", "target_id", "resolution")


@query(WITH_FACTS + """, bo AS (SELECT target_id AS id, count(*) FILTER (WHERE resolution = 'exact') AS n_exact, count(*) FILTER (WHERE resolution = 'scoped') AS n_scoped FROM us WHERE target_id IS NOT NULL GROUP BY 1),
na AS (SELECT lookup_name, count(*) AS n FROM us WHERE target_id IS NULL GROUP BY 1)
SELECT sy.id, coalesce(n_exact, 0) AS n_exact, coalesce(n_scoped, 0) AS n_scoped, coalesce(n, 0) AS n_name_match, coalesce(n_exact, 0) + coalesce(n_scoped, 0) + coalesce(n, 0) AS total FROM sy LEFT JOIN bo USING (id) LEFT JOIN na USING (lookup_name)""")
def j03_refs_by_target(spark, d):
    return match.reference_counts(*B.facts(spark, d))


@query(WITH_FACTS + """, m AS (SELECT sy.id, us.use_id, resolution FROM sy JOIN us ON us.target_id = sy.id WHERE ref_kind = 'call' UNION ALL SELECT sy.id, us.use_id, 'name_match' FROM sy JOIN us USING (lookup_name) WHERE ref_kind = 'call' AND us.target_id IS DISTINCT FROM sy.id)
SELECT sy.id AS target, count(*) FILTER (WHERE m.resolution = 'exact') AS n_exact, count(*) FILTER (WHERE m.resolution = 'scoped') AS n_scoped, count(*) FILTER (WHERE m.resolution = 'name_match') AS n_name_match, count(m.use_id) AS total FROM sy LEFT JOIN m USING (id) GROUP BY sy.id""")
def j03_all_candidates(spark, d):
    return match.candidate_counts(*B.facts(spark, d), ["call"])


@query(WITH_FACTS + "SELECT containing_symbol AS container, ref_kind, coalesce(resolution, 'name_match') AS resolution, count(*) AS n FROM us WHERE containing_symbol IN (SELECT id FROM sy) GROUP BY ALL")
def j04_contained_uses(spark, d):
    return match.contained_uses(*B.facts(spark, d)).groupBy("container", "ref_kind", "resolution").agg(F.count("*").alias("n"))


@query(WITH_FACTS + "SELECT file, lookup_name, kind, min(id) AS id FROM sy GROUP BY ALL HAVING count(DISTINCT id) = 1")
def j05_unique_names(spark, d):
    return match.unique_by(B.symbols(spark, d), ["file", "lookup_name", "kind"])


@query(WITH_FACTS + "SELECT parent_id, kind, lookup_name, min(id) AS id FROM sy WHERE parent_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT id) = 1")
def j06_unique_members(spark, d):
    return match.unique_by(B.symbols(spark, d).where("parent_id IS NOT NULL"), ["parent_id", "kind", "lookup_name"])


@query("""WITH l AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1) AS path, unnest(regexp_extract_all(html, 'href="([^"#?]+)"', 1)) AS href FROM pages),
st AS (SELECT page_id, list_filter(list_concat(string_split(path, '/')[1:len(string_split(path, '/')) - 1], string_split(CASE WHEN page_id % 3 = 0 THEN '.' ELSE '../..' END || '/' || href, '/')), lambda x: x <> '' AND x <> '.') AS steps FROM l)
SELECT page_id, target, count(*) AS n FROM (SELECT page_id, CASE WHEN list_bool_and(list_transform(range(1, len(steps) + 1), lambda k: 2 * len(list_filter(steps[1:k], lambda x: x = '..')) <= k)) THEN array_to_string(list_concat(steps[1:greatest(coalesce(list_position(steps, '..'), 1) - 1 - len(list_filter(steps, lambda x: x = '..')), 0)], list_filter(steps[coalesce(list_position(steps, '..'), 1):], lambda x: x <> '..')), '/') END AS target FROM st) GROUP BY ALL""")
def j13_joined_paths(spark, d):
    p = B.table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/]*/([^?#]*)", 1).alias("path"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"#?]+)"'), F.lit(1))).alias("href"))
    up = F.when(F.col("page_id") % 3 == 0, "./").otherwise("../../")
    return p.groupBy("page_id", S.joined_path(F.col("path"), F.concat(up, F.col("href"))).alias("target")).agg(F.count("*").alias("n"))


@query(WITH_FACTS + """, pl AS (SELECT DISTINCT file, start_line + 3 AS line FROM sy), inn AS (SELECT pl.file, pl.line, id, start_byte, end_byte FROM pl JOIN sy ON sy.file = pl.file AND pl.line BETWEEN start_line AND end_line)
SELECT file, line, id FROM inn a WHERE NOT EXISTS (SELECT 1 FROM inn b WHERE a.file = b.file AND a.line = b.line AND a.start_byte <= b.start_byte AND b.end_byte <= a.end_byte AND (a.start_byte < b.start_byte OR b.end_byte < a.end_byte))""")
def j19_innermost(spark, d):
    s = B.symbols(spark, d)
    return lookup.innermost(s, s.select("file", (F.col("start_line") + 3).alias("line")))


@query(WITH_FACTS + """, m AS (SELECT sy.id, kind, use_id, ref_kind, receiver, resolution AS r FROM sy JOIN us ON us.target_id = sy.id UNION ALL SELECT sy.id, kind, use_id, ref_kind, receiver, 'name_match' FROM sy JOIN us USING (lookup_name) WHERE us.target_id IS NULL),
f AS (SELECT id, r, use_id, CASE kind WHEN 'method' THEN ref_kind IN ('call', 'read') AND receiver IS NOT NULL WHEN 'function' THEN ref_kind = 'call' AND receiver IS NULL ELSE ref_kind = 'type' END AS fits FROM m)
SELECT id AS target, count(*) FILTER (WHERE r = 'name_match' AND NOT fits) AS by_form, count(*) FILTER (WHERE r = 'name_match' AND fits AND use_id % 5 = 0) AS by_receiver, count(*) FILTER (WHERE r <> 'name_match' OR (fits AND use_id % 5 <> 0)) AS kept FROM f GROUP BY id""")
def j20_all_exclusions(spark, d):
    return match.exclusion_counts_of_all(*B.facts(spark, d), F.col("use_id") % 5 == 0)


WITH_EDGES = f"WITH {B.SUPERTYPES_SQL} "


@query(WITH_EDGES + "SELECT child, relation, min(qname) AS qname, parent FROM ed GROUP BY child, relation, parent, CASE WHEN parent IS NULL THEN qname END")
def g01_direct_supertypes(spark, d):
    return hierarchy.direct_supertypes(B.supertypes(spark, d))


@query(f"WITH RECURSIVE {B.SUPERTYPES_SQL}, up AS (SELECT child AS id, parent AS ancestor, 1 AS depth FROM ed WHERE parent IS NOT NULL UNION ALL SELECT up.id, ed.parent, up.depth + 1 FROM up JOIN ed ON up.ancestor = ed.child WHERE ed.parent IS NOT NULL AND up.depth < 10) SELECT id, ancestor, min(depth) AS depth FROM up WHERE id <> ancestor GROUP BY ALL")
def g02_ancestors(spark, d):
    return hierarchy.ancestors(B.supertypes(spark, d))


@query(WITH_EDGES + "SELECT coalesce(bool_or(qname IS NULL), false) AS unknown_link FROM ed")
def g04_unknown_link(spark, d):
    return hierarchy.has_unknown_link(B.supertypes(spark, d))


@query(WITH_EDGES + """, c AS (SELECT 'supplier/' || s_suppkey AS id FROM supplier UNION ALL SELECT 'nation/' || n_nationkey FROM nation), e2 AS (SELECT DISTINCT child, parent FROM ed WHERE parent IS NOT NULL),
up AS (SELECT id, id AS member FROM c UNION SELECT c.id, e2.parent FROM c JOIN e2 ON e2.child = c.id UNION SELECT c.id, f.parent FROM c JOIN e2 ON e2.child = c.id JOIN e2 f ON f.child = e2.parent)
SELECT up.id, count(DISTINCT member) AS n_ids, count(DISTINCT translate(qname, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS n_names, coalesce(bool_or(ed.child IS NOT NULL AND ed.parent IS NULL), false) AS open FROM up LEFT JOIN ed ON ed.child = up.member GROUP BY up.id""")
def g05_upsets(spark, d):
    c = B.table(spark, d, "supplier").select(F.concat(F.lit("supplier/"), F.col("s_suppkey")).alias("id")).unionByName(B.table(spark, d, "nation").select(F.concat(F.lit("nation/"), F.col("n_nationkey")).alias("id")))
    return hierarchy.upsets(B.supertypes(spark, d), c).select("id", F.size("ids").cast("long").alias("n_ids"), F.size("names").cast("long").alias("n_names"), "open")


@query(WITH_EDGES + """, s AS (SELECT 'supplier/' || s_suppkey AS id, 'nation/' || s_nationkey AS n FROM supplier), x AS (SELECT s.id, s.n, e.parent AS r FROM s JOIN ed e ON e.child = s.n WHERE e.parent IS NOT NULL)
SELECT r AS target, (SELECT count(DISTINCT id) + count(DISTINCT n) + 1 FROM x y WHERE y.r = x.r) AS n_related FROM x GROUP BY r""")
def g06_related_classes(spark, d):
    c = B.table(spark, d, "supplier").select(F.concat(F.lit("supplier/"), F.col("s_suppkey")).alias("id"))
    ups = hierarchy.upsets(B.supertypes(spark, d), c)
    regions = B.table(spark, d, "region").select(F.concat(F.lit("region/"), F.col("r_regionkey")).alias("id"))
    return hierarchy.class_relation(ups, regions).select("target", F.size("related").cast("long").alias("n_related"))


_NEIGHBOURS = """, t AS (SELECT id AS target FROM sy), nb AS (
SELECT target, target_id AS id, CASE WHEN ref_kind = 'type' THEN 'type' ELSE 'callee' END AS reason, resolution FROM us JOIN t ON containing_symbol = target WHERE target_id IS NOT NULL AND target_id <> target
UNION ALL SELECT target, containing_symbol, 'caller', resolution FROM us JOIN t ON target_id = target WHERE containing_symbol <> target
UNION ALL SELECT target, parent_id, 'parent', 'exact' FROM sy JOIN t ON id = target WHERE parent_id IS NOT NULL AND parent_id <> target),
rk AS (SELECT nb.*, sy.file, start_byte, CASE reason WHEN 'type' THEN 1 WHEN 'callee' THEN 2 WHEN 'caller' THEN 4 ELSE 6 END AS p, CASE resolution WHEN 'exact' THEN 0 ELSE 1 END AS q FROM nb JOIN sy USING (id)),
be AS (SELECT * FROM rk QUALIFY row_number() OVER (PARTITION BY target, id ORDER BY p, q, file, start_byte) = 1)"""


@query(WITH_FACTS + _NEIGHBOURS + "SELECT target, id, reason, resolution, 1 AS depth, row_number() OVER (PARTITION BY target ORDER BY p, q, file, start_byte, id) AS rank FROM be QUALIFY rank <= 1000")
def g08_all_neighbours(spark, d):
    s, u, b = B.facts(spark, d)
    return context.traversal(s, u, b, s.select("id"), depth=1)


@query()
def g09_all_traversal(spark, d):
    return context.traversal_of_all(B.symbols(spark, d), B.linked(spark, d))


@query("SELECT (SELECT count(*) FROM part) AS n_symbols, (SELECT count(*) FROM orders) AS n_files")
def a01_counts(spark, d):
    a, b = B.table(spark, d, "part").agg(F.count("*").alias("n_symbols")), B.table(spark, d, "orders").agg(F.count("*").alias("n_files"))
    return a.crossJoin(F.broadcast(b))  # two rows of one count each


WITH_INVENTORY = f"WITH {B.INVENTORY_SQL} "


@query(WITH_INVENTORY + "SELECT count(*) AS seen, count(*) FILTER (WHERE parse_status = 'ok') AS indexed, 0::BIGINT AS binary, 0::BIGINT AS encoding, 0::BIGINT AS parse_error, 0::BIGINT AS resource_limit, count(*) FILTER (WHERE parse_status = 'size') AS size, count(*) FILTER (WHERE parse_status = 'unsupported') AS unsupported, count(*) = count(*) FILTER (WHERE parse_status = 'ok') AS complete FROM i0")
def a04_coverage(spark, d):
    return inventory.coverage(B.inventory(spark, d))


@query(WITH_INVENTORY + """SELECT count(*) FILTER (WHERE a.path IS NULL OR (b.path IS NOT NULL AND (a.content_hash, a.parse_status, a.language) IS DISTINCT FROM (b.content_hash, b.parse_status, b.language))) AS updated,
count(*) FILTER (WHERE (a.content_hash, a.parse_status, a.language) IS NOT DISTINCT FROM (b.content_hash, b.parse_status, b.language)) AS unchanged, count(*) FILTER (WHERE b.path IS NULL) AS deleted FROM i0 a FULL OUTER JOIN i1 b ON a.path = b.path""")
def a05_refresh_counts(spark, d):
    return inventory.difference_counts(inventory.difference(B.inventory(spark, d), B.inventory(spark, d, later=True)))


@query(WITH_INVENTORY + "SELECT coalesce(b.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'new' WHEN b.path IS NULL THEN 'deleted' WHEN (a.content_hash, a.parse_status, a.language) IS NOT DISTINCT FROM (b.content_hash, b.parse_status, b.language) THEN 'same' ELSE 'changed' END AS change FROM i0 a FULL OUTER JOIN i1 b ON a.path = b.path")
def rf03_inventory_difference(spark, d):
    return inventory.difference(B.inventory(spark, d), B.inventory(spark, d, later=True))


@query(WITH_INVENTORY + "SELECT path FROM i0 WHERE path NOT IN (SELECT path FROM i1)")
def u03_deleted_paths(spark, d):
    return inventory.difference(B.inventory(spark, d), B.inventory(spark, d, later=True)).where("change = 'deleted'").select("path")


@query(WITH_INVENTORY + "SELECT path AS file, parse_status AS code, size AS start_byte, (SELECT count(*) FROM i0 WHERE parse_status <> 'ok') AS total FROM i0 WHERE parse_status <> 'ok' ORDER BY path, parse_status, size LIMIT 50")
def a08_diagnostics(spark, d):
    i = B.inventory(spark, d).where("parse_status <> 'ok'").select(F.col("path").alias("file"), F.col("parse_status").alias("code"), F.col("size").alias("start_byte"), F.lit("").alias("detail"))
    return inventory.first_diagnostics(i).drop("detail")


@query()
def a09_snapshot_digest(spark, d):
    return inventory.snapshot_digest(B.inventory(spark, d))


WITH_ATTEMPTS = f"WITH {B.ATTEMPTS_SQL} "


@query(WITH_ATTEMPTS + "SELECT metric, task, arm, round(avg(value), 6) AS task_mean, count(value) AS n, count(*) FILTER (WHERE value IS NULL) AS missing FROM (SELECT task, arm, 'tokens' AS metric, tokens AS value FROM att UNION ALL SELECT task, arm, 'passed', passed FROM att) GROUP BY ALL")
def a10_task_means(spark, d):
    return study.task_means(B.attempts(spark, d), ["tokens", "passed"]).withColumn("task_mean", F.round("task_mean", 6))


_ARMS = ", tm AS (SELECT task, arm, avg(tokens) AS m FROM att GROUP BY ALL HAVING count(tokens) > 0), am AS (SELECT arm, avg(m) AS mean, count(*) AS n_tasks, avg(m) FILTER (WHERE task IN (SELECT task FROM tm GROUP BY task HAVING count(*) = 2)) AS paired_mean, count(*) FILTER (WHERE task IN (SELECT task FROM tm GROUP BY task HAVING count(*) = 2)) AS n_paired FROM tm GROUP BY arm) "


@query(WITH_ATTEMPTS + _ARMS + "SELECT 'tokens' AS metric, arm, round(mean, 4) AS mean, n_tasks, round(paired_mean, 4) AS paired_mean, n_paired FROM am")
def a11_arm_means(spark, d):
    out = study.arm_means(study.task_means(B.attempts(spark, d), ["tokens"]), ["b", "c"])
    return out.withColumns({"mean": F.round("mean", 4), "paired_mean": F.round("paired_mean", 4)})


@query(WITH_ATTEMPTS + _ARMS + "SELECT 'tokens' AS metric, round(c.paired_mean / b.paired_mean, 6) AS ratio, round(c.paired_mean - b.paired_mean, 4) AS difference, NULL::VARCHAR AS undefined FROM am b, am c WHERE b.arm = 'b' AND c.arm = 'c'")
def a12_comparisons(spark, d):
    out = study.comparisons(study.arm_means(study.task_means(B.attempts(spark, d), ["tokens"]), ["b", "c"]), "b", "c")
    return out.withColumns({"ratio": F.round("ratio", 6), "difference": F.round("difference", 4)})


_INCLUSION = ", fl AS (SELECT *, coalesce(bool_or(attempt = 1 AND infra) OVER w, false) AS f1, coalesce(bool_or(attempt = 2 AND infra) OVER w, false) AS f2, bool_or(attempt = 2) OVER w AS h2 FROM att WINDOW w AS (PARTITION BY task, trial)), inc AS (SELECT *, CASE WHEN NOT f1 THEN CASE WHEN attempt = 1 THEN 'included' ELSE 'excluded' END WHEN h2 AND NOT f2 THEN CASE WHEN attempt = 2 THEN 'included' ELSE 'excluded' END ELSE 'excluded' END AS inclusion FROM fl) "


@query(WITH_ATTEMPTS + _INCLUSION + "SELECT event_id, inclusion FROM inc")
def w05_inclusion(spark, d):
    return study.inclusion(B.attempts(spark, d)).select("event_id", "inclusion")


@query(WITH_ATTEMPTS + _INCLUSION + "SELECT arm, count(*) AS scheduled, count(inclusion) AS run, count(*) FILTER (WHERE inclusion = 'included') AS included, count(*) FILTER (WHERE inclusion = 'excluded') AS excluded, count(*) FILTER (WHERE passed = 0) AS failed FROM (SELECT k::VARCHAR AS task, t AS trial, arm FROM range(45) a(k), range(20) b(t), (VALUES ('b'), ('c')) c(arm)) LEFT JOIN inc USING (task, trial, arm) GROUP BY arm")
def a13_accounting(spark, d):
    grid = spark.range(45 * 20 * 2).select(F.floor(F.col("id") / 40).cast("string").alias("task"), (F.col("id") % 20).alias("trial"), F.when(F.floor(F.col("id") / 20) % 2 == 0, "b").otherwise("c").alias("arm"))
    return study.accounting(grid, study.inclusion(B.attempts(spark, d)).select("task", "trial", "arm", "inclusion", "passed"))


@query("SELECT event_type, 'k' AS key, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY event_type")
def a14_merged_counts(spark, d):
    return study.merged_counts(B.table(spark, d, "events"), ["event_type"], "props")


@query(WITH_ATTEMPTS + "SELECT task, round(avg(b), 4) AS b, round(avg(c), 4) AS c, count(*) AS n FROM (SELECT task, trial, max(tokens) FILTER (WHERE arm = 'b') AS b, max(tokens) FILTER (WHERE arm = 'c') AS c FROM (SELECT task, trial // 2 AS trial, arm, tokens FROM att) GROUP BY ALL) WHERE b IS NOT NULL AND c IS NOT NULL GROUP BY task")
def a15_task_values(spark, d):
    a = B.attempts(spark, d).withColumn("trial", F.floor(F.col("trial") / 2))
    return study.task_values(study.paired_blocks(a, "b", "c", "tokens"), "b", "c").select("task", F.round("b", 4).alias("b"), F.round("c", 4).alias("c"), "n")


@query()
def a17_bootstrap(spark, d):
    a = B.attempts(spark, d).withColumn("trial", F.floor(F.col("trial") / 2))
    values = study.task_values(study.paired_blocks(a, "b", "c", "tokens"), "b", "c")
    tasks = [(r["task"], str(int(r["task"]) % 2)) for r in values.select("task").orderBy("task").collect()]  # tasks of a study
    draws = spark.createDataFrame(study.bootstrap_draws(tasks, 400, 11) or [(0, "")], "replicate long, task string")
    ratios = study.bootstrap(values, draws, "b", "c")
    return study.kth(ratios, "ratio", study.bound_index(400, 0.05)).select(F.round("ratio", 6).alias("upper_bound"))


@query("SELECT round(quantile_cont(o_totalprice, 0.5), 4) AS median, min(o_totalprice) AS min, max(o_totalprice) AS max, count(*) AS n, o_orderstatus FROM orders GROUP BY o_orderstatus")
def a21_timing_summary(spark, d):
    return study.timing_summary(B.table(spark, d, "orders"), "o_orderstatus", "o_totalprice").withColumn("median", F.round("median", 4))


@query(WITH_FACTS + "SELECT ref_kind, resolution, count(*) AS n FROM us WHERE resolution IS NOT NULL GROUP BY ALL")
def a22_bindings_by_tier(spark, d):
    _, u, b = B.facts(spark, d)
    return match.bound_uses(u, b).where("resolution IS NOT NULL").groupBy("ref_kind", "resolution").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS a, list_distinct(list(o_orderstatus || '-' || o_orderpriority)) AS s FROM orders GROUP BY o_custkey), h AS (SELECT o_custkey, len(a) AS na, len(list_filter(a, lambda x: x <> '1-URGENT')) AS hits FROM g)
SELECT o_custkey, hits, CASE WHEN na > 0 THEN hits / na END AS precision, 2 * hits * 5 >= 4 * (na + hits) AS passed FROM h""")
def a20_set_scores(spark, d):
    g = B.table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("answer"), F.collect_set(F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority"))).alias("gold"))
    return study.set_scores(g, numerator=4, denominator=5).select("o_custkey", "hits", "precision", "passed")


@query(WITH_FACTS + "SELECT use_id FROM (SELECT use_id, row_number() OVER (PARTITION BY containing_symbol, start_byte, end_byte, ref_kind ORDER BY use_id) AS n FROM us) WHERE n = 1")
def w03_first_per_site(spark, d):
    _, u, _ = B.facts(spark, d)
    return match.first_per_site(u.withColumn("file", F.col("containing_symbol"))).select("use_id")


@query("SELECT conv_id AS transcript, count(*) AS n_calls, count(*) FILTER (WHERE a = 'user' OR b = 'user') AS n_fallbacks FROM (SELECT conv_id, role, lead(role, 1) OVER w AS a, lead(role, 2) OVER w AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant' GROUP BY conv_id")
def w04_fallbacks(spark, d):
    t = B.table(spark, d, "conversations").select(F.col("conv_id").alias("transcript"), F.col("turn").alias("index"), F.col("role").alias("tool"))
    return study.fallbacks(t, "assistant", ["user"])


@query("SELECT o_orderkey, round(spent, 2) AS spent, spent > 500000 AS over FROM (SELECT o_orderkey, sum(floor(o_totalprice)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS spent FROM orders)")
def w07_spending(spark, d):
    e = B.table(spark, d, "orders").select(F.col("o_custkey").alias("study"), F.col("o_orderkey").alias("index"), F.floor("o_totalprice").cast("double").alias("cost"))
    return study.spending(e, 500000).select(F.col("index").alias("o_orderkey"), F.round("spent", 2).alias("spent"), "over")


@query(WITH_FACTS + "SELECT id, name, qualified_name FROM sy ORDER BY file, start_byte, id")
def t02_all_symbols_in_order(spark, d):
    return B.symbols(spark, d).orderBy(*lookup.symbol_order()).select("id", "name", "qualified_name")


@query(WITH_FACTS + "SELECT containing_symbol, use_id, total, CASE WHEN total > 15 THEN 15 END AS next_offset FROM (SELECT containing_symbol, use_id, count(*) OVER (PARTITION BY containing_symbol) AS total, row_number() OVER (PARTITION BY containing_symbol ORDER BY file, start_byte, end_byte, ref_kind, coalesce(target_id, '')) - 1 AS k FROM us) WHERE k >= 5 AND k < 15")
def t03_pages(spark, d):
    _, u, b = B.facts(spark, d)
    m = match.bound_uses(u, b).withColumnRenamed("target_id", "resolved_target")
    return match.pages(m, "containing_symbol", match.reference_order(), 5, 10).select("containing_symbol", "use_id", "total", "next_offset")


@query(WITH_FACTS + "SELECT id, qualified_name, levenshtein(lower(name), 'almond blu') AS distance FROM (SELECT * FROM sy QUALIFY row_number() OVER (PARTITION BY qualified_name ORDER BY file, start_byte, id) = 1) ORDER BY distance, encode(qualified_name) LIMIT 5")
def t05_suggestions(spark, d):
    return lookup.suggestions(B.symbols(spark, d), "Almond Blu").select("id", "qualified_name", "distance")


@query(WITH_FACTS + "SELECT qualified_name, distance FROM (SELECT qualified_name, id, start_byte, greatest(start_line - 500, 500 - end_line, 0) AS distance FROM sy WHERE file = 'Brand#11' QUALIFY row_number() OVER (PARTITION BY qualified_name ORDER BY distance, start_byte, id) = 1) ORDER BY distance, start_byte, id LIMIT 5")
def t06_nearest_to_line(spark, d):
    return lookup.nearest_to_line(B.symbols(spark, d), "Brand#11", 500)


@query("""WITH RECURSIVE i AS (SELECT p_brand AS b, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k, (p_size * 13)::BIGINT AS full_, (p_size)::BIGINT AS short_ FROM part),
f AS (SELECT DISTINCT b, 0::BIGINT AS k, 0::BIGINT AS used, 0::BIGINT AS taken, 0::BIGINT AS omitted, 0::BIGINT AS n_signatures FROM i
UNION ALL SELECT f.b, f.k + 1, CASE WHEN used + full_ <= 3000 THEN used + full_ WHEN used + short_ <= 3000 THEN used + short_ ELSE used END, taken + CASE WHEN used + full_ <= 3000 OR used + short_ <= 3000 THEN 1 ELSE 0 END,
omitted + CASE WHEN used + full_ <= 3000 OR used + short_ <= 3000 THEN 0 ELSE 1 END, n_signatures + CASE WHEN used + full_ > 3000 AND used + short_ <= 3000 THEN 1 ELSE 0 END FROM f JOIN i ON i.b = f.b AND i.k = f.k + 1)
SELECT b AS p_brand, taken, used, omitted, n_signatures FROM f QUALIFY row_number() OVER (PARTITION BY b ORDER BY k DESC) = 1""")
def t08_greedy_fit(spark, d):
    p = B.table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("rank"), (F.col("p_size") * 13).alias("full"), F.col("p_size").alias("short"))
    return context.greedy_fit(p, "p_brand", 3000)


@query()
def t09_overlap_fit(spark, d):
    s = B.symbols(spark, d)
    items = s.select(F.col("file").alias("target"), "id", F.expr("CAST(substr(id, 6) AS LONG)").alias("rank"), "file", "start_byte", "end_byte", F.floor((F.col("end_byte") - F.col("start_byte") + 2) / 3).alias("full"), F.lit(9).cast("long").alias("short"))
    return context.overlap_fit(items, 4000)


@query("SELECT conv_id, turn, regexp_replace(regexp_replace(replace(trim('./.\\' || replace(text, ' ', '\\') || ' '), '\\', '/'), '/+', '/', 'g'), '^(\\./)+', '') AS path FROM conversations")
def b02_normalized_paths(spark, d):
    path = F.concat(F.lit("./.\\"), F.replace("text", F.lit(" "), F.lit("\\")), F.lit(" "))
    return B.table(spark, d, "conversations").select("conv_id", "turn", study.normalized_path(path).alias("path"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(text, '^[A-D]') THEN 'early' WHEN regexp_matches(text, '[0-9]') THEN 'digits' END AS class FROM conversations")
def b04_error_classes(spark, d):
    return B.table(spark, d, "conversations").select("conv_id", "turn", study.classified(F.col("text"), [("early", "^[A-D]"), ("digits", "[0-9]")]).alias("class"))


@query("SELECT rule, 0::BIGINT AS violations FROM (VALUES ('bindings_key'), ('binding_target'), ('binding_tier'), ('binding_use'), ('files_key'), ('symbol_file'), ('symbol_span'), ('symbols_key'), ('uses_key'), ('uses_site')) t(rule)")
def o15_integrity(spark, d):
    s, u, b = B.facts(spark, d)
    return inventory.violations({"files": s.select(F.col("file").alias("path")).distinct(), "symbols": s, "uses": u, "bindings": b})


@query(WITH_FACTS + "SELECT id, kind, name FROM sy WHERE id = 'part/17'")
def s11_symbol_by_id(spark, d):
    return B.symbols(spark, d).where("id = 'part/17'").select("id", "kind", "name")


@query(WITH_FACTS + "SELECT use_id, ref_kind, start_byte FROM us WHERE file = 'order/32'")
def s14_uses_by_file(spark, d):
    return B.uses(spark, d).where("file = 'order/32'").select("use_id", "ref_kind", "start_byte")


@query(WITH_FACTS + """, sp AS (SELECT DISTINCT file, start_byte + 15 AS start_byte, start_byte + 20 AS end_byte FROM sy)
SELECT sp.file, sp.start_byte, sp.end_byte, arg_min(sy.id, (sy.end_byte - sy.start_byte, -sy.start_byte, sy.id)) AS id FROM sp LEFT JOIN sy ON sy.file = sp.file AND sy.start_byte <= sp.start_byte AND sp.end_byte <= sy.end_byte GROUP BY ALL""")
def x18_containers(spark, d):
    s = B.symbols(spark, d)
    return lookup.containers(s, s.select("file", (F.col("start_byte") + 15).alias("start_byte"), (F.col("start_byte") + 20).alias("end_byte")))


@query(WITH_FACTS + "SELECT id FROM (SELECT id, kind = 'class' AS b, bool_or(kind = 'class') OVER (PARTITION BY file, name) AS any_b, row_number() OVER (PARTITION BY file, name ORDER BY start_byte, id) AS n FROM sy) WHERE b OR (NOT any_b AND n = 1)")
def x25_overloads(spark, d):
    return lookup.folded_overloads(B.symbols(spark, d).withColumn("has_body", F.col("kind") == "class"), ["file", "name"]).select("id")


@query(f"""WITH RECURSIVE {B.SYMBOLS_SQL}, ch AS (SELECT id, id AS at, 0 AS depth FROM sy UNION ALL SELECT ch.id, sy.parent_id, depth + 1 FROM ch JOIN sy ON sy.id = ch.at WHERE sy.parent_id IS NOT NULL AND depth < 10)
SELECT ch.id, f.kind AS name, arg_min(f.name, depth) AS value FROM ch JOIN sy f ON f.id = ch.at WHERE f.kind <> 'class' GROUP BY ALL""")
def j07_scope_chains(spark, d):
    s = B.symbols(spark, d)
    return hierarchy.nearest_scope(s.select("id", "parent_id"), s.where("kind <> 'class'").select(F.col("id").alias("scope"), F.col("kind").alias("name"), F.col("name").alias("value")))


@query(WITH_EDGES + "SELECT s_suppkey, r_regionkey, s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = r_regionkey) AND s_nationkey <> 24 AS unrelated FROM supplier CROSS JOIN region WHERE s_suppkey % 5 = r_regionkey")
def g07_unrelated_receivers(spark, d):
    sup = B.table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("supplier/"), F.col("s_suppkey")).alias("id"))
    ups = hierarchy.upsets(B.supertypes(spark, d), sup.select("id"))
    regions = B.table(spark, d, "region").select("r_regionkey", F.concat(F.lit("region/"), F.col("r_regionkey")).alias("id"))
    related = hierarchy.class_relation(ups, regions.select("id")).join(regions.withColumnRenamed("id", "target"), "target", "right")
    none = F.array().cast("array<string>")
    j = sup.join(ups.select("id", "open"), "id").join(related, F.col("s_suppkey") % 5 == F.col("r_regionkey"))
    return j.select("s_suppkey", "r_regionkey", hierarchy.unrelated(F.col("id"), F.coalesce("related", none), F.col("open")).alias("unrelated"))


@query(WITH_FACTS + "SELECT DISTINCT a.containing_symbol, a.target_id FROM us a WHERE a.target_id IS NOT NULL AND a.ref_kind <> 'type' AND EXISTS (SELECT 1 FROM us b WHERE b.ref_kind = 'type' AND b.target_id = a.target_id AND b.containing_symbol = a.containing_symbol)")
def g11_import_candidates(spark, d):
    _, u, b = B.facts(spark, d)
    kinds = u.withColumns({"ref_kind": F.when(F.col("ref_kind") == "type", "import").otherwise(F.col("ref_kind")), "file": F.col("containing_symbol")})
    return context.import_candidates(kinds, b)


# sums times 2520 / n, whole for each n up to 10 blocks of a task, so that means of means are divided once
_PAIRED = ", tv AS (SELECT task, (sum(b) * 2520 // count(*))::BIGINT AS b, (sum(c) * 2520 // count(*))::BIGINT AS c FROM (SELECT task, trial, max(tokens) FILTER (WHERE arm = 'b') AS b, max(tokens) FILTER (WHERE arm = 'c') AS c FROM (SELECT task, trial // 2 AS trial, arm, tokens, passed FROM att WHERE passed >= {least}) GROUP BY ALL) WHERE b IS NOT NULL AND c IS NOT NULL GROUP BY task) "


def _values(spark, d, least=0):
    a = B.attempts(spark, d).where(F.col("passed") >= least).withColumn("trial", F.floor(F.col("trial") / 2))
    return study.task_values(study.paired_blocks(a, "b", "c", "tokens"), "b", "c")


@query(WITH_ATTEMPTS + _PAIRED.format(least=0) + "SELECT round(sum(c)::DOUBLE / sum(b)::DOUBLE, 6) AS ratio, round((sum(c) - sum(b))::DOUBLE / (2520 * count(*))::DOUBLE, 3) AS difference, count(*) AS n_tasks FROM tv")
def a16_estimates(spark, d):
    return study.estimates(_values(spark, d), "b", "c").withColumns({"ratio": F.round("ratio", 6), "difference": F.round("difference", 3)})


@query(WITH_ATTEMPTS + _PAIRED.format(least=1) + "SELECT round(sum(c)::DOUBLE / sum(b)::DOUBLE, 6) AS ratio, round((sum(c) - sum(b))::DOUBLE / (2520 * count(*))::DOUBLE, 3) AS difference, count(*) AS n_tasks FROM tv")
def a18_successful_only(spark, d):
    return study.estimates(_values(spark, d, 1), "b", "c").withColumns({"ratio": F.round("ratio", 6), "difference": F.round("difference", 3)})


@query(WITH_ATTEMPTS + _PAIRED.format(least=0) + "SELECT task::INTEGER % 3 AS category, round(sum(c)::DOUBLE / sum(b)::DOUBLE, 6) AS ratio, round((sum(c) - sum(b))::DOUBLE / (2520 * count(*))::DOUBLE, 3) AS difference, count(*) AS n_tasks FROM tv GROUP BY ALL")
def a19_group_estimates(spark, d):
    v = _values(spark, d).withColumn("category", F.col("task").cast("int") % 3)
    return study.group_estimates(v, "category", "b", "c").withColumns({"ratio": F.round("ratio", 6), "difference": F.round("difference", 3)})


@query(WITH_INVENTORY + "SELECT coalesce(b.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'new' WHEN b.path IS NULL THEN 'deleted' WHEN (a.content_hash, a.parse_status, a.language) IS NOT DISTINCT FROM (b.content_hash, b.parse_status, b.language) OR (a.size, a.mtime_ns) = (b.size, b.mtime_ns) THEN 'same' ELSE 'changed' END AS change FROM i0 a FULL OUTER JOIN (SELECT i1.*, CASE WHEN content_hash < 'sha256:8' THEN size - 7 ELSE size END AS size, mtime_ns FROM (SELECT * EXCLUDE (parse_status), parse_status FROM i1) i1 JOIN (SELECT CASE WHEN doc_id % 13 = 5 THEN 'moved/' ELSE '' END || source || '/' || lang || '/' || doc_id AS path, strlen(text) AS size, doc_id AS mtime_ns FROM d1) USING (path)) b ON a.path = b.path")
def rf04_metadata_difference(spark, d):
    later = B.inventory(spark, d, later=True).withColumn("size", F.when(F.col("content_hash") < "sha256:8", F.col("size") - 7).otherwise(F.col("size")))
    return inventory.difference(B.inventory(spark, d), later, trust_metadata=True)


@query()
def w06_schedule(spark, d):
    tasks = [f"t{k}" for k in range(20)]
    return spark.createDataFrame(study.schedule(tasks, ["b", "c"], 5, 3), "block long, task string, trial long, arm string, place long")


@query("SELECT conv_id, turn, turn::VARCHAR AS answer FROM conversations")
def b01_answers(spark, d):
    t = B.table(spark, d, "conversations")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n```json\nold\n```\nthen\n```json\n"), F.col("turn"), F.lit("\n```\n"))
    return t.select("conv_id", "turn", study.answer_json(text).alias("answer"))


@query("""WITH w AS (SELECT conv_id || '/' || turn AS id, string_split(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), ' ') AS w FROM conversations), b AS (SELECT item_id, string_split(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), ' ') AS w FROM benchmark),
p AS (SELECT DISTINCT id, array_to_string(w[k:k + 2], ' ') AS run FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS k FROM w WHERE len(w) >= 3)), q AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 2], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 1)) AS k FROM b WHERE len(w) >= 3))
SELECT id, count(DISTINCT item_id) AS n_needles FROM p JOIN q USING (run) GROUP BY id""")
def b05_contamination(spark, d):
    t = B.table(spark, d, "conversations").select(F.concat("conv_id", F.lit("/"), "turn").alias("id"), "text")
    return study.contaminated(t, B.table(spark, d, "benchmark").select(F.col("item_id").alias("needle"), "text"), 3)


@query("SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'timeout' WHEN user_id >= 90 THEN 'max_turns' WHEN value >= 90 THEN 'budget' WHEN event_id % 7 <> 0 THEN 'crash' ELSE 'completed' END AS outcome FROM events")
def b07_outcomes(spark, d):
    e = B.table(spark, d, "events")
    return e.select("event_id", study.outcome(F.col("event_id") % 11 == 0, F.col("user_id"), 90, F.col("value"), 90, F.col("event_id") % 7).alias("outcome"))


@query(WITH_FACTS + "SELECT name, id, total, CASE WHEN total > 3 THEN 3 END AS next_offset FROM (SELECT name, id, count(*) OVER (PARTITION BY name) AS total, row_number() OVER (PARTITION BY name ORDER BY file, start_byte, id) AS k FROM sy) WHERE k <= 3")
def t04_candidate_pages(spark, d):
    return match.pages(B.symbols(spark, d), "name", lookup.symbol_order(), 0, 3).select("name", "id", "total", "next_offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
