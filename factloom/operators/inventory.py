"""Inventories of files: differences, coverage, diagnostics, integrity, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Every status but ok counts as skipped.
SKIPPED = ("binary", "encoding", "parse_error", "resource_limit", "size", "unsupported")
DIAGNOSTIC_CAP = 50


def difference(old: DataFrame, new: DataFrame, trust_metadata: bool = False) -> DataFrame:
    """path, change (new, changed, same, deleted) between two inventories (path, content_hash, parse_status, language,
    size, mtime_ns). trust_metadata takes equal size and mtime for equal content."""
    columns = ["content_hash", "parse_status", "language"]
    names = ["path", *columns, *(["size", "mtime_ns"] if trust_metadata else [])]
    a = old.select(*(F.col(c).alias(f"a_{c}") for c in names), F.lit(True).alias("in_old"))
    b = new.select(*(F.col(c).alias(f"b_{c}") for c in names), F.lit(True).alias("in_new"))
    equal = F.lit(True)
    for c in columns:
        equal = equal & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    if trust_metadata:
        equal = equal | ((F.col("a_size") == F.col("b_size")) & (F.col("a_mtime_ns") == F.col("b_mtime_ns")))
    change = F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "deleted").when(equal, "same").otherwise("changed")
    return a.join(b, F.col("a_path") == F.col("b_path"), "full_outer").select(F.coalesce("b_path", "a_path").alias("path"), change.alias("change"))


def difference_counts(changes: DataFrame) -> DataFrame:
    of = lambda *kinds: F.count_if(F.col("change").isin(*kinds))
    return changes.agg(of("new", "changed").alias("updated"), of("same").alias("unchanged"), of("deleted").alias("deleted"))


def coverage(files: DataFrame) -> DataFrame:
    """One row: seen, indexed, a column per reason to skip, complete."""
    counts = [F.count_if(F.col("parse_status") == s).alias(s) for s in SKIPPED]
    return files.agg(F.count("*").alias("seen"), F.count_if(F.col("parse_status") == "ok").alias("indexed"), *counts).withColumn("complete", F.col("seen") == F.col("indexed"))


def status(length, content, max_bytes: int):
    """Why a file can't be parsed, in the order size, binary, encoding; ok otherwise. Both columns as binaryFile gives them."""
    head = F.hex(F.substring(content, 1, 8192))
    return (
        F.when(length > max_bytes, "size")
        .when(head.rlike("^(?:[0-9A-F]{2})*?00"), "binary")
        .when(~F.is_valid_utf8(content.cast("string")), "encoding")
        .otherwise("ok")
    )


def first_diagnostics(diagnostics: DataFrame, most: int = DIAGNOSTIC_CAP) -> DataFrame:
    order = [F.col("file"), F.col("code"), F.coalesce("start_byte", F.lit(0)), F.col("detail")]
    total = diagnostics.agg(F.count("*").alias("total"))
    return diagnostics.orderBy(*order).limit(most).crossJoin(F.broadcast(total))  # at most 50 rows and one row


def snapshot_digest(files: DataFrame, buckets: int = 256) -> DataFrame:
    """One row: a digest of all (path, status, hash) in path order, as a tree: a digest per range of path hashes, then one
    over those, so that no task ever holds the whole inventory."""
    field = lambda c: F.concat(F.lpad(F.hex(F.octet_length(F.coalesce(c, F.lit("")))), 16, "0"), F.coalesce(c, F.lit("")))
    line = F.concat(field("path"), field("parse_status"), field("content_hash"))
    per = files.select(F.pmod(F.crc32(F.col("path").cast("binary")), F.lit(buckets)).alias("bucket"), "path", F.sha2(line, 256).alias("h"))
    level = per.groupBy("bucket").agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("path", "h"))), lambda x: x["h"])), 256).alias("h"))
    return level.agg(F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"])), 256)).alias("digest"))


def violations(facts: dict[str, DataFrame]) -> DataFrame:
    """rule, violations: keys, foreign keys and checks that a warehouse table can't enforce; all zero in a sound snapshot."""
    files, symbols, uses, bindings = (facts[k] for k in ("files", "symbols", "uses", "bindings"))
    double = lambda df, *keys: df.groupBy(*keys).count().where("count > 1")
    rules = {
        "files_key": double(files, "path"),
        "symbols_key": double(symbols, "id"),
        "uses_key": double(uses, "use_id"),
        "uses_site": double(uses, "file", "start_byte", "end_byte", "ref_kind"),
        "bindings_key": double(bindings, "use_id"),
        "symbol_file": symbols.join(files.select(F.col("path").alias("file")), "file", "left_anti"),
        "binding_use": bindings.join(uses.select("use_id"), "use_id", "left_anti"),
        "binding_target": bindings.join(symbols.select(F.col("id").alias("target_id")), "target_id", "left_anti"),
        "binding_tier": bindings.where(~F.col("resolution").isin("exact", "scoped")),
        "symbol_span": symbols.where("start_byte >= end_byte"),
    }
    out = None
    for name, bad in rules.items():
        row = bad.agg(F.lit(name).alias("rule"), F.count("*").alias("violations"))
        out = row if out is None else out.unionByName(row)
    return out
