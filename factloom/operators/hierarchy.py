"""Class hierarchies: direct supertypes, ancestors, up-sets, unrelated receivers.

edges: child, relation (extends or implements), qname (null where unknown), parent (null where not indexed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import scalars as S


def direct_supertypes(edges: DataFrame) -> DataFrame:
    """Each supertype of a child once (identity: its id, else its folded name), extends before implements, then by name."""
    identity = F.coalesce(F.concat(F.lit("id:"), F.col("parent")), F.concat(F.lit("name:"), S.ascii_fold(F.col("qname"))), F.lit("unknown"))
    order = Window.partitionBy("child", "relation", identity).orderBy(S.ascii_fold(F.col("qname")))
    return edges.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def ancestors(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(id, ancestor, depth) over resolved parents, by level: cycles end, nobody is their own ancestor.

    A level joins the frontier with the edges and takes away what is known; levels are as many as the hierarchy is
    deep, and each is checkpointed so that the plan doesn't grow.
    """
    links = edges.where("parent IS NOT NULL").select(F.col("child").alias("_from"), F.col("parent").alias("_to")).distinct()
    frontier = (starts if starts is not None else edges.select(F.col("child").alias("id"))).select("id", F.col("id").alias("_at")).distinct()
    known, depth = None, 0
    while True:  # ends, as what is known is taken away
        depth += 1
        step = frontier.join(links, F.col("_at") == F.col("_from")).where("_to <> id").select("id", F.col("_to").alias("ancestor")).distinct()
        if known is not None:
            step = step.join(known.select("id", "ancestor"), ["id", "ancestor"], "left_anti")
        step = _cut(step.withColumn("depth", F.lit(depth)))
        if step.isEmpty():
            break
        known = step if known is None else known.unionByName(step)
        frontier = step.select("id", F.col("ancestor").alias("_at"))
    return known if known is not None else step


def _cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the session's checkpoint folder where it has one."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.cache()


def upsets(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """Per class: ids (itself and its ancestors), names (folded names of all its supertypes), open (one isn't indexed)."""
    up = ancestors(edges, classes.select("id")).select("id", F.col("ancestor").alias("member")).unionByName(classes.select("id", F.col("id").alias("member")))
    direct = edges.groupBy(F.col("child").alias("member")).agg(F.collect_set(S.ascii_fold(F.col("qname"))).alias("names"), F.bool_or(F.col("parent").isNull()).alias("open"))
    joined = up.join(direct, "member", "left")
    return joined.groupBy("id").agg(F.array_sort(F.collect_set("member")).alias("ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("names", F.array().cast("array<string>")))))).alias("names"), F.coalesce(F.bool_or("open"), F.lit(False)).alias("open"))


def has_unknown_link(edges: DataFrame) -> DataFrame:
    """One row: whether any supertype has no name at all, which ends exclusion by hierarchy everywhere."""
    return edges.agg(F.coalesce(F.bool_or(F.col("qname").isNull()), F.lit(False)).alias("unknown_link"))


def class_relation(ups: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target class the ids of everything related to it: the union of its subtypes' up-sets."""
    below = ups.select("ids", F.explode("ids").alias("target")).join(targets.select(F.col("id").alias("target")), "target", "left_semi")
    each = below.select("target", F.explode("ids").alias("related")).distinct()
    return each.groupBy("target").agg(F.array_sort(F.collect_set("related")).alias("related"))


def nearest_scope(parents: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, name, value) of the nearest scope on the chain from id upward (itself first) with a fact for the name.
    parents: id, parent_id; facts: scope, name, value, one per (scope, name)."""
    edges = parents.where("parent_id IS NOT NULL").select(F.col("id").alias("child"), F.lit("parent").alias("relation"), F.col("parent_id").alias("qname"), F.col("parent_id").alias("parent"))
    chain = ancestors(edges, parents.select("id")).unionByName(parents.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth")))
    seen = chain.join(facts, F.col("ancestor") == F.col("scope"))
    return seen.groupBy("id", "name").agg(F.min_by("value", "depth").alias("value"))


def unrelated(receiver: Column, related: Column, open_: Column) -> Column:
    """A receiver's class excludes a target if it isn't among its relations and nothing unindexed lies between."""
    return receiver.isNotNull() & ~F.array_contains(related, receiver) & ~F.coalesce(open_, F.lit(False))
