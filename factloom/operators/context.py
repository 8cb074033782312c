"""Context of symbols: ranked neighbours and what of them fits a budget."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import scalars as S

#: Fixed values, best first.
REASONS = ("target", "type", "callee", "test", "caller", "import", "parent", "second_degree")
CANDIDATE_CAP = 1000
EXAMINED_CAP = 10_000
#: Targets that share their first hops' neighbours in traversal_of_all: so many in a row, and so many first hops of theirs.
_TOGETHER_BITS, _TOGETHER_HOPS = 12, 1 << 16
#: A neighbour in one number: its code (reason * 4 + tier), its symbol's number, and its best tier in two bits.
_NUMBER_BITS, _CODE_BITS = 56, 58
_EMITTED = 1 << 17
#: Rows that are shuffled at a time, and rounds at most: beyond, a round's share of the rows is what grows.
_ROUND_ROWS, _MOST_ROUNDS = 1 << 22, 8


def reason_rank(reason):
    out = F.lit(len(REASONS))
    for k, name in enumerate(REASONS):
        out = F.when(reason == name, k).otherwise(out)
    return out


def rank_order() -> list:
    """Depth, reason, resolution, file (by bytes), start, id."""
    return [F.col("depth"), reason_rank(F.col("reason")), S.tier_rank(F.col("resolution")), F.col("file"), F.col("start_byte"), F.col("id")]


def best_per_symbol(candidates: DataFrame) -> DataFrame:
    """Of each target's candidates the best row per id, numbered by rank (from 1)."""
    best = Window.partitionBy("target", "id").orderBy(*rank_order())
    place = Window.partitionBy("target").orderBy(*rank_order())
    return candidates.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n").withColumn("rank", F.row_number().over(place))


def neighbours(symbols: DataFrame, uses: DataFrame, bindings: DataFrame, targets: DataFrame, test_file=None) -> DataFrame:
    """(target, id, reason, resolution): callees and types a target uses, callers (tests by test_file), its parent."""
    linked = uses.join(bindings, "use_id").select("use_id", "file", "ref_kind", "containing_symbol", "target_id", "resolution")
    wanted = targets.select(F.col("id").alias("target"))
    down = linked.join(wanted, F.col("containing_symbol") == F.col("target")).select("target", F.col("target_id").alias("id"), F.when(F.col("ref_kind") == "type", "type").otherwise("callee").alias("reason"), "resolution")
    test = test_file(F.col("file")) if test_file else F.lit(False)
    up = linked.join(wanted, F.col("target_id") == F.col("target")).where("containing_symbol IS NOT NULL").select("target", F.col("containing_symbol").alias("id"), F.when(test, "test").otherwise("caller").alias("reason"), "resolution")
    parent = symbols.join(wanted, F.col("id") == F.col("target")).where("parent_id IS NOT NULL").select("target", F.col("parent_id").alias("id"), F.lit("parent").alias("reason"), F.lit("exact").alias("resolution"))
    return down.unionByName(up).unionByName(parent).where("id <> target")


def import_candidates(uses: DataFrame, bindings: DataFrame) -> DataFrame:
    """(containing_symbol, target_id): what a symbol uses that its file imports."""
    linked = uses.join(bindings, "use_id").select("file", "ref_kind", "containing_symbol", "target_id")
    imported = linked.where("ref_kind = 'import'").select("file", "target_id").distinct()
    used = linked.where("ref_kind <> 'import' AND containing_symbol IS NOT NULL")
    return used.join(imported, ["file", "target_id"], "left_semi").select("containing_symbol", "target_id").distinct()


def weakest(a, b):
    """The weaker of two resolutions."""
    return F.when(S.tier_rank(a) >= S.tier_rank(b), a).otherwise(b)


def traversal(symbols: DataFrame, uses: DataFrame, bindings: DataFrame, targets: DataFrame, depth: int = 2, most: int = CANDIDATE_CAP, test_file=None) -> DataFrame:
    """Ranked candidates (target, id, reason, resolution, depth, rank) of one or two hops, at most `most` a target.

    name_match and parent rows don't lead further; two hops are as strong as their weaker one. A target whose first
    hop already reaches the cap takes no second one.
    """
    facts = symbols.select("id", "file", "start_byte")
    first = neighbours(symbols, uses, bindings, targets, test_file).withColumn("depth", F.lit(1))
    ranked = best_per_symbol(first.join(facts, "id"))
    if depth > 1:
        full = ranked.groupBy("target").agg(F.max("rank").alias("n")).where(F.col("n") >= most).select("target")
        seeds = ranked.where("resolution <> 'name_match' AND reason <> 'parent'").join(full, "target", "left_anti").select(F.col("target").alias("_origin"), "id", F.col("resolution").alias("_hop"))
        further = neighbours(symbols, uses, bindings, seeds.select("id").distinct(), test_file)
        second = further.withColumnRenamed("target", "_seed").join(seeds.withColumnRenamed("id", "_seed"), "_seed").where("id <> _origin").select(F.col("_origin").alias("target"), "id", F.lit("second_degree").alias("reason"), weakest(F.col("resolution"), F.col("_hop")).alias("resolution"), F.lit(2).alias("depth"))
        ranked = best_per_symbol(first.unionByName(second).join(facts, "id"))
    return ranked.where(F.col("rank") <= most).select("target", "id", "reason", "resolution", "depth", "rank")


def _scratch_dir(spark: SparkSession) -> str:
    """A new name in a folder that driver and executors share: the session's checkpoint folder, else the warehouse; without
    a checkpoint folder, a temporary one where everything is one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        base = f"file://{tempfile.mkdtemp(prefix='factloom-')}"
        atexit.register(shutil.rmtree, base[len("file://") :], ignore_errors=True)
    return f"{(base or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/factloom-traversal-{uuid.uuid4().hex}"


def _kept(df: DataFrame, path: str, mode: str = "error") -> DataFrame:
    """Written to path. What was shuffled for it goes then: Spark deletes shuffle files when the driver's garbage is
    collected, which otherwise happens by chance."""
    df.write.option("compression", "zstd").mode(mode).parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _removed(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def rounds(rows: int) -> int:
    """In how many rounds so many rows are shuffled, one after the other, each round's shuffle files going before the next."""
    return min(_MOST_ROUNDS, 1 + rows // _ROUND_ROWS)


def in_round(key: str, of: int, k: int):
    return F.pmod(F.xxhash64(key), F.lit(of)) == k


def traversal_of_all(symbols: DataFrame, linked: DataFrame | list[DataFrame], most: int = CANDIDATE_CAP) -> DataFrame:
    """The same rows as traversal of depth 2 with every symbol as a target. linked: bound uses (containing_symbol, target_id,
    ref_kind, resolution), or parts of them that are shuffled one after the other.

    Two hops have far more paths than rows, so paths are never shuffled. Symbols are numbered in the order of files, starts
    and ids. A symbol's neighbours are one sorted list of numbers; of every resolution the first most + 1 can be among the
    candidates of any target, whose own row and first hop take at most `most` of them away. Targets that stand together in
    the symbol table are packed into one row with the lists of their first hops, each once, and with the names of all these.
    The packed rows are written in rounds; the result reads them and merges each by itself, without a shuffle.
    """
    spark, at = symbols.sparkSession, _scratch_dir(symbols.sparkSession)
    own = symbols.select("id", F.struct("file", "start_byte").alias("at"), F.monotonically_increasing_id().alias("m"))
    place = own.where("id IS NOT NULL").groupBy("id").agg(F.min("at").alias("at"), F.min("m").alias("m")).sort("at.file", "at.start_byte", "id")
    number = _kept(place.select("id", F.monotonically_increasing_id().alias("o"), "m"), f"{at}/number")
    known = lambda key, name: number.select(F.col("id").alias(key), F.col("o").alias(name))
    parents = symbols.select(F.col("id").alias("containing_symbol"), F.col("parent_id").alias("target_id"), F.lit(REASONS.index("parent")).alias("p"), F.lit(0).alias("tier"))
    for part in [parents, *(linked if isinstance(linked, list) else [linked])]:
        if "p" not in part.columns:
            part = part.select("containing_symbol", "target_id", F.when(F.col("ref_kind") == "type", REASONS.index("type")).otherwise(REASONS.index("callee")).alias("p"), S.tier_rank(F.col("resolution")).alias("tier"))
        ends = part.join(known("containing_symbol", "x"), "containing_symbol").join(known("target_id", "y"), "target_id").where("x <> y")
        edges = _kept(ends.select("x", "y", F.col("p").cast("byte").alias("p"), F.col("tier").cast("byte").alias("tier")), f"{at}/edges", "append")
    up = edges.where(F.col("p") != REASONS.index("parent")).select(F.col("y").alias("x"), F.col("x").alias("y"), F.lit(REASONS.index("caller")).cast("byte").alias("p"), "tier")
    both = edges.unionByName(up).select("x", (F.col("y") * 32 + F.col("p") * 4 + F.col("tier")).alias("e"))
    n_pairs = 2 * edges.count()
    aim = F.transform(F.slice(F.col("z"), 1, most), lambda z: F.struct(F.shiftright(z, _CODE_BITS).alias("c"), F.shiftright(z, 2).bitwiseAND((1 << _NUMBER_BITS) - 1).alias("y")))
    leads = F.when(F.size("z") < most, F.transform(F.filter(aim, lambda a: (a["c"] % 4 < S.RESOLUTIONS.index("name_match")) & (a["c"] < REASONS.index("parent") * 4)), lambda a: a["y"])).otherwise(F.array().cast("array<long>"))
    for k in range(of := rounds(n_pairs)):
        e, y = F.col("e"), F.shiftright("e", 5)
        pairs = both.where(in_round("x", of, k)).repartition("x").groupBy("x", y.alias("y")).agg(F.min(e % 32).alias("c"), F.min(e % 4).alias("tier"))
        ranked = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("x").orderBy("c", "y"))).withColumn("_k", F.row_number().over(Window.partitionBy("x", "tier").orderBy("y")))
        packed = F.col("c") * (1 << _CODE_BITS) + F.col("y") * 4 + F.col("tier")
        lists = ranked.where((F.col("_n") <= most) | (F.col("_k") <= most + 1)).groupBy("x").agg(F.array_sort(F.collect_list(packed)).alias("z"))
        nodes = _kept(lists.join(number.select(F.col("o").alias("x"), "m"), "x"), f"{at}/nodes", "append")
    _removed(spark, f"{at}/edges")
    group = F.shiftright("m", _TOGETHER_BITS)
    before = F.sum(F.size("seeds")).over(Window.partitionBy(group).orderBy("m"))
    for k in range(of):
        aims = nodes.withColumn("g", group).where(in_round("g", of, k)).withColumn("seeds", leads)
        aims = aims.withColumn("bucket", group * (1 << _TOGETHER_BITS) + F.floor(before / _TOGETHER_HOPS))
        lists = aims.select("bucket", F.explode("seeds").alias("x")).distinct().join(nodes.select("x", "z"), "x")
        rows = lists.select("bucket", F.lit(0).alias("part"), "x", "z").unionByName(aims.select("bucket", F.lit(1).alias("part"), "x", "z"))
        dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "part", "x")
        nameless = _kept(dealt.mapInArrow(lambda batches: _packed(batches, most), "bucket long, ys array<long>, packed binary"), f"{at}/nameless-{k}")
        named = nameless.select("bucket", F.explode("ys").alias("o")).join(number.select("o", "id"), "o").groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("o", "id")))["id"].alias("names"))
        # one file a task, and tasks read whole files: small files let many tasks share the merging
        whole = nameless.select("bucket", "packed").join(named, "bucket").select("names", "packed")
        whole.write.option("compression", "zstd").option("maxRecordsPerFile", 1).mode("append").parquet(f"{at}/packed")
        spark.sparkContext._jvm.System.gc()
        _removed(spark, f"{at}/nameless-{k}")
    for name in ("number", "nodes"):
        _removed(spark, f"{at}/{name}")
    return spark.read.schema(whole.schema).parquet(f"{at}/packed").mapInArrow(lambda batches: _merged(batches, most), "target string, id string, reason string, resolution string, depth int, rank int")


def _packed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(bucket, ys, packed) from rows (bucket, part, x, z) in this order: the numbers that occur, and lists (part 0) and
    targets (part 1) that name them by their place in ys."""
    bucket, held = None, ([], [])

    def done() -> pa.RecordBatch:
        (lists, aims), low = held, (1 << _NUMBER_BITS) - 1
        first = [z[:most] for _, z in aims]
        z, hops = (np.concatenate(zs) if zs else np.empty(0, dtype=np.int64) for zs in ([z for _, z in lists], first))
        y, hop = z >> 2 & low, hops >> 2 & low
        at, of = (np.array([x for x, _ in part], dtype=np.int64) for part in held)
        ys = np.unique(np.concatenate([y, hop, at, of]))
        n, sizes = len(ys), np.array([len(z) for _, z in lists], dtype=np.int64)
        # lists one after the other, each in the order of resolutions and numbers, as differences
        keys = np.sort(np.repeat(np.arange(len(lists)), sizes) * (len(S.RESOLUTIONS) * n) + (z & 3) * n + np.searchsorted(ys, y))
        columns = {
            "at": np.searchsorted(ys, at), "sizes": sizes, "keys": np.diff(keys, prepend=0),
            "aims": np.searchsorted(ys, of), "hops": np.array([len(f) for f in first], dtype=np.int64), "y": np.searchsorted(ys, hop), "c": hops >> _CODE_BITS,
        }
        row = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(v)], pa.array(v.astype(np.min_scalar_type(v.max(initial=0))))) for v in columns.values()], list(columns))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(row)
        return pa.RecordBatch.from_arrays([pa.array([bucket]), pa.ListArray.from_arrays([0, n], pa.array(ys)), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["bucket", "ys", "packed"])

    for batch in batches:
        of, part, x = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        ends, z = np.asarray(batch.column(3).offsets), batch.column(3).values.to_numpy(zero_copy_only=False)
        for k in range(len(x)):
            if of[k] != bucket:
                if held[1]:
                    yield done()
                bucket, held = int(of[k]), ([], [])
            held[int(part[k])].append((int(x[k]), z[ends[k] : ends[k + 1]].copy()))
    if held[1]:
        yield done()


def _merged(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows of the targets of every packed row."""
    reasons, resolutions, second = pa.array(REASONS), pa.array(S.RESOLUTIONS), REASONS.index("second_degree")

    def rows(names: pa.Array, found: list) -> pa.RecordBatch:
        y, c = (np.concatenate([f[j] for f in found]) for j in (1, 2))
        sizes = [len(f[1]) for f in found]
        rank = np.concatenate([np.arange(1, m + 1, dtype=np.int32) for m in sizes])
        return pa.RecordBatch.from_arrays(
            [names.take(pa.array(np.repeat([f[0] for f in found], sizes))), names.take(pa.array(y)), reasons.take(pa.array(c // 4)), resolutions.take(pa.array(c % 4)), pa.array(1 + (c // 4 == second).astype(np.int32)), pa.array(rank)],
            ["target", "id", "reason", "resolution", "depth", "rank"],
        )

    for batch in batches:
        for k in range(batch.num_rows):
            names = batch.column(0).slice(k, 1).flatten()
            row = pa.ipc.open_stream(batch.column(1)[k].as_buffer()).read_next_batch()
            v = {name: row.column(name).values.to_numpy().astype(np.int64) for name in row.schema.names}
            n = len(names)
            codes = (np.cumsum(v["keys"]) - np.repeat(np.arange(len(v["sizes"])) * (len(S.RESOLUTIONS) * n), v["sizes"])).astype(np.int64 if n >= 1 << 29 else np.int32)
            ends, stops = np.concatenate([[0], np.cumsum(v["sizes"])]), np.concatenate([[0], np.cumsum(v["hops"])])
            found, held = [], 0
            for j, x in enumerate(v["aims"].tolist()):
                found.append((x, *_two_hops(x, v["y"][stops[j] : stops[j + 1]], v["c"][stops[j] : stops[j + 1]], v["at"], ends, codes, n, most)))
                held += len(found[-1][1])
                if held >= _EMITTED:
                    yield rows(names, found)
                    found, held = [], 0
            if found:
                yield rows(names, found)


def _two_hops(x: int, y: np.ndarray, c: np.ndarray, at: np.ndarray, ends: np.ndarray, codes: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and codes (reason * 4 + tier) of a target's candidates in their order, from those of its first hop. The list of
    place at[k] is codes[ends[k] : ends[k + 1]], each tier * n + place."""
    leads = (c % 4 < S.RESOLUTIONS.index("name_match")) & (c < REASONS.index("parent") * 4)
    if len(y) >= most or not leads.any():
        return y, c
    lists = []
    for k, hop in zip(np.searchsorted(at, y[leads]).tolist(), (c[leads] % 4).tolist(), strict=True):
        own = codes[ends[k] : ends[k + 1]]
        lists.append(np.where(own < hop * n, own % n + hop * n, own) if hop else own)
    own, tiers = np.concatenate(lists), range(len(S.RESOLUTIONS))
    if n <= 16 * len(own):
        best = np.full(n, len(tiers), dtype=np.int8)
        for t in reversed(tiers):
            best[own[(own >= t * n) & (own < (t + 1) * n)] - t * n] = t
        best[y] = best[x] = len(tiers)
        own = np.concatenate([np.flatnonzero(best == t) + t * n for t in tiers])
    else:
        own = np.unique(own)
        own = own[np.sort(np.unique(own % n, return_index=True)[1])]
        own = own[~np.isin(own % n, y) & (own % n != x)]
    own = own[: most - len(y)].astype(np.int64)
    return np.concatenate([y, own % n]), np.concatenate([c, REASONS.index("second_degree") * 4 + own // n])


def greedy_fit(items: DataFrame, by: str, budget: int) -> DataFrame:
    """by, taken, used, omitted, n_signatures: items (rank, full, short: token counts) in rank order, each whole if it
    fits into what is left, else as its signature, else left out, and the walk goes on. A fold per group; a prefix sum
    would stop at the first that doesn't fit. Groups are context candidates, bounded by CANDIDATE_CAP."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("short"), F.lit(0).cast("long").alias("omitted"))

    def step(a, x):
        whole, brief = a["used"] + x["full"] <= budget, a["used"] + x["short"] <= budget
        return F.struct(
            F.when(whole, a["used"] + x["full"]).when(brief, a["used"] + x["short"]).otherwise(a["used"]).alias("used"),
            (a["taken"] + F.when(whole | brief, 1).otherwise(0)).alias("taken"),
            (a["short"] + F.when(~whole & brief, 1).otherwise(0)).alias("short"),
            (a["omitted"] + F.when(whole | brief, 0).otherwise(1)).alias("omitted"),
        )

    sorted_ = F.array_sort(F.collect_list(F.struct("rank", F.col("full").cast("long").alias("full"), F.col("short").cast("long").alias("short"))))
    fit = items.groupBy(by).agg(F.aggregate(sorted_, start, step).alias("f"))
    return fit.select(by, F.col("f.taken").alias("taken"), F.col("f.used").alias("used"), F.col("f.omitted").alias("omitted"), F.col("f.short").alias("n_signatures"))


FIT_SCHEMA = "target string, id string, form string, tokens long, reason string"


def overlap_fit(items: DataFrame, budget: int, most_segments: int = 50) -> DataFrame:
    """Per target the segments that fit (target, id, form, tokens) and why others don't (form null; reason overlap, limit
    or budget, each once). items: target, id, rank, file, start_byte, end_byte, full, short. What lies within a segment
    already taken whole is an overlap; a symbol that holds taken ones replaces them, and only the net total counts."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        taken: list[dict] = []
        out = []
        for x in part.sort_values("rank").to_dict("records"):
            inside = [t for t in taken if t["file"] == x["file"] and t["form"] == "full" and t["start_byte"] <= x["start_byte"] and x["end_byte"] <= t["end_byte"]]
            holds = [t for t in taken if t["file"] == x["file"] and x["start_byte"] <= t["start_byte"] and t["end_byte"] <= x["end_byte"]]
            if inside:
                out.append({**x, "form": None, "tokens": 0, "reason": "overlap"})
                continue
            if len(taken) - len(holds) >= most_segments:
                out.append({**x, "form": None, "tokens": 0, "reason": "limit"})
                continue
            used = sum(t["tokens"] for t in taken)
            freed = sum(t["tokens"] for t in holds)
            if used - freed + x["full"] <= budget:
                taken = [t for t in taken if t not in holds] + [{**x, "form": "full", "tokens": x["full"]}]
                out += [{**t, "form": None, "tokens": 0, "reason": "overlap"} for t in holds]
            elif not holds and used + x["short"] <= budget:
                taken.append({**x, "form": "signature", "tokens": x["short"]})
            else:
                out.append({**x, "form": None, "tokens": 0, "reason": "budget"})
        rows = [{**t, "reason": None} for t in taken] + out
        return pd.DataFrame(rows)[["target", "id", "form", "tokens", "reason"]]

    return items.groupBy("target").applyInPandas(run, FIT_SCHEMA)

