"""Paired studies: means by task and arm, comparisons, bootstrap, transcripts, checks.

attempts: task, arm, trial, metric columns; a missing value is null and never zero.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def task_means(attempts: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, task, arm, task_mean, n, missing."""
    long = attempts.unpivot(["task", "arm"], metrics, "metric", "value")
    return long.groupBy("metric", "task", "arm").agg(F.avg("value").alias("task_mean"), F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("missing"))


def arm_means(means: DataFrame, arms: list[str]) -> DataFrame:
    """metric, arm, mean of task means, n_tasks, paired_mean and n_paired over tasks with a value in every arm."""
    some = means.where("task_mean IS NOT NULL")
    whole = some.groupBy("metric", "task").agg(F.count_distinct("arm").alias("_k")).where(F.col("_k") == len(arms)).select("metric", "task", F.lit(True).alias("_paired"))
    marked = some.join(whole, ["metric", "task"], "left")
    return marked.groupBy("metric", "arm").agg(F.avg("task_mean").alias("mean"), F.count("*").alias("n_tasks"), F.avg(F.when(F.col("_paired"), F.col("task_mean"))).alias("paired_mean"), F.count_if(F.col("_paired")).alias("n_paired"))


def comparisons(arm_table: DataFrame, base: str, other: str) -> DataFrame:
    """metric, ratio and difference of paired means, undefined (why the ratio is null)."""
    wide = arm_table.where(F.col("arm").isin(base, other)).groupBy("metric").pivot("arm", [base, other]).agg(F.first("paired_mean"))
    b, c = F.col(f"`{base}`"), F.col(f"`{other}`")
    return wide.select("metric", F.when(b != 0, c / b).alias("ratio"), (c - b).alias("difference"), F.when(b.isNull() | c.isNull(), "no paired tasks").when(b == 0, "zero denominator").alias("undefined"))


def accounting(schedule: DataFrame, attempts: DataFrame) -> DataFrame:
    """arm, scheduled, run, included, excluded, failed: every scheduled block counts, run or not."""
    joined = schedule.join(attempts, ["task", "trial", "arm"], "left")
    return joined.groupBy("arm").agg(F.count("*").alias("scheduled"), F.count_if(F.col("inclusion").isNotNull()).alias("run"), F.count_if(F.col("inclusion") == "included").alias("included"), F.count_if(F.col("inclusion") == "excluded").alias("excluded"), F.count_if(F.col("passed") == 0).alias("failed"))


def merged_counts(rows: DataFrame, by: list[str], maps: str) -> DataFrame:
    """by, key, n: JSON objects of counts, added up by key."""
    each = rows.select(*by, F.explode(F.from_json(maps, "map<string,long>")).alias("key", "n"))
    return each.groupBy(*by, "key").agg(F.sum("n").alias("n"))


def inclusion(attempts: DataFrame) -> DataFrame:
    """attempts with inclusion: a block's first attempt counts; after an infrastructure failure of any arm the whole block
    counts by its second attempts; blocks that fail again don't count."""
    block = Window.partitionBy("task", "trial")
    failed = lambda n: F.coalesce(F.bool_or((F.col("attempt") == n) & F.col("infra")).over(block), F.lit(False))
    has_second = F.coalesce(F.bool_or(F.col("attempt") == 2).over(block), F.lit(False))
    rule = (
        F.when(~failed(1), F.when(F.col("attempt") == 1, "included").otherwise("excluded"))
        .when(has_second & ~failed(2), F.when(F.col("attempt") == 2, "included").otherwise("excluded"))
        .otherwise("excluded")
    )
    return attempts.withColumn("inclusion", rule)


def paired_blocks(attempts: DataFrame, base: str, other: str, metric: str) -> DataFrame:
    """task, trial, base and other: blocks where both arms have a value."""
    side = lambda arm: attempts.where((F.col("arm") == arm) & F.col(metric).isNotNull()).groupBy("task", "trial").agg(F.max(metric).alias(arm))
    return side(base).join(side(other), ["task", "trial"])


def task_values(blocks: DataFrame, base: str, other: str) -> DataFrame:
    """task, mean of either arm over its blocks, n, and the sums `<arm>_sum` (exact up to nine digits after the point)."""
    total = lambda c: F.sum(F.col(c).cast("decimal(28,9)")).alias(f"{c}_sum")
    return blocks.groupBy("task").agg(F.avg(base).alias(base), F.avg(other).alias(other), F.count("*").alias("n"), total(base), total(other))


def _means_of_means(values: DataFrame, by: list[str], base: str, other: str) -> DataFrame:
    """by, ratio, difference, n_tasks. Task means are brought to one denominator, so that nothing is rounded before the
    last division, whatever the order of the rows: sums are first added up by number of blocks."""
    parts = values.groupBy(*by, "n").agg(F.sum(f"{base}_sum").alias("b"), F.sum(f"{other}_sum").alias("c"), F.count("*").alias("tasks"))
    rows = parts.groupBy(*by).agg(F.collect_list(F.struct("n", "b", "c")).alias("parts"), F.sum("tasks").alias("n_tasks"))
    whole = F.aggregate("parts", F.lit(1).cast("decimal(38,0)"), lambda a, x: (a * x["n"]).cast("decimal(38,0)"))
    over = lambda arm: F.aggregate("parts", F.lit(0).cast("decimal(38,9)"), lambda a, x: (a + x[arm] * (F.col("whole") / x["n"]).cast("decimal(20,0)")).cast("decimal(38,9)"))
    summed = rows.withColumn("whole", whole).withColumns({"b": over("b"), "c": over("c")})
    number = lambda c: c.cast("double")
    ratio = F.when(F.col("b") != 0, number(F.col("c")) / number(F.col("b")))
    difference = number(F.col("c") - F.col("b")) / number(F.col("whole") * F.col("n_tasks"))
    return summed.select(*by, ratio.alias("ratio"), difference.alias("difference"), "n_tasks")


def estimates(values: DataFrame, base: str, other: str) -> DataFrame:
    """ratio of the means of task values, difference, n_tasks; the ratio is null where the base is zero. values: of
    task_values; one row, of nulls and zero tasks where there are none."""
    found = _means_of_means(values, [], base, other)
    return found.withColumn("n_tasks", F.coalesce("n_tasks", F.lit(0).cast("long")))


def group_estimates(values: DataFrame, group: str, base: str, other: str) -> DataFrame:
    return _means_of_means(values, [group], base, other)


def schedule(tasks: list[str], arms: list[str], trials: int, seed: int) -> list[tuple[int, str, int, str, int]]:
    """(block, task, trial, arm, place): tasks in order within a trial, the arms of each block in an order drawn by seed."""
    rng, out = random.Random(seed), []
    for trial in range(1, trials + 1):
        for task in tasks:
            order = arms[:]
            rng.shuffle(order)
            block = (trial - 1) * len(tasks) + tasks.index(task)
            out += [(block, task, trial, arm, place) for place, arm in enumerate(order)]
    return out


def outcome(timed_out, turns, most_turns: int, cost, most_cost, exit_code):
    """Why a run ended, the first that fits."""
    return F.when(timed_out, "timeout").when(turns >= most_turns, "max_turns").when(cost >= most_cost, "budget").when(exit_code != 0, "crash").otherwise("completed")


def bootstrap_draws(tasks: list[tuple[str, str]], replicates: int, seed: int) -> list[tuple[int, str]]:
    """(replicate, task) of a bootstrap by strata: each stratum draws as many of its tasks as it has, with replacement."""
    rng = random.Random(seed)
    strata: dict[str, list[str]] = {}
    for task, stratum in sorted(tasks):
        strata.setdefault(stratum, []).append(task)
    return [(r, rng.choice(strata[s])) for r in range(replicates) for s in sorted(strata) for _ in strata[s]]


def bound_index(replicates: int, tail: float) -> int:
    """The 1-based order statistic of a one-sided bound."""
    return max(1, min(replicates, int(replicates * (1 - tail)) + 1))


def bootstrap(values: DataFrame, draws: DataFrame, base: str, other: str) -> DataFrame:
    """replicate, ratio of the means of drawn task values."""
    drawn = draws.join(F.broadcast(values), "task") if values.count() <= 100_000 else draws.join(values, "task")
    return drawn.groupBy("replicate").agg(F.avg(base).alias("_b"), F.avg(other).alias("_c")).where("_b <> 0").select("replicate", (F.col("_c") / F.col("_b")).alias("ratio"))


def kth(values: DataFrame, column: str, k: int) -> DataFrame:
    """The k-th smallest value (1-based), as one row; exact, not a percentile estimate."""
    return values.orderBy(column).offset(k - 1).limit(1).select(column)


def fallbacks(turns: DataFrame, tool: str, fallback: list[str]) -> DataFrame:
    """Calls of a tool followed, within the next two calls of the transcript, by a fallback tool: transcript, n_calls, n_fallbacks."""
    order = Window.partitionBy("transcript").orderBy("index")
    near = F.coalesce(F.lead("tool", 1).over(order).isin(fallback), F.lit(False)) | F.coalesce(F.lead("tool", 2).over(order).isin(fallback), F.lit(False))
    marked = turns.withColumn("_near", near).where(F.col("tool") == tool)
    return marked.groupBy("transcript").agg(F.count("*").alias("n_calls"), F.count_if(F.col("_near")).alias("n_fallbacks"))


def set_scores(rows: DataFrame, answer: str = "answer", gold: str = "gold", numerator: int = 1, denominator: int = 1) -> DataFrame:
    """rows with hits, precision, recall, f1, and passed: F1 >= numerator/denominator, compared in integers."""
    a, g = F.array_distinct(answer), F.array_distinct(gold)
    hits = F.size(F.array_intersect(a, g)).cast("long")
    n = (F.size(a) + F.size(g)).cast("long")
    return rows.select(
        "*", hits.alias("hits"), F.when(F.size(a) > 0, hits / F.size(a)).alias("precision"), F.when(F.size(g) > 0, hits / F.size(g)).alias("recall"),
        F.when(n > 0, 2 * hits / n).alias("f1"), (2 * hits * denominator >= numerator * n).alias("passed"),
    )


def answer_json(text):
    """The body of the last fenced json block, null without one."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)```json\s*\n(.*?)\n\s*```"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def normalized_path(path):
    """Slashes one way, no leading ./ and no doubled ones."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), "/+", "/"), r"^(\./)+", "")


def classified(text, patterns: list[tuple[str, str]]):
    """The first class whose pattern is found, null without one."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(patterns):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def contaminated(texts: DataFrame, needles: DataFrame, n_words: int = 8) -> DataFrame:
    """Rows of texts (id, text) that hold a needle's n-word run: id, n_needles. Runs are joined as hashes, then compared."""
    def runs(df: DataFrame, key: str) -> DataFrame:
        words = F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), " ")
        some = df.select(F.col(key), words.alias("w")).where(F.size("w") >= n_words)
        return some.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n_words + 1), lambda i: F.array_join(F.slice("w", i, n_words), " "))).alias("run")).distinct()

    found = runs(texts, "id").join(runs(needles, "needle"), "run").select("id", "needle").distinct()
    return found.groupBy("id").agg(F.count("*").alias("n_needles"))


def timing_summary(samples: DataFrame, by: str, value: str) -> DataFrame:
    return samples.groupBy(by).agg(F.percentile(value, 0.5).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"))


def spending(events: DataFrame, cap: int) -> DataFrame:
    """events with spent (running total in order) and over (beyond the cap)."""
    order = Window.partitionBy("study").orderBy("index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spent = F.sum("cost").over(order)
    return events.withColumn("spent", spent).withColumn("over", spent > cap)
