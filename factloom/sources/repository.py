"""Source trees as tables: the walk, bounded reads, classification, configuration."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import scalars as S
from factloom.functions.globs import ignored
from factloom.operators import inventory

#: Never walked.
EXCLUDED_DIRS = (".git", ".factloom")
WALK_SCHEMA = "path string, mtime_ns long, size long"
I64 = 2**63


@dataclass(frozen=True)
class Config:
    """Settings of an index; unknown keys and values out of range are errors."""

    exclude: tuple[str, ...] = ()
    max_file_size_kb: int = 1024
    enabled: tuple[str, ...] = ("php", "typescript")
    token_budget: int = 4000
    max_depth: int = 2
    limit: int = 50
    freshness: str = "content"
    test_globs: tuple[str, ...] = field(default=("tests/", "**/*.test.ts", "**/*Test.php"))

    def __post_init__(self) -> None:
        for name, low, high in (("max_file_size_kb", 1, 1 << 20), ("token_budget", 1, 1_000_000), ("max_depth", 1, 2), ("limit", 1, 1000)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be {low} to {high}")
        if self.freshness not in ("content", "metadata"):
            raise ValueError("freshness must be content or metadata")
        if bad := set(self.enabled) - {"php", "typescript"}:
            raise ValueError(f"no such language: {', '.join(sorted(bad))}")

    @classmethod
    def from_toml(cls, text: str) -> Config:
        """Tables are only for the reader: keys are unique over all of them."""
        found: dict = {}
        for key, value in tomllib.loads(text).items():
            found |= value if isinstance(value, dict) else {key: value}
        known = {f.name for f in fields(cls)}
        if bad := set(found) - known:
            raise ValueError(f"unknown keys: {', '.join(sorted(bad))}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items()})

    def fingerprint(self) -> str:
        """Of what changes facts: excludes in order, languages sorted, the size limit."""
        return f"exclude={list(self.exclude)!r};enabled={sorted(self.enabled)!r};max={self.max_file_size_kb}"


def discover_root(start: str, markers: tuple[str, ...] = EXCLUDED_DIRS) -> str | None:
    """The nearest directory upward that holds a marker."""
    at = os.path.realpath(start)
    while True:
        if any(os.path.exists(os.path.join(at, m)) for m in markers):
            return at
        if (up := os.path.dirname(at)) == at:
            return None
        at = up


def walk(root: str, config: Config = Config()) -> tuple[list[tuple[str, int, int]], list[str]]:
    """(path, mtime_ns, size) of regular files in byte order of paths, and escaped paths that aren't UTF-8. Symbolic
    links and nested repositories are left out, as is what ignore files or the configuration exclude."""
    found: list[tuple[str, int, int]] = []
    odd: list[str] = []

    def visit(relative: str, rules: list[tuple[str, str]]) -> None:
        here = os.path.join(root, relative)
        try:
            with open(os.path.join(here, ".gitignore"), encoding="utf-8") as f:
                rules = rules + [(relative, x.rstrip()) for x in f.read().splitlines() if x.strip() and not x.startswith("#")]
        except (FileNotFoundError, UnicodeDecodeError):
            pass
        for entry in sorted(os.scandir(here), key=lambda e: os.fsencode(e.name)):
            raw = os.fsencode(entry.name)
            path = f"{relative}/{entry.name}" if relative else entry.name
            try:
                raw.decode()
            except UnicodeDecodeError:
                odd.append("".join(c if ord(c) < 0xDC80 else f"\\x{ord(c) - 0xDC00:02X}" for c in path))
                continue
            if entry.is_symlink() or entry.name in EXCLUDED_DIRS:
                continue
            is_dir = entry.is_dir()
            if ignored(path, is_dir, rules + [("", x) for x in config.exclude]):
                continue
            if is_dir:
                if not os.path.exists(os.path.join(here, entry.name, ".git")):
                    visit(path, rules)
            elif entry.is_file():
                s = entry.stat()
                found.append((path, max(-I64, min(I64 - 1, s.st_mtime_ns)), s.st_size))

    visit("", [])
    return sorted(found, key=lambda x: x[0].encode()), odd


def read_tree(spark: SparkSession, root: str, config: Config = Config()) -> DataFrame:
    """files(path, language, mtime_ns, size, content_hash, source, parse_status) of a tree: the driver lists, executors
    read. source is null for what isn't ok; unsupported are files without an enabled extractor."""
    listed, _ = walk(root, config)
    names = spark.createDataFrame(listed, WALK_SCHEMA) if listed else spark.createDataFrame([], WALK_SCHEMA)
    base = "file:" + os.path.realpath(root).rstrip("/") + "/"
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base) if listed else spark.createDataFrame([], "path string, length long, content binary")
    read = content.select(F.expr(f"substring(path, {len(base) + 1})").alias("path"), "length", "content")
    hidden = names.where(F.col("path").rlike("(^|/)[._]")).select("path")  # Spark's readers pass over such names
    limit = config.max_file_size_kb * 1024 + 1

    def open_hidden(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                full = os.path.join(root, path)
                with open(full, "rb") as f:
                    rows.append((path, os.path.getsize(full), f.read(limit)))
            yield pd.DataFrame(rows, columns=["path", "length", "content"])

    both = read.unionByName(hidden.mapInPandas(open_hidden, "path string, length long, content binary")).dropDuplicates(["path"])
    return classified(names.join(both, "path"), config)


def classified(files: DataFrame, config: Config = Config()) -> DataFrame:
    """files with path, mtime_ns, size, length and content, classified in the order size, binary, encoding."""
    language = S.language_of(F.col("path"))
    enabled = F.coalesce(language.isin(list(config.enabled)), F.lit(False))
    status = inventory.status(F.col("length"), F.col("content"), config.max_file_size_kb * 1024)
    full = F.when((status == "ok") & ~enabled, "unsupported").otherwise(status)
    return files.select("path", language.alias("language"), "mtime_ns", "size", F.when(status.isin("ok", "binary", "encoding"), S.content_hash(F.col("content"))).alias("content_hash"), F.when(full == "ok", F.col("content")).alias("source"), full.alias("parse_status"))
