"""Commands over one source tree: index, symbol, refs, context. Results are plain objects in the order they are printed.

    python -m factloom --root TREE --store DIR refs 'App\\Model\\User' --limit 10

Argument errors come before any file is touched; every failure is a Failure with a name, an exit code and its fields.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import globs
from factloom.functions import scalars as S
from factloom.operators import context, inventory, lookup, match, resolve
from factloom.sources import extract
from factloom.sources.repository import Config, read_tree
from factloom.sources.snapshots import Conflict, Incompatible, SnapshotStore
from factloom.streaming.refresh import refresh

SCHEMA_VERSION = 1
TOKENIZER = "utf8-bytes-v1"
RULES_VERSION = "php-2;typescript-1"
#: Fixed values.
EXIT_CODES = {"general": 1, "invalid_arguments": 2, "repository_unavailable": 3, "symbol_not_found": 4, "ambiguous_symbol": 5, "parse_failure": 6, "unsupported_language": 7, "budget_too_small": 8, "repository_changed": 9}
SYMBOL_KEYS = ("id", "name", "qualified_name", "kind", "language", "file", "start_byte", "end_byte", "start_line", "end_line", "content_hash")
REFERENCE_KEYS = ("file", "content_hash", "start_byte", "end_byte", "line", "column", "containing_symbol", "ref_kind", "resolution", "resolved_target", "receiver")
CALL_LIST_KEYS = ("total", "truncated", "next_offset", "hidden_name_match", "items")
FORMS = {"auto": ("full", "signature"), "always": ("signature",), "never": ("full",)}


class Failure(Exception):
    def __init__(self, error: str, message: str, hint: str, **fields) -> None:
        super().__init__(message)
        self.error, self.fields, self.hint = error, fields, hint

    @property
    def exit_code(self) -> int:
        return EXIT_CODES[self.error]

    def object(self) -> dict:
        return {"schema_version": SCHEMA_VERSION, "error": self.error, "message": str(self), "hint": self.hint, **self.fields}


def dumps(value: dict) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")) + "\n"


def _check(name: str, value: int, low: int, high: int) -> None:
    if not low <= value <= high:
        raise Failure("invalid_arguments", f"{name} must be {low} to {high}", "See the ranges of the options.")


class Engine:
    """A tree, its snapshots, and queries on them. A query brings the snapshot up to date first, unless it is told not to,
    then pins it: all that it reads is of one snapshot, whatever is published meanwhile."""

    def __init__(self, spark: SparkSession, root: str, store: str, config: Config = Config()) -> None:
        self.spark, self.root, self.config = spark, root, config
        self.store = SnapshotStore(store)
        self.fingerprints = {"config": config.fingerprint(), "extractor": extract.RULES, "resolver": RULES_VERSION}
        self.pinned: dict | None = None
        self.verified = "cached"

    # index

    def index(self, force: bool = False, freshness: str | None = None, timing: bool = False) -> dict:
        began = time.monotonic()
        done = self._refresh(freshness, force)
        t = {n: self.read(n).count() for n in ("symbols", "uses", "bindings")}
        out = {"schema_version": SCHEMA_VERSION, "index": self.block(), **t, **{k: done[k] for k in ("updated", "unchanged", "deleted")}}
        return out | ({"elapsed_ms": int((time.monotonic() - began) * 1000)} if timing else {})

    def _refresh(self, freshness: str | None, force: bool = False) -> dict:
        """Publishes the tree as it is now and pins what is current then."""
        mode = freshness or self.config.freshness
        if mode not in ("content", "metadata"):
            raise Failure("invalid_arguments", f"no such freshness: {mode}", "Freshness is content or metadata.")
        try:
            done = refresh(self.store, lambda: read_tree(self.spark, self.root, self.config), extract.fact_tables, self.fingerprints, mode == "metadata", force, link=self._link)
        except Conflict as e:
            raise Failure("repository_changed", str(e), "Run again when nothing else writes.") from e
        self.pinned, self.verified = self.store.current(), mode
        return done

    def _acquire(self, query: str, freshness: str | None, no_refresh: bool) -> None:
        """The snapshot that a query reads: of the tree as it is now, or with no_refresh the last one as it is."""
        if no_refresh and freshness:
            raise Failure("invalid_arguments", "freshness and no-refresh exclude each other", "Give one of them.")
        self._check_query(query)
        if no_refresh:
            self.pinned, self.verified = self.store.current(), "cached"
        else:
            self._refresh(freshness)

    @staticmethod
    def _check_query(query: str) -> None:
        try:
            lookup.file_line(query)
        except ValueError as e:
            raise Failure("invalid_arguments", str(e), "Give a path inside the tree and a line from 1.") from e

    @staticmethod
    def _link(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        return {"bindings": resolve.resolve_links(tables["symbols"], tables["uses"], tables["imports"], tables["files"], tables["locals"])}

    def read(self, name: str) -> DataFrame:
        try:
            return self.store.read(self.spark, name, self.fingerprints, pinned=self.pinned)
        except (FileNotFoundError, Incompatible) as e:
            raise Failure("repository_unavailable", str(e), "Run index first.") from e

    def files(self) -> DataFrame:
        """Inventory whose status also knows of files that couldn't be parsed."""
        bad = self.read("diagnostics").groupBy(F.col("file").alias("path")).agg(F.min("code").alias("code"))
        return self.read("files").join(bad, "path", "left").withColumn("parse_status", F.coalesce("code", "parse_status")).drop("code")

    def block(self) -> dict:
        """Snapshot, coverage and the first diagnostics."""
        files = self.files()
        c = inventory.coverage(files).first().asDict()
        skipped = {k: c[k] for k in ("unsupported", "binary", "size", "encoding", "parse_error", "resource_limit")}
        parsed = self.read("diagnostics").select("file", "code", "detail", "start_byte")
        named = {"size": ("file_too_large", "exceeds max_file_size_kb"), "binary": ("binary_file", "holds a NUL byte"), "encoding": ("invalid_encoding", "not UTF-8")}
        rest = files.where(F.col("parse_status").isin(*named))
        pick = lambda k: F.element_at(F.create_map(*(F.lit(x) for s, v in named.items() for x in (s, v[k]))), F.col("parse_status"))
        every = parsed.unionByName(rest.select(F.col("path").alias("file"), pick(0).alias("code"), pick(1).alias("detail"), F.lit(None).cast("long").alias("start_byte")))
        items = [{k: r[k] for k in ("file", "code", "detail")} | ({"start_byte": r["start_byte"]} if r["start_byte"] is not None else {}) for r in inventory.first_diagnostics(every).collect()]
        total = every.count()
        return {"snapshot": self.pinned["digest"], "freshness": self.verified, "coverage": {"complete": c["complete"], "files_seen": c["seen"], "files_indexed": c["indexed"], "skipped": skipped}, "diagnostics": {"total": total, "truncated": total > len(items), "items": items}}

    # targets

    def symbols(self) -> DataFrame:
        hashes = self.read("files").select(F.col("path").alias("file"), "content_hash")
        return self.read("symbols").join(hashes, "file", "left")

    def resolve(self, query: str, limit: int = 50, offset: int = 0) -> dict:
        """The one symbol that a query names, as a dict of its columns."""
        self._check_query(query)
        symbols = self.symbols()
        form, found = lookup.resolve(symbols, query)
        n = found.count()
        if n == 1:
            return found.first().asDict()
        if n == 0:
            self._refuse_unindexed(query.split("#", 1)[0] if "#" in query else (lookup.file_line(query) or ("",))[0])
            near = [r["qualified_name"] for r in lookup.suggestions(symbols, query).collect()]
            raise Failure("symbol_not_found", f"no symbol matches {query!r}", "Try one of the suggestions.", suggestions=near)
        page = found.orderBy(*lookup.symbol_order()).offset(offset).limit(limit).collect()
        raise Failure("ambiguous_symbol", f"query {query!r} matched {n} symbols", "Run again with one of the ids.", total=n, truncated=n > len(page), next_offset=offset + limit if n > offset + limit else None, candidates=[_symbol(r.asDict()) for r in page])

    def _refuse_unindexed(self, path: str) -> None:
        row = self.files().where(F.col("path") == path).first() if path else None
        if row is None or row["parse_status"] == "ok":
            return
        if row["parse_status"] == "unsupported":
            raise Failure("unsupported_language", f"{path} has no extractor", "Ask for a PHP or TypeScript file.", file=path, language=row["language"])
        if row["parse_status"] in ("parse_error", "resource_limit"):
            raise Failure("parse_failure", f"{path} has no facts", "Correct the file and index again.", file=path, detail=row["parse_status"])
        raise Failure("repository_unavailable", f"{path} isn't indexed: {row['parse_status']}", "Change the limits or the file.")

    # references

    def _matches(self, target: dict, mode: str, kinds: list[str] | None) -> tuple[DataFrame, dict]:
        """(matches without what evidence excludes, counts of that)."""
        one = self.symbols().where(F.col("id") == target["id"])
        links = self.read("bindings").select("use_id", "target_id", "resolution")
        found = match.references(one, self.read("uses"), links, mode, kinds)
        first = match.first_per_site(found)
        if mode == "candidates" or target["language"] != "php":
            return first, {"incompatible_form": 0, "unrelated_receiver": 0}
        parent = target["parent_id"] and self.symbols().where(F.col("id") == target["parent_id"]).first()
        in_class = F.lit(bool(parent) and parent["kind"] in resolve.CLASS_KINDS)
        wrong = (F.col("resolution") == "name_match") & ~match.form_compatible(F.lit(target["kind"]), F.col("ref_kind"), F.col("receiver").isNotNull(), in_class)
        return first.where(~wrong), {"incompatible_form": first.where(wrong).count(), "unrelated_receiver": 0}

    def _objects(self, page: DataFrame) -> list[dict]:
        rows = page.orderBy(*match.reference_order()).collect()  # a page, at most 1,000 rows
        files = {r["file"] for r in rows}
        hashes = {r["path"]: r["content_hash"] for r in self.read("files").where(F.col("path").isin(*files)).select("path", "content_hash").collect()} if files else {}
        ids = {r["containing_symbol"] for r in rows if r["containing_symbol"]}
        inside = {r["id"]: _symbol(r.asDict()) for r in self.symbols().where(F.col("id").isin(*ids)).collect()} if ids else {}
        out = []
        for r in rows:
            d = r.asDict() | {"content_hash": hashes.get(r["file"]), "column": r["col"], "containing_symbol": inside.get(r["containing_symbol"])}
            out.append({k: d[k] for k in REFERENCE_KEYS})
        return out

    def refs(self, query: str, mode: str = "references", kinds: list[str] | None = None, min_resolution: str = "name_match", limit: int = 50, offset: int = 0, freshness: str | None = None, no_refresh: bool = False) -> dict:
        self._validate(limit, offset, min_resolution)
        if mode not in ("references", "candidates") or set(kinds or ()) - set(S.REF_KINDS):
            raise Failure("invalid_arguments", "no such mode or kind", "Modes are references and candidates.")
        self._acquire(query, freshness, no_refresh)
        target = self.resolve(query, limit, offset)
        found, excluded = self._matches(target, mode, kinds)
        found = found.where(S.at_least(F.col("resolution"), min_resolution)).cache()
        by = {r["resolution"]: r["count"] for r in found.groupBy("resolution").count().collect()}
        total = sum(by.values())
        page = self._objects(found.orderBy(*match.reference_order()).offset(offset).limit(limit))
        found.unpersist()
        return {"schema_version": SCHEMA_VERSION, "index": self.block(), "symbol": _symbol(target), "mode": mode, "total": total, "truncated": total > len(page), "next_offset": offset + limit if total > offset + limit else None, "by_resolution": {k: by.get(k, 0) for k in S.RESOLUTIONS}, "by_exclusion": excluded, "references": page}

    def symbol(self, query: str, min_resolution: str = "scoped", limit: int = 50, offset: int = 0, source: bool = False, signature_only: bool = False, freshness: str | None = None, no_refresh: bool = False) -> dict:
        self._validate(limit, offset, min_resolution)
        if source and signature_only:
            raise Failure("invalid_arguments", "source and signature-only exclude each other", "Give one of them.")
        self._acquire(query, freshness, no_refresh)
        target = self.resolve(query, limit, offset)
        out = {"schema_version": SCHEMA_VERSION, "index": self.block(), "symbol": _symbol(target), "signature": target["signature"], "doc_comment": target["doc_comment"], "parent": target["parent_id"]}
        if not signature_only:
            links = self.read("bindings").select("use_id", "target_id", "resolution")
            calls = match.bound_uses(self.read("uses").where((F.col("containing_symbol") == target["id"]) & (F.col("ref_kind") == "call")), links)
            calls = calls.withColumnRenamed("target_id", "resolved_target").withColumn("resolution", F.coalesce("resolution", F.lit("name_match")))
            callers, _ = self._matches(target, "references", ["call"])
            out |= {name: self._call_list(df, min_resolution, limit, offset) for name, df in (("calls", calls), ("called_by", callers))}
        if source:
            out["source"] = self._slice(target)
        return out

    def _call_list(self, rows: DataFrame, minimum: str, limit: int, offset: int) -> dict:
        shown = S.at_least(F.col("resolution"), minimum)
        n = rows.agg(F.count_if(shown).alias("total"), F.count_if(~shown & (F.col("resolution") == "name_match")).alias("hidden")).first()
        items = self._objects(rows.where(shown).orderBy(*match.reference_order()).offset(offset).limit(limit))
        values = (n["total"], n["total"] > len(items), offset + limit if n["total"] > offset + limit else None, n["hidden"], items)
        return dict(zip(CALL_LIST_KEYS, values, strict=True))

    def _slice(self, symbol: dict) -> str:
        row = self.read("sources").where(F.col("file") == symbol["file"]).select(S.span_bytes(F.col("source"), F.lit(symbol["start_byte"]), F.lit(symbol["end_byte"])).alias("b")).first()
        return bytes(row["b"]).decode()

    # context

    def context(self, query: str, tokens: int | None = None, depth: int | None = None, collapse: str = "auto", tests: bool = True, callers: bool = True, callees: bool = True, limit: int = 50, freshness: str | None = None, no_refresh: bool = False) -> dict:
        tokens, depth = tokens or self.config.token_budget, depth or self.config.max_depth
        _check("tokens", tokens, 1, 1_000_000)
        _check("depth", depth, 1, 2)
        self._validate(limit, 0, "name_match")
        if collapse not in FORMS:
            raise Failure("invalid_arguments", "collapse is auto, always or never", "Choose one of them.")
        self._acquire(query, freshness, no_refresh)
        target = self.resolve(query, limit)
        symbols, uses = self.symbols().cache(), self.read("uses")
        links = self.read("bindings").select("use_id", "target_id", "resolution")
        is_test = lambda path: globs.matches_any(path, list(self.config.test_globs))
        ranked = context.traversal(symbols, uses, links, symbols.where(F.col("id") == target["id"]).select("id"), depth, test_file=is_test)
        unwanted = [r for r, keep in (("test", tests), ("caller", callers), ("callee", callees)) if not keep]
        rows = ranked.where(~F.col("reason").isin(*unwanted) if unwanted else F.lit(True)).join(symbols, "id").orderBy("rank").collect()  # at most 1,000 candidates
        candidates = [target | {"reason": "target", "resolution": "exact"}, *(r.asDict() for r in rows)]
        spans = self.spark.createDataFrame([(c["id"], c["file"], c["start_byte"], c["end_byte"]) for c in candidates], "id string, file string, start_byte long, end_byte long")
        text = {r["id"]: bytes(r["b"]).decode() for r in spans.join(self.read("sources"), "file").select("id", S.span_bytes(F.col("source"), F.col("start_byte"), F.col("end_byte")).alias("b")).collect()}
        symbols.unpersist()
        cost = lambda s: (len(s.encode()) + 2) // 3
        taken: list[dict] = []
        omitted = {"budget": 0, "overlap": 0, "limit": 0}
        used = 0
        for c in candidates:
            shown = {"full": text.get(c["id"], ""), "signature": c["signature"] or c["name"]}
            fits = [(f, shown[f]) for f in FORMS[collapse] if used + cost(shown[f]) <= tokens]
            if c["reason"] == "target" and not fits:
                raise Failure("budget_too_small", "the symbol itself doesn't fit", "Raise the budget.", budget_tokens=tokens, required_tokens=min(cost(shown[f]) for f in FORMS[collapse]))
            if any(t["file"] == c["file"] and t["form"] == "full" and t["start_byte"] <= c["start_byte"] and c["end_byte"] <= t["end_byte"] for t in taken):
                omitted["overlap"] += 1
            elif len(taken) >= limit:
                omitted["limit"] += 1
            elif not fits:
                omitted["budget"] += 1
            else:
                taken.append(c | {"form": fits[0][0], "source": fits[0][1]})
                used += cost(fits[0][1])
        segments = [{"symbol": _symbol(c), "form": c["form"], "reason": c["reason"], "resolution": c["resolution"], "estimated_tokens": cost(c["source"]), "source": c["source"]} for c in taken]
        return {"schema_version": SCHEMA_VERSION, "index": self.block(), "symbol": _symbol(target), "budget_tokens": tokens, "estimated_tokens": used, "tokenizer": TOKENIZER, "budget_scope": "source", "segments": segments, "omitted": omitted, "candidate_limit_reached": len(rows) >= context.CANDIDATE_CAP}

    @staticmethod
    def _validate(limit: int, offset: int, min_resolution: str) -> None:
        _check("limit", limit, 1, 1000)
        _check("offset", offset, 0, 2**31)
        if min_resolution not in S.RESOLUTIONS:
            raise Failure("invalid_arguments", f"no such resolution: {min_resolution}", "Resolutions are exact, scoped and name_match.")


def _symbol(row: dict) -> dict:
    return {k: row[k] for k in SYMBOL_KEYS}
