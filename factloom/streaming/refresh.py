"""Refresh: what changed since the last snapshot is read and extracted again, everything else is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import inventory
from factloom.sources.snapshots import Conflict, SnapshotStore

ATTEMPTS = 2


def refresh(store: SnapshotStore, files: Callable[[], DataFrame], extract: Callable[[DataFrame], dict[str, DataFrame]], fingerprints: dict[str, str], metadata: bool = False, force: bool = False, link: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] | None = None) -> dict:
    """Publishes the state of files() (path, language, mtime_ns, size, content_hash, source, parse_status) and what
    extract() makes of ok files, by table with a file column, and what link() makes of all
    tables together (links are always made anew: a change anywhere may settle or unsettle them). Returns digest, updated, unchanged, deleted. A publication
    that loses a race is tried once more."""
    for attempt in range(ATTEMPTS):
        try:
            return _attempt(store, files(), extract, fingerprints, metadata, force, link)
        except Conflict:
            if attempt == ATTEMPTS - 1:
                raise
    raise AssertionError


def _attempt(store: SnapshotStore, new: DataFrame, extract, fingerprints: dict[str, str], metadata: bool, force: bool, link) -> dict:
    spark, now = new.sparkSession, store.current()
    new = new.cache()
    try:
        fresh_only = force or now is None or now["fingerprints"] != fingerprints
        old = store.read(spark, "files", pinned=now) if now is not None else new.limit(0)
        changes = inventory.difference(old, new, trust_metadata=metadata)
        counts = inventory.difference_counts(changes).first().asDict()
        if fresh_only:  # every file's facts are made anew
            counts |= {"updated": counts["updated"] + counts["unchanged"], "unchanged": 0}
        digest = inventory.snapshot_digest(new).first()["digest"]
        redo = new.where("parse_status = 'ok'")
        if not fresh_only:
            redo = redo.join(changes.where("change IN ('new', 'changed')").select("path"), "path", "left_semi")
        tables = extract(redo)
        if not fresh_only:
            same = changes.where("change = 'same'").select(F.col("path").alias("file"))
            tables = {name: store.read(spark, name, pinned=now).join(same, "file", "left_semi").unionByName(df) for name, df in tables.items()}
        tables = {"files": new.drop("source"), **tables}
        tables["sources"] = new.where("source IS NOT NULL").select(F.col("path").alias("file"), "source")
        store.publish(digest, tables, fingerprints, now["directory"] if now else None, link, force)
        return {"digest": digest, **counts}
    finally:
        new.unpersist()


def stream(changed: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """A stream of changed files (a file source with path and content) whose every batch is applied as one refresh; a batch
    that is replayed after a failure publishes the same digest again, which changes nothing."""
    writer = changed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
