"""Snapshots of fact tables: directories that are written once, and one pointer to the current one."""

from __future__ import annotations

import fcntl
import json
import os
import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

FORMAT_VERSION = "2"
WHOLE = "WHOLE"
LOCK_SECONDS = 5.0


class Conflict(RuntimeError):
    """Another writer holds the lock, or published in between."""


class Incompatible(RuntimeError):
    """A stored snapshot was made by other rules or settings."""


class SnapshotStore:
    """Tables under root/<digest>-<number>/<name>. Every publication writes a directory of its own, marks it as whole, and
    only then moves root/CURRENT by a rename: a reader that holds what current() gave keeps a whole snapshot whatever is
    published later, and what a writer left that died is never read."""

    def __init__(self, root: str) -> None:
        self.root = root
        os.makedirs(root, exist_ok=True)

    def _pointer(self) -> str:
        return os.path.join(self.root, "CURRENT")

    @contextmanager
    def lock(self, seconds: float = LOCK_SECONDS):
        """Held by the process, not by a file's presence: the system lets go of it when the writer dies."""
        path, until = os.path.join(self.root, "LOCK"), time.monotonic() + seconds
        with open(path, "a", encoding="utf-8") as f:
            while True:
                try:
                    fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                    break
                except BlockingIOError:
                    if time.monotonic() >= until:
                        raise Conflict(f"{path} is held by another writer") from None
                    time.sleep(0.05)
            yield

    def current(self) -> dict | None:
        try:
            with open(self._pointer(), encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return None

    def _next(self) -> int:
        """A number above those of all directories, whole or left behind."""
        return 1 + max((int(n) for d in os.listdir(self.root) if (n := d.rpartition("-")[2]).isdigit()), default=0)

    def publish(self, digest: str, tables: dict[str, DataFrame], fingerprints: dict[str, str], expected: str | None, link: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] | None = None, force: bool = False) -> bool:
        """Writes the tables, then what link() makes of them as written, and moves the pointer; Conflict if the current
        directory isn't the expected one any more. False if nothing changed, which force doesn't ask."""
        with self.lock():
            now = self.current()
            if (now["directory"] if now else None) != expected:
                raise Conflict("another snapshot was published")
            meta = {"digest": digest, "format": FORMAT_VERSION, "fingerprints": fingerprints}
            if not force and now is not None and meta == {k: now[k] for k in meta}:
                return False
            directory = f"{digest.replace(':', '-')}-{self._next()}"
            where = os.path.join(self.root, directory)
            for name, df in tables.items():
                df.write.parquet(os.path.join(where, name))
            if link is not None:
                written = {name: df.sparkSession.read.schema(df.schema).parquet(os.path.join(where, name)) for name, df in tables.items()}
                for name, df in link(written).items():
                    df.write.parquet(os.path.join(where, name))
            os.makedirs(where, exist_ok=True)
            meta["directory"] = directory
            for path in (os.path.join(where, WHOLE), self._pointer()):
                with open(path + ".new", "w", encoding="utf-8") as f:
                    json.dump(meta, f, sort_keys=True)
                os.replace(path + ".new", path)
            return True

    def _of_digest(self, digest: str) -> str:
        """The last whole directory of a digest."""
        start = digest.replace(":", "-") + "-"
        found = [d for d in os.listdir(self.root) if d.startswith(start) and os.path.exists(os.path.join(self.root, d, WHOLE))]
        if not found:
            raise FileNotFoundError(f"{self.root} has no snapshot {digest}")
        return max(found, key=lambda d: int(d.rpartition("-")[2]))

    def read(self, spark: SparkSession, name: str, fingerprints: dict[str, str] | None = None, digest: str | None = None, pinned: dict | None = None) -> DataFrame:
        """A table of the current snapshot, of the one that current() gave as pinned, or of the last one with a digest.
        Incompatible if fingerprints are asked for and differ."""
        now = pinned or self.current()
        if now is None and digest is None:
            raise FileNotFoundError(f"{self.root} has no snapshot")
        if fingerprints is not None and now is not None and (now["format"] != FORMAT_VERSION or now["fingerprints"] != fingerprints):
            raise Incompatible("the snapshot was made with other settings; index again")
        return spark.read.parquet(os.path.join(self.root, self._of_digest(digest) if digest else now["directory"], name))
