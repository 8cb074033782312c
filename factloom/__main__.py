"""python -m factloom --root TREE --store DIR (init | snippet | index | symbol Q | refs Q | context Q) [options].

Text, or with --json one JSON object; errors go to stderr with an exit code of their own."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="factloom")
    p.add_argument("--root", default=".")
    p.add_argument("--store", default=".factloom/store")
    p.add_argument("--json", action="store_true")
    c = p.add_subparsers(dest="command", required=True)
    c.add_parser("init").add_argument("--snippet-file")
    c.add_parser("snippet")
    i = c.add_parser("index")
    i.add_argument("--force", action="store_true")
    i.add_argument("--timing", action="store_true")
    i.add_argument("--freshness", choices=("content", "metadata"))
    for name in ("symbol", "refs", "context"):
        q = c.add_parser(name)
        q.add_argument("query")
        fresh = q.add_mutually_exclusive_group()
        fresh.add_argument("--freshness", choices=("content", "metadata"))
        fresh.add_argument("--no-refresh", action="store_true")
        q.add_argument("--limit", type=int, default=50)
        if name != "context":
            q.add_argument("--offset", type=int, default=0)
            q.add_argument("--min-resolution", default="scoped" if name == "symbol" else "name_match")
        if name == "symbol":
            q.add_argument("--source", action="store_true")
            q.add_argument("--signature-only", action="store_true")
        if name == "refs":
            q.add_argument("--mode", default="references")
            q.add_argument("--kind", dest="kinds", type=lambda x: x.split(","))
        if name == "context":
            q.add_argument("--tokens", type=int)
            q.add_argument("--depth", type=int)
            q.add_argument("--collapse", default="auto")
            for part in ("tests", "callers", "callees"):
                q.add_argument(f"--exclude-{part}", dest=part, action="store_false")
    return p


def main(argv: list[str] | None = None) -> int:
    options = vars(parser().parse_args(argv))
    root, store, command, as_json = (options.pop(k) for k in ("root", "store", "command", "json"))
    if command in ("init", "snippet"):
        from factloom.sources import setup

        result = setup.init(root, **options) if command == "init" else {"schema_version": 1, "snippet": setup.SNIPPET}
        sys.stdout.write(_json(result) if as_json else result.get("snippet") or "".join(f"{k}: {', '.join(result[k]) or 'nothing'}\n" for k in ("created", "modified")))
        return 0
    from pyspark.sql import SparkSession

    from factloom.api import Engine, Failure
    from factloom.text import rendered

    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    shown = _json if as_json else rendered
    try:
        sys.stdout.write(shown(getattr(Engine(spark, root, store), command)(**options)))
        return 0
    except Failure as e:
        sys.stderr.write(shown(e.object()))
        return e.exit_code


def _json(value: dict) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")) + "\n"


if __name__ == "__main__":
    sys.exit(main())
