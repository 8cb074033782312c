import os

import pytest

from factloom import text
from factloom.sources import setup
from factloom.sources.repository import Config


def test_init_twice(tmp_path):
    root = str(tmp_path)
    (tmp_path / "NOTES.md").write_text("# Notes\n")
    first = setup.init(root, "NOTES.md")
    assert first["created"] == [".factloom/", ".factloom/config.toml", ".gitignore"] and first["modified"] == ["NOTES.md"]
    assert setup.init(root, "NOTES.md") == {"schema_version": 1, "created": [], "modified": [], "snippet_file": "NOTES.md"}
    assert (tmp_path / "NOTES.md").read_text() == "# Notes\n\n" + setup.SNIPPET
    Config.from_toml((tmp_path / ".factloom" / "config.toml").read_text())
    assert (tmp_path / ".gitignore").read_text() == ".factloom/\n"
    with pytest.raises(ValueError):
        setup.init(root, "../x")


def test_managed_block():
    assert setup.with_block("a\n" + setup.BEGIN + "old" + setup.END + "\nb\n") == "a\n" + setup.SNIPPET + "b\n"
    for bad in (setup.BEGIN, setup.END + setup.BEGIN, setup.SNIPPET * 2):
        with pytest.raises(ValueError):
            setup.with_block(bad)


def _snapshot(seen, indexed, skipped=(), reports=(), total=None):
    total = len(reports) if total is None else total
    skips = dict.fromkeys(text.SKIP_ORDER, 0) | dict(skipped)
    return {"coverage": {"complete": seen == indexed, "files_seen": seen, "files_indexed": indexed, "skipped": skips}, "diagnostics": {"total": total, "truncated": total > len(reports), "items": [{"file": f, "code": c} for f, c in reports]}}


def test_coverage_lines():
    assert text.coverage_line(_snapshot(4, 4)) is None
    assert text.coverage_line(_snapshot(37, 31, {"size": 2, "binary": 4})) == "coverage incomplete: 31/37 files indexed; skipped 4 binary, 2 size; 0 diagnostics"
    assert text.coverage_line(_snapshot(4, 4, reports=[("lib/Pump.php", "encoding_error")])) == "coverage complete: 4/4 files indexed; 1 diagnostic: lib/Pump.php (encoding_error)"
    two = [("web/gate.ts", "parse_error"), ("web/valve.ts", "resource_limit")]
    assert text.coverage_line(_snapshot(8, 6, reports=two)).endswith("indexed; 2 diagnostics: web/gate.ts (parse_error), web/valve.ts (resource_limit)")
    five = [(f"m{k}.ts", code) for k, code in enumerate(["b_code", "a_code", "c_code", "c_code", "a_code"])]
    assert text.coverage_line(_snapshot(9, 4, reports=five)).endswith("; 5 diagnostics (2 a_code, 2 c_code, 1 b_code)")
    assert text.coverage_line(_snapshot(90, 4, reports=five, total=77)).endswith("; 77 diagnostics (first 5: 2 a_code, 2 c_code, 1 b_code)")


def test_columns_and_pages():
    assert text.columns([("a", "bb", "c"), ("aaa", "b", "")]) == ["a    bb  c", "aaa  b"]
    assert text.page_line(3, 3, 0, None) is None
    assert text.page_line(1200, 50, 50, 100) == "51-100 of 1,200 shown; next offset 100"
    assert os.linesep and text.rendered({"error": "general", "message": "m", "hint": "h"}) == "error: m\nhint: h\n"
