import json
import os
import shutil

import pytest

from factloom.api import Engine, Failure, dumps
from tests.test_sources import tree  # noqa: F401


@pytest.fixture
def engine(spark, tree, tmp_path):  # noqa: F811
    e = Engine(spark, tree, str(tmp_path / "store"))
    with pytest.raises(Failure) as none:
        e.refs("x", no_refresh=True)
    assert none.value.exit_code == 3
    e.index()
    return e


def test_commands(engine):
    again = engine.index(timing=True)
    assert list(again) == ["schema_version", "index", "symbols", "uses", "bindings", "updated", "unchanged", "deleted", "elapsed_ms"]
    assert again["updated"] == 0 and again["unchanged"] == again["index"]["coverage"]["files_seen"]
    c = again["index"]["coverage"]
    assert c["files_seen"] == c["files_indexed"] + sum(c["skipped"].values()) and c["skipped"]["parse_error"] == 1 and not c["complete"]
    assert {d["code"] for d in again["index"]["diagnostics"]["items"]} == {"parse_error", "binary_file", "invalid_encoding"}
    user = "src/User.php#App\\Model\\User"
    refs = engine.refs(user, no_refresh=True)
    assert refs["total"] == sum(refs["by_resolution"].values()) == len(refs["references"]) and refs["by_resolution"]["exact"] >= 3
    first = engine.refs(user, limit=1, no_refresh=True)
    assert first["truncated"] and first["next_offset"] == 1 and first["references"] == refs["references"][:1]
    assert json.loads(dumps(refs)) == refs
    s = engine.symbol("User::count", source=True, min_resolution="name_match", no_refresh=True)
    assert s["parent"] == user and s["source"].startswith("public function count") and s["called_by"]["total"] >= 1
    assert "calls" not in engine.symbol("User::count", signature_only=True, no_refresh=True)
    ctx = engine.context("App\\Model\\User::count", tokens=400, no_refresh=True)
    assert ctx["segments"][0]["reason"] == "target" and ctx["estimated_tokens"] == sum(x["estimated_tokens"] for x in ctx["segments"]) <= 400


@pytest.mark.parametrize(("call", "error"), [(("refs", "nothing_here"), "symbol_not_found"), (("refs", "../a:1"), "invalid_arguments"), (("symbol", "broken.php:1"), "parse_failure"), (("symbol", "x.js#a"), "unsupported_language"), (("refs", "run"), "symbol_not_found")])
def test_failures(engine, call, error):
    with pytest.raises(Failure) as e:
        getattr(engine, call[0])(call[1], no_refresh=True)
    assert e.value.error == error
    assert list(e.value.object())[:4] == ["schema_version", "error", "message", "hint"]


def test_argument_ranges(engine):
    for bad in (lambda: engine.refs("a", limit=0), lambda: engine.context("a", tokens=0 - 1), lambda: engine.refs("a", kinds=["nope"]), lambda: engine.context("a", depth=3), lambda: engine.refs("a", freshness="content", no_refresh=True)):
        with pytest.raises(Failure) as e:
            bad()
        assert e.value.exit_code == 2
    with pytest.raises(Failure) as small:
        engine.context("App\\Model\\User", tokens=1, no_refresh=True)
    assert small.value.error == "budget_too_small" and small.value.fields["required_tokens"] > 1


def test_queries_see_the_tree_as_it_is(engine, tree):  # noqa: F811
    before = engine.refs("App\\helper", no_refresh=True)
    with open(os.path.join(tree, "src", "Later.php"), "w", encoding="utf-8") as f:
        f.write("<?php\nnamespace App;\nfunction later() { return helper(); }\n")
    stale = engine.refs("App\\helper", no_refresh=True)
    assert stale["index"]["freshness"] == "cached" and stale["total"] == before["total"] and stale["index"]["snapshot"] == before["index"]["snapshot"]
    now = engine.refs("App\\helper")
    assert now["index"]["freshness"] == "content" and now["total"] == before["total"] + 1
    assert "src/Later.php" in {r["file"] for r in now["references"]} and now["index"]["snapshot"] != before["index"]["snapshot"]


def test_forced_index_restores_facts(engine):
    held, n = engine.store.current(), engine.read("symbols").count()
    where = os.path.join(engine.store.root, held["directory"], "symbols")
    engine.spark.read.parquet(where).limit(0).coalesce(1).write.parquet(where + ".gone")
    shutil.rmtree(where)
    os.rename(where + ".gone", where)
    assert engine.index()["symbols"] == 0  # nothing changed in the tree, so nothing is written
    forced = engine.index(force=True)
    assert forced["symbols"] == n and forced["unchanged"] == 0 and engine.store.current()["directory"] != held["directory"]
    assert engine.store.read(engine.spark, "files", pinned=held).count() == forced["updated"]
