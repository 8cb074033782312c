import os

import pytest
from pyspark.sql import functions as F

from factloom.operators import hierarchy, match, resolve
from factloom.sources import extract, records
from factloom.sources.repository import Config, discover_root, read_tree, walk
from factloom.sources.snapshots import Conflict, Incompatible, SnapshotStore
from factloom.streaming.refresh import refresh

PHP = """<?php
namespace App\\Model;
use App\\Base\\Thing as Other;
use function App\\helper;
/** A user. */
final class User extends Other implements \\Countable {
    const LIMIT = 10;
    private string $name = 'x';
    public function __construct(int $n = self::LIMIT) { $this->name = helper($n); }
    public function count(): int { $x = new User(); return $this->count() + User::LIMIT; }
}
function top(User $u): ?Other { return top($u); }
"""
BASE = "<?php\nnamespace App\\Base;\nclass Thing { public function go() {} }\n"
TYPED = """<?php
namespace App;
use App\\Base\\Thing;
class Holder {
    private Thing $kept;
    function a(Thing $p) { $p->go(); }
    function b(Thing $p) { $p = other(); $p->go(); }
    function c() { $x = new Thing(); $x->go(); $this->kept->go(); }
    function d($q) { if ($q) { $x = new Thing(); } $x->go(); }
    function e(Thing $p) { swap($p); $p->go(); }
    function f(Thing|Holder $p) { $p->go(); }
}
"""
LIB = "<?php\nnamespace App;\nfunction helper($x) { return $x; }\n"
TS = "import { a as b, type C } from './m';\nimport * as ns from './m';\nexport class Box {\n  size: number = 3;\n  area() { return this.size * ns.a(2) + b(1) }\n}\nfunction f(x: C, y: Box): void { f(x, y) }\n"
M = "export function a(x: number) { return x }\nexport interface C { n: number }\n"


def write(root, files):
    for path, text in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(text.encode() if isinstance(text, str) else text)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "repo"
    write(root, {"src/User.php": PHP, "src/Thing.php": BASE, "src/lib.php": LIB, "src/Typed.php": TYPED, "web/box.ts": TS, "web/m.ts": M, "broken.php": "<?php class {", "x.js": "var a", "big.ts": "//" + "x" * 3000, "zero.php": b"<?php\x00", "latin.php": b"<?php // \xe9", "skip/a.php": "<?php", ".gitignore": "skip/\n"})
    os.makedirs(root / ".git")
    os.makedirs(root / "nested/.git")
    write(root, {"nested/n.php": "<?php"})
    os.symlink(root / "x.js", root / "link.js")
    return str(root)


def test_walk_and_read(spark, tree):
    paths = [p for p, _, _ in walk(tree)[0]]
    assert paths == [".gitignore", "big.ts", "broken.php", "latin.php", "src/Thing.php", "src/Typed.php", "src/User.php", "src/lib.php", "web/box.ts", "web/m.ts", "x.js", "zero.php"]
    assert discover_root(os.path.join(tree, "src")) == tree
    got = {r["path"]: r["parse_status"] for r in read_tree(spark, tree, Config(max_file_size_kb=2)).collect()}
    assert got["big.ts"] == "size" and got["zero.php"] == "binary" and got["latin.php"] == "encoding" and got["x.js"] == "unsupported" and got["src/User.php"] == "ok"


def test_config():
    assert Config.from_toml("[index]\nexclude = ['a']\nmax_file_size_kb = 5").exclude == ("a",)
    for bad in ("nope = 1", "max_depth = 3", "freshness = 'x'"):
        with pytest.raises(ValueError):
            Config.from_toml(bad)


def facts(spark, tree):
    files = read_tree(spark, tree).cache()
    return files, extract.tables_of(extract.raw_facts(files).cache())


def test_extraction(spark, tree):
    _, t = facts(spark, tree)
    symbols = {(r["file"], r["qualified_name"], r["kind"]) for r in t["symbols"].collect()}
    assert {("src/User.php", "App\\Model\\User", "class"), ("src/User.php", "App\\Model\\User::LIMIT", "const"), ("src/User.php", "App\\Model\\User::$name", "property"), ("src/User.php", "App\\Model\\User::count", "method"), ("src/User.php", "App\\Model\\top", "function"), ("web/box.ts", "Box.area", "method"), ("web/m.ts", "C", "interface")} <= symbols
    user = t["symbols"].where("qualified_name = 'App\\\\Model\\\\User'").first()
    assert user["doc_comment"] == "/** A user. */" and user["signature"].startswith("final class User") and (user["start_line"], user["end_line"]) == (6, 11)
    assert {(r["file"], r["code"]) for r in t["diagnostics"].collect()} == {("broken.php", "parse_error")}
    spans = t["uses"].where("file = 'src/User.php'").collect()
    raw = PHP.encode()
    assert all(raw[r["start_byte"] : r["end_byte"]].decode() == r["spelling"] for r in spans)


def test_resolution(spark, tree):
    files, t = facts(spark, tree)
    links = resolve.resolve_links(t["symbols"], t["uses"], t["imports"], files.where("path LIKE 'src/%' OR path LIKE 'web/%'"), t["locals"])
    assert links.groupBy("use_id").count().where("count > 1").count() == 0
    got = {(r["file"], r["spelling"], r["ref_kind"], r["line"]): (r["target_id"], r["resolution"]) for r in t["uses"].join(links, "use_id").collect()}
    user = "src/User.php#App\\Model\\User"
    assert got["src/User.php", "Other", "type", 6] == ("src/Thing.php#App\\Base\\Thing", "exact")
    assert got["src/User.php", "helper", "call", 9] == ("src/lib.php#App\\helper", "exact")
    assert got["src/User.php", "count", "call", 10] == (user + "::count", "scoped")
    assert got["src/User.php", "name", "write", 9] == (user + "::$name", "scoped")
    assert got["src/User.php", "LIMIT", "read", 10] == (user + "::LIMIT", "scoped")
    assert ("src/User.php", "\\Countable", "type", 6) not in got
    assert got["web/box.ts", "b", "call", 5] == ("web/m.ts#a", "exact") and got["web/box.ts", "a", "call", 5] == ("web/m.ts#a", "exact")
    assert got["web/box.ts", "size", "read", 5] == ("web/box.ts#Box.size", "scoped") and got["web/box.ts", "C", "type", 7] == ("web/m.ts#C", "exact")
    typed = t["uses"].where("file = 'src/Typed.php' AND spelling = 'go'").join(links, "use_id", "left").orderBy("start_byte").collect()
    thing = "src/Thing.php#App\\Base\\Thing::go"
    assert [(r["line"], r["target_id"]) for r in typed] == [(6, thing), (7, None), (8, thing), (8, thing), (9, None), (10, None), (11, None)]
    edges = resolve.supertype_edges(t["symbols"], t["uses"], links)
    assert {(r["child"], r["relation"], r["qname"], r["parent"]) for r in edges.where("child IS NOT NULL").collect()} == {(user, "extends", "App\\Base\\Thing", "src/Thing.php#App\\Base\\Thing"), (user, "implements", "Countable", None)}
    assert [(r["ancestor"], r["depth"]) for r in hierarchy.ancestors(edges).collect()] == [("src/Thing.php#App\\Base\\Thing", 1)]
    refs = match.references(t["symbols"].where(F.col("id") == user), t["uses"], links.select("use_id", "target_id", "resolution"))
    assert refs.where("resolution = 'exact'").count() >= 3


def test_snapshots_and_refresh(spark, tree, tmp_path):
    store = SnapshotStore(str(tmp_path / "store"))
    run = lambda force=False, prints={"rules": "1"}: refresh(store, lambda: read_tree(spark, tree), extract.fact_tables, prints, force=force)  # noqa: B006, E731
    first = run()
    assert (first["updated"], first["unchanged"], first["deleted"]) == (12, 0, 0)
    assert run() == {**first, "updated": 0, "unchanged": 12}
    write(tree, {"src/lib.php": LIB + "function more() {}\n", "src/New.php": "<?php class Fresh {}"})
    os.unlink(os.path.join(tree, "web/m.ts"))
    second = run()
    assert (second["updated"], second["unchanged"], second["deleted"]) == (2, 10, 1)
    rows = lambda: sorted(tuple(map(str, r)) for r in store.read(spark, "symbols").select("id", "start_byte", "kind", "parent_id").collect())
    incremental = rows()
    assert run(prints={"rules": "2"})["digest"] == second["digest"] and rows() == incremental
    assert len(store.read(spark, "symbols", digest=first["digest"]).where("file = 'web/m.ts'").collect()) > 0
    with pytest.raises(Incompatible):
        store.read(spark, "symbols", {"rules": "other"})
    with pytest.raises(Conflict):
        store.publish("sha256:x", {}, {}, "sha256:other")


def test_records(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"a": 1}\n\nnot json\n{"b": 2}\n')
    events, counts = records.read_json_lines(spark, str(tmp_path / "t.jsonl"))
    assert events.count() == 2 and tuple(counts.select("n", "n_invalid").first()) == (3, 1)
    (tmp_path / "a.csv").write_text("id,x\nok-1,2\nbad value,3\n")
    rows = records.read_tokens_csv(spark, str(tmp_path / "a.csv"), "id string, x int", ["id"])
    with pytest.raises(Exception, match="bad id"):
        rows.collect()
