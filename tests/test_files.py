"""Reading file trees, hidden names included."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from auditlake.functions.prune import Pruner
from auditlake.model import ScanOptions
from auditlake.operators.match import find, scan
from auditlake.operators.paths import wanted_path
from auditlake.operators.summary import summarize
from auditlake.sources import tree, walk
from auditlake.sources.tables import union_targets

KEY = "AK" + "IA" + "C" * 16


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("files") / "proj"
    texts = {
        ".env": f"id={KEY}\n", "_conf.yml": "a: b\n", ".cfg/x.yml": "a: b\n", "deep/.a/.b/c": "x",
        ".git/config": KEY, "node_modules/i.js": KEY, "sub/vendor/a.py": KEY, "sub/build": KEY,
        "a.PNG": KEY, "go.sum": KEY, "yarn.lock": KEY, "x.svg": KEY,
        "src/a.go": "package a\n", "srcfoo/b.go": "package b\n", "src/t/c.min.js": "x\n",
        "empty": "", "plain": "x",
    }
    for name, text in texts.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text(text)
    (base / "bad.txt").write_bytes(b"\xff\x41\n" + KEY.encode())
    (base / "max.txt").write_bytes(b"x" * 10_485_760)
    (base / "over.txt").write_bytes(b"x" * 10_485_761)
    os.symlink(base / "plain", base / "link")
    os.symlink(base / "nowhere", base / "broken")
    os.symlink(base / "src", base / "linkdir")
    return str(base)


def names(frame, root):
    return sorted(os.path.relpath(r.path, root) for r in frame.select("path").collect())


def test_walk(spark, root):
    expected = sorted([
        ".env", "_conf.yml", ".cfg/x.yml", "deep/.a/.b/c", "src/a.go", "srcfoo/b.go", "empty",
        "plain", "bad.txt", "max.txt",
    ])
    assert names(tree.read_tree(spark, root), root) == expected


def test_globs_and_symlinks(spark, root):
    options = ScanOptions(excludes=("src/**",), includes=("*.go", "link"), mode="intent")
    assert names(tree.read_tree(spark, f"{root}/", options), root) == ["srcfoo/b.go"]
    kept = tree.read_tree(spark, root, ScanOptions(includes=("src/**",), excludes=()))
    assert names(kept, root) == ["src/a.go", "src/t/c.min.js"]
    options = ScanOptions(excludes=(f"{root}/src**",), includes=("*.go", "link"), mode="reference")
    assert names(tree.read_tree(spark, root, options), root) == []
    kept = tree.read_tree(spark, root, ScanOptions(includes=("link*",)), follow_symlinks=True)
    assert names(kept, root) == ["link"]


def test_roots_are_appended_and_may_be_excluded(spark, root):
    roots = [f"{root}/src", f"{root}/src", f"{root}/.git", f"{root}/plain"]
    got = names(tree.read_tree(spark, roots), root)
    assert got == ["plain", "src/a.go", "src/a.go"]


def test_missing_roots_are_errors(spark, root):
    for missing in (f"{root}/none", f"file://{root}/none"):
        with pytest.raises(FileNotFoundError, match="none"):
            tree.read_tree(spark, missing)


def test_relative_roots(spark, root, monkeypatch):
    """Globs go by the path below the root; a walk from ``.`` spells paths without it."""
    monkeypatch.chdir(root)
    intent = tree.read_tree(spark, ".", ScanOptions(includes=("src/**",)))
    assert [r.path for r in intent.select("path").collect()] == [f"{root}/src/a.go"]
    options = ScanOptions(includes=("src/**",), mode="reference")
    spelt = tree.read_tree(spark, ".", options).select("path").collect()
    assert sorted(r.path for r in spelt) == ["src/a.go", "srcfoo/b.go"]
    spelt = tree.read_tree(spark, "./src", ScanOptions(mode="reference")).select("path").collect()
    assert "src/a.go" in {r.path for r in spelt}


def test_addresses_are_read_like_mounts(spark, root):
    plain = set(names(tree.read_tree(spark, root), root))
    # Stores have no links of their own; this one follows them.
    assert set(names(tree.read_tree(spark, f"file://{root}"), root)) - {"link", "linkdir/a.go"} == plain
    found = {os.path.relpath(r.file_path, root) for r in find(tree.read_tree(spark, f"file://{root}")).collect()}
    assert found == {".env", "bad.txt"}


def test_listing_is_the_same_in_many_rounds(spark, root, monkeypatch):
    whole = names(tree.list_tree(spark, root), root)
    made = []
    monkeypatch.setattr(walk, "stored", lambda rows, name, real=walk.stored: made.append(name) or real(rows, name))
    start = tree.root_of(root)
    for step in (1, 3):
        listing = walk.walk(spark, start, step=step)
        assert names(walk.files(listing, start), root) == whole
        assert {r.kind: r.entries for r in walk.counts(listing).collect()}["entered"] == 9
    assert len(made) >= 6


def test_unreadable_folders_are_counted(spark, tmp_path, monkeypatch):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "f").write_text("x")
    real = walk.entries

    def broken(folder, store=None):
        if folder.endswith("/a"):
            raise PermissionError(folder)
        return real(folder, store)

    monkeypatch.setattr(walk, "entries", broken)
    rows = list(walk._walk_below(str(tmp_path), walk.Root(str(tmp_path)), None, str(tmp_path)))
    assert [(kind, os.path.basename(path)) for kind, path, _ in rows] == [("entered", tmp_path.name), ("unreadable", "a")]


GLOBS = ("src/**", "**/t/**", "*.go", "deep/*/.b/**", "deep/**/c", "sr*", "src", "**/x", "d**p/x", ".cfg/*", "s?c/t/*", "[a-s]rc/**", "bad[", "**")


@pytest.mark.parametrize("mode", ["intent", "reference"])
def test_pruned_walks_find_what_filters_keep(spark, root, mode):
    """Every pair of globs, against paths tried one by one."""
    paths = [n for n in names(tree.list_tree(spark, root), root)]
    folders = sorted({p.rsplit("/", i)[0] for p in paths for i in range(1, p.count("/") + 1)})
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    keeps = {(kind, g): {r.path for r in frame.filter(wanted_path(F.col("path"), **{kind: (g,)}, mode=mode)).collect()} for g in GLOBS for kind in ("excludes", "includes")}
    cut = 0
    for (kind, glob), kept in keeps.items():
        pruner = Pruner(**{kind: (glob,)}, mode=mode)
        for folder in folders:
            if not pruner.enters(folder):
                cut += 1
                assert not [p for p in kept if p.startswith(f"{folder}/")], (kind, glob, folder)
    assert cut > 10
    assert Pruner(includes=("src/**",), mode=mode).enters("src") and not Pruner(includes=("src/**",), mode=mode).enters("deep")
    assert not Pruner(excludes=("src/**",), mode=mode).enters("src")


def test_cut_folders_are_not_entered(spark, root):
    for mode, given in (("intent", "src"), ("reference", f"{root}/src")):
        options = ScanOptions(excludes=(f"{given}/**",), includes=(), mode=mode)
        start = tree.root_of(root, options)
        rows = {(r.kind, os.path.relpath(r.path, root)) for r in walk.walk(spark, start).collect()}
        assert ("cut", "src") in rows and not any(p.startswith("src/") for _, p in rows)
        assert ("entered", ".") in rows and ("entered", "deep/.a/.b") in rows


def test_scan_and_metadata(spark, root):
    targets = tree.read_tree(spark, root)
    found = {(os.path.relpath(r.file_path, root), r.start_line) for r in find(targets).collect()}
    assert found == {(".env", 1), ("bad.txt", 2)}
    metadata = {os.path.relpath(r.path, root): r.metadata for r in targets.collect()}
    assert metadata["max.txt"] == {"size": "10.0 MB", "extension": ".txt"}
    assert metadata[".env"]["extension"] == ".env"


def test_binary_file_source_agrees_but_for_hidden_files(spark, root):
    every = set(names(tree.read_tree(spark, root), root))
    hidden = {n for n in every if any(p[0] in "._" for p in n.split("/"))}
    frame = tree.read_binary(spark, root)
    # Spark's source follows links and gives no row for an empty file.
    assert set(names(frame, root)) - {"link", "linkdir/a.go"} == every - hidden - {"empty"}
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,10485760)" in plan


def test_nothing_to_scan_is_a_row_of_zeros(spark, root):
    targets = tree.read_tree(spark, f"{root}/.git")
    row = summarize(scan(targets)).first().asDict()
    assert set(row.values()) == {0} and len(row) == 9


def test_union_keeps_copies(spark, root):
    targets = tree.read_tree(spark, f"{root}/.env")
    assert find(union_targets(targets, targets)).count() == 2


def test_rounds_have_tasks_for_their_open_folders_only(spark, tmp_path, monkeypatch):
    chain = tmp_path.joinpath(*"abcdef")
    chain.mkdir(parents=True)
    (chain / "x.txt").write_text("x")
    tasks = []
    monkeypatch.setattr(walk, "stored", lambda rows, name, real=walk.stored: tasks.append(rows.rdd.getNumPartitions()) or real(rows, name))
    found = walk.walk(spark, walk.Root(str(tmp_path)), tasks=64, step=1)
    assert [r.path for r in found.collect() if r.kind == walk.FILE] == [str(chain / "x.txt")]
    assert len(tasks) == 7 and max(tasks) <= walk.TASKS_A_FOLDER


def test_a_text_under_several_names_is_one_file(spark, tmp_path):
    from auditlake.plans import fixtures

    rows = spark.createDataFrame(
        [("a/1", "x", ["b/c/1", "d/1"]), ("a/2", None, []), ("a/1", "x", ["b/c/1", "d/1"])],
        "path string, content string, also array<string>",
    ).coalesce(1)
    told = fixtures.write_files(rows, f"file://{tmp_path}/t")
    texts = {p: open(f"{tmp_path}/t/{p}").read() for p in ("a/1", "a/2", "b/c/1", "d/1")}
    assert told == 7 and texts == {"a/1": "x", "a/2": "", "b/c/1": "x", "d/1": "x"}
    assert sum(len(names) for _, _, names in os.walk(f"{tmp_path}/t")) == 4
    assert len({os.stat(f"{tmp_path}/t/{p}").st_ino for p in ("a/1", "b/c/1", "d/1")}) == 1


def test_a_tree_takes_an_inode_for_each_text(spark):
    """A disk has so many inodes; the tree of a large table has to leave some."""
    from auditlake.plans import fixtures

    sf = "/root/testdata/sf0.001"
    top = fixtures.file_tree(spark, sf).removeprefix("file://").removeprefix("file:")
    found = [os.stat(f"{at}/{name}") for at, _, names in os.walk(top) for name in names]
    customers, documents = (spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("customer", "documents"))
    assert len(found) == 3 * customers + documents
    assert len({f.st_ino for f in found}) == customers + documents


def test_small_files_are_handed_on_in_bounded_batches(tmp_path, monkeypatch):
    import pandas as pd

    paths = [f"{tmp_path}/{i:02d}" for i in range(25)]
    for path in paths:
        with open(path, "w") as file:
            file.write("x")
    given = pd.DataFrame({"path": paths, "shown": paths, "size": [1] * len(paths)})
    monkeypatch.setattr(tree, "_BATCH_FILES", 10, raising=False)
    got = list(tree._read_files(str(tmp_path), iter([given])))
    assert [len(part) for part in got] == [10, 10, 5]
    assert [p for part in got for p in part["path"]] == paths


def test_projects_of_a_wide_tree_by_any_address(spark, tmp_path, monkeypatch):
    """Whether the shared folder is spelt ``file:/`` or ``file:///``."""
    from auditlake.plans import fixtures, queries

    def written(session, _):
        made = f"file://{tmp_path}/tree-1"
        for n, at in enumerate(("wide/1.txt", "deep/0/1/c1.conf", "old0/skip/c1.conf", "other/c1.conf")):
            rows = session.createDataFrame([(at, f"id={KEY}\n" * (n + 1))], "path string, content string")
            fixtures.write_files(rows, made)
        return made

    monkeypatch.setattr(fixtures, "file_tree", written)
    got = sorted(tuple(r) for r in queries.tree_wide(spark, "").collect())
    assert {r[0]: r[2] for r in got} == {"wide": 1, "deep": 2}
