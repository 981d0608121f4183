"""History relations on the golden commit graph, functions on value tables, and every query against its SQL."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F
from tests.conftest import DATA

from stratalog.functions import compat, language, loc, refs
from stratalog.operators import history, relations
from stratalog.queries import ORACLES, QUERIES

# Commit, parents in order.
GRAPH = {"6ecf": ["918c"], "e8d3": ["918c"], "918c": ["af2d"], "af2d": ["1669"], "1669": ["35e8", "a5b8"], "35e8": ["b029"], "a5b8": ["b029", "b8e4"], "b8e4": ["b029"], "b029": []}
WALK = {"6ecf": 0, "918c": 1, "af2d": 2, "1669": 3, "35e8": 4, "b029": 5, "a5b8": 4, "b8e4": 5}


@pytest.fixture(scope="module")
def graph(spark):
    commits = spark.createDataFrame([("r", c, p) for c, p in GRAPH.items()], "repository_id string, commit_hash string, commit_parents array<string>")
    tips = spark.createDataFrame([("r", "HEAD", "6ecf"), ("r", "branch", "e8d3"), ("r", "odd", "no commit")], "repository_id string, ref_name string, commit_hash string")
    return tips, commits


def test_walk(graph):
    rows = history.ref_commits(*graph).collect()
    assert {r.commit_hash: r.history_index for r in rows if r.ref_name == "HEAD"} == WALK and len(rows) == 16


def test_repeated_merge(spark):
    commits = spark.createDataFrame([("r", "m", ["a", "b"]), ("r", "a", ["b"]), ("r", "b", [])], "repository_id string, commit_hash string, commit_parents array<string>")
    tip = spark.createDataFrame([("r", "x", "m")], "repository_id string, ref_name string, commit_hash string")
    told = lambda **k: sorted((r.commit_hash, r.history_index) for r in history.ref_commits(tip, commits, **k).collect())
    assert told() == [("a", 1), ("b", 1), ("b", 2), ("m", 0)] and told(dedupe=True) == [("a", 1), ("b", 2), ("m", 0)]


def test_remotes(spark):
    rows = [("r", "o", ["u"], ["f"]), ("r", "p", ["u", "v"], ["f"]), ("r", "q", ["u"], ["f", "g"]), ("r", "s", ["u"], []), ("r", "t", [], [])]
    got = relations.remotes(spark.createDataFrame(rows, "repository_id string, remote_name string, urls array<string>, fetch array<string>"))
    assert sorted((r.remote_name, r.remote_push_url, r.remote_fetch_refspec) for r in got.collect() if r.remote_push_url) == [("o", "u", "f"), ("p", "u", "f"), ("p", "v", "f"), ("q", "u", "f"), ("s", "u", "u")]
    assert got.where("remote_push_url is null and remote_fetch_refspec = 'g'").count() == 1


def test_functions(spark):
    row = spark.range(1).select(
        refs.is_tag(F.lit(None).cast("string")).alias("a"), refs.is_tag(F.lit("refs/tags/v")).alias("b"), refs.is_remote(F.lit("refs/heads/v")).alias("c"), refs.is_vendor(F.lit(".gitignore")).alias("d"),
        refs.is_vendor(F.lit("vendor/foo.go")).alias("e"), refs.is_vendor(F.lit(None).cast("string")).alias("f"), refs.is_vendor(F.lit("src/a.go")).alias("g"), language.language(F.lit("foo.rb")).alias("h"),
        language.language(F.lit("foo.foobar")).alias("i"), language.language(F.lit("foo"), F.lit("#!/usr/bin/env python\n")).alias("j"), loc.loc(F.lit("foo"), F.lit(b"#!/usr/bin/env python\n\nprint 'foo'")).alias("k"),
        loc.loc(F.lit("a.rb"), F.lit(b"")).alias("l"), compat.square_root(F.lit(-1.0)).alias("m"), compat.log_base(F.lit(1.0), F.lit(8.0)).alias("n"), compat.greatest_strict(F.lit(1), F.lit(None).cast("int")).alias("o"),
        F.concat_ws("|", compat.split_literal(F.lit("a.b"), F.lit("."))).alias("p"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f, row.g) == (False, True, False, True, True, None, False)
    assert (row.h, row.i, row.j, tuple(row.k), row.l) == ("Ruby", None, "Python", (2, 0, 1, "foo", "Python"), None)
    assert (row.m, row.n, row.o, row.p) == (None, None, None, "a|b")


def test_blob_policy(spark):
    blobs = spark.createDataFrame([(b"text", 4), (b"a\x00b", 3), (b"x" * 9, 9)], "blob_content binary, blob_size long")
    assert [bytes(r.blob_content) for r in relations.blob_policy(blobs, most_bytes=8).collect()] == [b"text", b"", b""]
    assert [bytes(r.blob_content) for r in relations.blob_policy(blobs, most_bytes=8, allow_binary=True).collect()] == [b"text", b"a\x00b", b""]


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    value = value.item() if hasattr(value, "item") else value
    return float(f"{value:.9g}") if isinstance(value, float) else value


def rows(frame):
    return sorted((tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def other_engine():
    found = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents pages conversations".split():
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return found


@pytest.mark.parametrize("name", ["scan_ref_commits", "scan_files", "top_repositories_by_commits", "commit_stats", "blame_lines", "chain_tips_to_files", "lines_per_language", "string_functions", "date_functions", "tree_of_json"])
def test_query(spark, other_engine, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(other_engine.execute(ORACLES[name]).fetchdf())


def test_long_lines_and_merges(spark):
    """A line of 21 commits with a side branch: first parents by doubling, reachable commits by rounds."""
    from stratalog.operators.blame import first_parent_line
    from stratalog.operators.history import reachable

    names = [f"c{i}" for i in range(21)]
    rows = [("r", c, f"{c}@x", [names[i - 1]] + ["side"] * (i == 9) if i else ["unknown"]) for i, c in enumerate(names)]
    rows += [("r", "side", "side@x", None), ("r", "apart", "apart@x", []), ("other", "c20", "o@x", [])]
    commits = spark.createDataFrame(rows, "repository_id string, commit_hash string, commit_author_email string, commit_parents array<string>")
    asked = spark.createDataFrame([("r", "c20"), ("r", "c5"), ("r", "missing")], "repository_id string, commit_hash string")
    line = sorted((r.commit_hash, r.step, r.ancestor, r.author) for r in first_parent_line(asked, commits).collect())
    assert line == sorted((c, i - j, names[j], f"{names[j]}@x") for c, i in (("c20", 20), ("c5", 5)) for j in range(i + 1))
    got = sorted(r.commit_hash for r in reachable(asked, commits).collect())
    assert got == sorted([*names, "side"])


def test_blame_rows_a_file(spark):
    """Files are read once, runs of a blob are one version, and no group goes to Python by itself."""
    from stratalog.operators.blame import blame

    texts = {"a": "one\ntwo\n", "b": "zero\none\nthree\ntwo\n", "e": ""}
    line = [("f", "aabba"), ("g", "bb---"), ("h", "eee--"), ("i", "a-abb")]
    commits = spark.createDataFrame([("r", f"c{i}", f"{i}@x", [f"c{i - 1}"] if i else []) for i in range(5)], "repository_id string, commit_hash string, commit_author_email string, commit_parents array<string>")
    files = spark.createDataFrame([("r", f"c{i}", name, blob) for name, blobs in line for i, blob in enumerate(blobs) if blob != "-"], "repository_id string, commit_hash string, file_path string, blob_hash string")
    blobs = spark.createDataFrame([("r", k, v.encode()) for k, v in texts.items()], "repository_id string, blob_hash string, blob_content binary")
    asked = spark.createDataFrame([("r", c, f) for c, f in (("c4", "f"), ("c3", "f"), ("c4", "g"), ("c1", "g"), ("c2", "h"), ("c4", "i"), ("c4", "none"), ("none", "f"))], "repository_id string, commit_hash string, file_path string")
    lines = blame(asked, commits, files, blobs)
    got = {}
    for r in sorted(lines.collect(), key=lambda r: r.linenum):
        got.setdefault((r.commit_hash, r.file_path), []).append((r.text, r.author))
    of = lambda authors, blob: list(zip(texts[blob].split("\n"), [f"{a}@x" for a in authors]))
    assert got == {("c4", "f"): of("00", "a"), ("c3", "f"): of("2020", "b"), ("c1", "g"): of("0000", "b"), ("c4", "i"): of("3030", "b")}
    assert "FlatMapGroupsInPandas" not in lines._jdf.queryExecution().executedPlan().toString()


def test_blame_authors_of_readme(spark, other_engine):
    got = QUERIES["blame_authors_of_readme"](spark, DATA)
    assert rows(got.toPandas()) == rows(other_engine.execute(ORACLES["blame_authors_of_readme"]).fetchdf())
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()


def test_lines_of_few_rows_and_trees_of_asked_paths(spark):
    """Short and long lines, ends that are not known; paths of files, folders, submodules and nothing, listed or not."""
    from stratalog.operators.blame import blame_in_trees, first_parent_line

    short, long = range(1000), 70
    rows = [(f"r{k}", f"r{k}c{i}", f"{i}@x", [f"r{k}c{i - 1}"] if i else [], f"r{k}t{i}") for k in short for i in range(2)]
    rows += [("long", f"c{i}", f"{i}@x", [f"c{i - 1}"], f"t{i}") for i in range(long)]  # the parent of c0 is not known
    commits = spark.createDataFrame(rows, "repository_id string, commit_hash string, commit_author_email string, commit_parents array<string>, tree_hash string")
    heads = [(f"r{k}", f"r{k}c1") for k in short] + [("long", f"c{long - 1}"), ("long", "none"), ("none", "c1")]
    told = first_parent_line(spark.createDataFrame(heads, "repository_id string, commit_hash string"), commits)
    got = sorted((r.repository_id, r.step, r.ancestor) for r in told.collect())
    assert got == sorted([(f"r{k}", 1 - i, f"r{k}c{i}") for k in short for i in range(2)] + [("long", long - 1 - i, f"c{i}") for i in range(long)])

    entries = [("long", n, f"t{i}", b, m) for i in range(long) for n, b, m in (("d", f"d{i // 20}", "40000"), ("e", "d0", "40000"), ("f", "one", "100644"), ("s", "one", "160000"))]
    entries += [("long", "f", f"d{k}", ("one", "two", "one", "two")[k], "100644") for k in range(4)] + [("long", "g", "d3", "empty", "40000")]
    entries = spark.createDataFrame(entries, "repository_id string, tree_entry_name string, tree_hash string, blob_hash string, tree_entry_mode string")
    blobs = spark.createDataFrame([("long", "one", b"1\n"), ("long", "two", b"1\n2\n")], "repository_id string, blob_hash string, blob_content binary")
    asked = [("long", f"c{long - 1}", path) for path in ("d/f", "f", "d", "s", "d/g", "d/f/f", "none", "")] + [("long", "c45", "d/f"), ("r1", "r1c1", "f")]
    asked = spark.createDataFrame(asked, "repository_id string, commit_hash string, file_path string")
    for most in (relations.FEW_PATHS, 0):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(relations, "FEW_PATHS", most)
            lines = blame_in_trees(asked, commits, entries, blobs)
        got = sorted((r.commit_hash, r.file_path, r.linenum, r.author, r.text) for r in lines.collect())
        assert got == [("c45", "d/f", 0, "0@x", "1"), ("c69", "d/f", 0, "0@x", "1"), ("c69", "d/f", 1, "60@x", "2"), ("c69", "f", 0, "0@x", "1")]
    assert blame_in_trees(asked.limit(0), commits, entries, blobs).count() == 0


def test_blame_rounds_write_jumps_only(spark, monkeypatch):
    """Neither rounds over lines nor a list of all files: README.md is looked up in the root trees."""
    from stratalog.views import History

    kind, written = type(spark.range(1)), []
    real = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a, **b: written.append(self.columns) or real(self, *a, **b))
    monkeypatch.setattr(History, "commit_files", property(lambda self: pytest.fail("all files of all commits are listed")))
    QUERIES["blame_authors_of_readme"](spark, DATA)
    assert written == [["repository_id", "ancestor", "to"]] * 4  # lines of up to 8 commits: over 1, 2, 4, and 8, of which there are none
