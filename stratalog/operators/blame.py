"""Blame: for each line of a file at a commit, who brought it in, along first parents."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.operators import relations

_FILE = ["repository_id", "commit_hash", "file_path"]
_BLAME = "repository_id string, commit_hash string, file_path string, linenum int, author string, text string"


def _steps(asked: DataFrame, commits: DataFrame) -> DataFrame:
    """repository_id, commit_hash, step, ancestor: the first parents of each asked commit, itself first; an end may be unknown.

    Jumps over 1, 2, 4, ... commits are made until none is left. Lines then take the longest jumps first, so that short lines
    are a row until the last rounds, and no round reads again what others found.
    """
    key = ["repository_id", "ancestor"]
    parent = commits.select("repository_id", F.col("commit_hash").alias("ancestor"), F.get("commit_parents", F.lit(0)).alias("to")).where("to is not null")
    jump = parent.join(asked.select("repository_id").distinct(), "repository_id", "left_semi").select(*key, "to").checkpoint()
    jumps = []
    while not jump.isEmpty():
        jumps.append(jump)
        on = jump.select("repository_id", F.col("ancestor").alias("to"), F.col("to").alias("end"))
        jump = jump.join(on, ["repository_id", "to"]).select(*key, F.col("end").alias("to")).checkpoint()
    found = asked.select("repository_id", "commit_hash", F.col("commit_hash").alias("ancestor")).distinct().withColumn("step", F.lit(0))
    for i in reversed(range(len(jumps))):
        here, there = F.struct("ancestor", "step"), F.struct(F.col("to").alias("ancestor"), (F.col("step") + F.lit(1 << i)).alias("step"))
        found = found.join(jumps[i], key, "left").select("repository_id", "commit_hash", F.inline(F.when(F.col("to").isNull(), F.array(here)).otherwise(F.array(here, there))))
    return found


def first_parent_line(asked: DataFrame, commits: DataFrame) -> DataFrame:
    """asked: repository_id, commit_hash.  Each asked commit's first-parent ancestors, itself first: step, ancestor, author."""
    known = commits.select("repository_id", F.col("commit_hash").alias("ancestor"), F.col("commit_author_email").alias("author"))
    return _steps(asked, commits).join(known, ["repository_id", "ancestor"]).select("repository_id", "commit_hash", "step", "ancestor", "author")


def _attribute(versions: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Line and author, from author and content of one file's versions, the oldest first."""
    old: list[tuple[str, str]] = []
    last = None
    for author, content in versions:
        if content == last:
            continue
        last = content
        now = content.split("\n")
        if now[-1] == "":
            now.pop()
        if not old:
            old = [(line, author) for line in now]
            continue
        match = difflib.SequenceMatcher(None, [x[0] for x in old], now, autojunk=False)
        fresh: list[tuple[str, str]] = []
        for what, a, b, c, d in match.get_opcodes():
            fresh += old[a:b] if what == "equal" else [(line, author) for line in now[c:d]]
        old = fresh
    return old


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of files, each with all its versions in one row."""
    for batch in batches:
        for start in range(0, len(batch), 500):
            rows = []
            for repository, commit, path, versions in zip(*(c.to_pylist() for c in batch.slice(start, 500).columns), strict=True):
                rows += [(repository, commit, path, i, author, line) for i, (line, author) in enumerate(_attribute([(v["author"], v["content"]) for v in versions]))]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 3 else pa.string()) for k, c in enumerate(columns)], names=["repository_id", "commit_hash", "file_path", "linenum", "author", "text"])


def blame(asked: DataFrame, commits: DataFrame, files: DataFrame, blobs: DataFrame) -> DataFrame:
    """asked: repository_id, commit_hash, file_path.  A row a line; unknown repositories, commits and files have none."""
    line = first_parent_line(asked, commits)
    held = files.select("repository_id", F.col("commit_hash").alias("ancestor"), "file_path", "blob_hash")
    return _told(asked.select(*_FILE).distinct().join(line, ["repository_id", "commit_hash"]).join(held, ["repository_id", "ancestor", "file_path"]), blobs)


def blame_in_trees(asked: DataFrame, commits: DataFrame, entries: DataFrame, blobs: DataFrame) -> DataFrame:
    """As blame, by tree entries: of the trees of a line only the asked paths are looked up, no others are listed."""
    known = commits.select("repository_id", F.col("commit_hash").alias("ancestor"), F.col("commit_author_email").alias("author"), "tree_hash")
    line = _steps(asked, commits).join(known, ["repository_id", "ancestor"]).drop("ancestor")
    return _told(relations.files_at(asked.select(*_FILE).distinct().join(line, ["repository_id", "commit_hash"]), entries, asked), blobs)


def _told(seen: DataFrame, blobs: DataFrame) -> DataFrame:
    """Lines of files from seen: repository_id, commit_hash, file_path, step, author, blob_hash.

    Runs of the same blob are one version before contents are joined; Python gets a row a file, with its versions up to the commit.
    """
    seen = seen.select(*_FILE, "step", "author", "blob_hash")
    file = Window.partitionBy(*_FILE)
    before, present = F.lag("blob_hash").over(file.orderBy(F.desc("step"))), F.min("step").over(file) == 0
    changed = seen.select("*", (~before.eqNullSafe(F.col("blob_hash"))).alias("new"), present.alias("present")).where("new and present")
    content = blobs.select("repository_id", "blob_hash", F.col("blob_content").cast("string").alias("content"))
    versions = changed.join(content, ["repository_id", "blob_hash"]).groupBy(*_FILE).agg(F.array_sort(F.collect_list(F.struct((-F.col("step")).alias("at"), "author", "content"))).alias("versions"))
    return versions.mapInArrow(_lines, _BLAME)


def as_json(lines: DataFrame) -> DataFrame:
    """One row a file with its lines as an array of JSON texts, in order."""
    row = F.struct("linenum", F.to_json(F.struct("linenum", "author", "text")).alias("j"))
    grouped = lines.groupBy("repository_id", "commit_hash", "file_path").agg(F.array_sort(F.collect_list(row)).alias("x"))
    return grouped.select("repository_id", "commit_hash", "file_path", F.transform("x", lambda y: y["j"]).alias("blame"))
