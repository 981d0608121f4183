"""Walks over the commit graph."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.schemas import SCHEMAS


def _walk(tip: str, parents: dict[str, list[str]], dedupe: bool) -> list[tuple[str, int]]:
    """Commits from tip in depth-first order with their depth.  A commit waiting in an outer branch is told again if an inner one reached it first, unless dedupe."""
    told, seen, branches = [], set(), [(0, iter([tip]))]
    while branches:
        depth, waiting = branches[-1]
        commit = next(waiting, None)
        if commit is None:
            branches.pop()
            continue
        if commit not in parents or dedupe and commit in seen:
            continue
        seen.add(commit)
        told.append((commit, depth))
        if onward := [p for p in parents[commit] if p not in seen]:
            branches.append((depth + 1, iter(onward)))
    return told


def ref_commits(refs: DataFrame, commits: DataFrame, *, dedupe: bool = False) -> DataFrame:
    """Each ref's history: one row a commit with its depth in the walk from the ref's commit.

    Repositories are walked apart, each in one task with its hashes and parents only.  Refs that are no commit have no rows.
    """

    def walk(tips: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        parents = {c: list(p) if p is not None else [] for c, p in zip(edges.commit_hash, edges.commit_parents, strict=True)}
        rows = [(r, c, n, i) for r, n, h in zip(tips.repository_id, tips.ref_name, tips.commit_hash, strict=True) for c, i in _walk(h, parents, dedupe)]
        return pd.DataFrame(rows, columns=["repository_id", "commit_hash", "ref_name", "history_index"])

    tips = refs.select("repository_id", "ref_name", "commit_hash").groupBy("repository_id")
    edges = commits.select("repository_id", "commit_hash", "commit_parents").groupBy("repository_id")
    return tips.cogroup(edges).applyInPandas(walk, SCHEMAS["ref_commits"])


def reachable(refs: DataFrame, commits: DataFrame) -> DataFrame:
    """Commits that any ref reaches, once each: breadth first, a join a round, lineage cut as it goes.

    What was seen is kept in parts of which equally old ones are merged, so a row is written again a few times only.
    """
    key = ["repository_id", "commit_hash"]
    edges = commits.select(*key, F.explode("commit_parents").alias("parent"))
    front = refs.select(*key).join(commits.select(*key), key, "left_semi").distinct().checkpoint()
    parts, rounds = [front], 0
    while not front.isEmpty():
        onward = front.join(edges, key).select("repository_id", F.col("parent").alias("commit_hash")).distinct()
        front = onward.join(reduce(DataFrame.union, parts), key, "left_anti").checkpoint()
        parts.append(front)
        rounds += 1
        age = rounds
        while age % 2 == 0 and len(parts) > 1:
            parts[-2:] = [parts[-2].union(parts[-1]).checkpoint()]
            age //= 2
    return commits.join(reduce(DataFrame.union, parts), key, "left_semi")


def least_depth(refs: DataFrame, commits: DataFrame, *, depth: int) -> DataFrame:
    """For each ref the commits within `depth` steps with their least distance, by a recursive query."""
    spark = commits.sparkSession
    refs.createOrReplaceTempView("_walk_refs")
    commits.createOrReplaceTempView("_walk_commits")
    return spark.sql(f"""
        WITH RECURSIVE steps(repository_id, ref_name, commit_hash, depth) MAX RECURSION LEVEL {depth + 2} AS (
            SELECT repository_id, ref_name, commit_hash, 0 FROM _walk_refs
            UNION ALL
            SELECT s.repository_id, s.ref_name, e.parent, s.depth + 1
            FROM steps s JOIN (SELECT repository_id, commit_hash, explode(commit_parents) AS parent FROM _walk_commits) e
              ON s.repository_id = e.repository_id AND s.commit_hash = e.commit_hash
            WHERE s.depth < {depth}
        )
        SELECT repository_id, ref_name, commit_hash, cast(min(depth) AS bigint) AS depth FROM steps GROUP BY ALL""")
