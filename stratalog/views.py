"""History-shaped relations over stored tables, and their registration as views."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.operators import history, relations
from stratalog.schemas import DIRECTORY, SCHEMAS


@dataclass
class History:
    """Base tables, from which the other relations follow when they are asked for."""

    refs: DataFrame
    commits: DataFrame
    tree_entries: DataFrame
    blobs: DataFrame
    configured_remotes: DataFrame

    @cached_property
    def repositories(self) -> DataFrame:
        return self.refs.select("repository_id").union(self.configured_remotes.select("repository_id")).distinct()

    @cached_property
    def remotes(self) -> DataFrame:
        return relations.remotes(self.configured_remotes)

    @cached_property
    def ref_commits(self) -> DataFrame:
        return history.ref_commits(self.refs, self.commits)

    @cached_property
    def commit_trees(self) -> DataFrame:
        return relations.commit_trees(self.commits, self.tree_entries)

    @cached_property
    def commit_files(self) -> DataFrame:
        return relations.commit_files(self.commits, self.tree_entries)

    @cached_property
    def commit_blobs(self) -> DataFrame:
        return relations.commit_blobs(self.commit_files)

    @cached_property
    def files(self) -> DataFrame:
        return relations.files(self.commits, self.tree_entries, self.blobs)

    def register(self, *names: str) -> None:
        for name in names or SCHEMAS:
            getattr(self, name).createOrReplaceTempView(name)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return turns.withColumn("repository_id", F.concat(F.lit("conv/"), "conv_id"))


def conversations_history(spark: SparkSession, sf_dir: str, *, merges: bool = True) -> History:
    """Conversations as repositories: a turn is a commit on the one before (and with `merges`, every third also on the one
    before that), which changes chat.txt and notes/role.txt beside fixed files."""
    turns = _turns(spark, sf_dir)
    commit = lambda t: F.sha1(F.concat("conv_id", F.lit(":"), t))
    t = F.col("turn")
    second = F.lit(merges) & (t >= 2) & (t % 3 == 0)
    parents = F.when(t == 0, F.array().cast("array<string>")).when(second, F.array(commit(t - 1), commit(t - 2))).otherwise(F.array(commit(t - 1)))
    when = F.expr("timestamp'2024-01-01 00:00:00' + conv_id * interval '1' day + turn * interval '7' hour")
    email = F.concat("role", F.lit("@mail"), F.col("conv_id") % 3, F.lit(".example.com"))
    commits = turns.select(
        "repository_id",
        commit(t).alias("commit_hash"),
        F.col("role").alias("commit_author_name"),
        email.alias("commit_author_email"),
        when.alias("commit_author_when"),
        F.col("role").alias("committer_name"),
        email.alias("committer_email"),
        when.alias("committer_when"),
        F.col("text").alias("commit_message"),
        F.sha1(F.concat(F.lit("tree:"), "conv_id", F.lit(":"), t)).alias("tree_hash"),
        parents.alias("commit_parents"),
    )
    last = turns.groupBy("repository_id", "conv_id").agg(F.max("turn").alias("turn"))
    tip, first = commit(F.col("turn")), commit(F.lit(0))
    named = F.array(*[F.struct(F.lit(n).alias("ref_name"), h.alias("commit_hash")) for n, h in (("HEAD", tip), ("refs/heads/main", tip), ("refs/tags/v0", first), ("refs/remotes/origin/old", commit(F.greatest(F.col("turn") - 1, F.lit(0)))))])
    refs = last.select("repository_id", F.inline(named))
    role_tree = F.sha1(F.concat(F.lit("notes:"), "conv_id", F.lit(":"), "role"))
    deep_tree = F.sha1(F.concat(F.lit("deep:"), "conv_id"))
    root = F.sha1(F.concat(F.lit("tree:"), "conv_id", F.lit(":"), t))
    readme, source = F.concat(F.lit("# conv "), "conv_id", F.lit("\n")), F.lit("package main\n\n// start\nfunc main() {}\n")
    entry = lambda tree, name, target, mode: F.struct(tree.alias("tree_hash"), F.lit(name).alias("tree_entry_name"), target.alias("blob_hash"), F.lit(mode).alias("tree_entry_mode"))
    listed = F.array(
        entry(root, "chat.txt", F.sha1("text"), "100644"),
        entry(root, "README.md", F.sha1(readme), "100644"),
        entry(root, "notes", role_tree, DIRECTORY),
        entry(role_tree, "role.txt", F.sha1("role"), "100644"),
        entry(role_tree, "deep", deep_tree, DIRECTORY),
        entry(deep_tree, "main.go", F.sha1(source), "100755"),
    )
    entries = turns.select("repository_id", F.inline(listed)).distinct().select("repository_id", "tree_entry_name", "blob_hash", "tree_hash", "tree_entry_mode")
    contents = turns.select("repository_id", F.explode(F.array("text", readme, "role", source)).alias("content")).distinct()
    blobs = contents.select("repository_id", F.sha1("content").alias("blob_hash"), F.octet_length("content").cast("long").alias("blob_size"), F.col("content").cast("binary").alias("blob_content"))
    base = F.concat(F.lit("https://git.example.com/"), "repository_id", F.lit(".git"))
    urls = F.when(F.col("conv_id") % 2 == 0, F.array(base, F.replace(base, F.lit("https:"), F.lit("ssh:")))).otherwise(F.array(base))
    fetch = F.when(F.col("conv_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("+refs/heads/*:refs/remotes/origin/*")))
    configured = last.select("repository_id", F.lit("origin").alias("remote_name"), urls.alias("urls"), fetch.alias("fetch"))
    return History(refs, commits, entries, blobs, configured)
