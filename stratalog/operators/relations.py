"""Relations that follow from refs, commits, tree entries and blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.schemas import DIRECTORY, SUBMODULE

MAX_BLOB_BYTES = 5 << 20
SNIFFED = 8000
#: Up to so many different paths, their names narrow the tree entries before anything is joined.
FEW_PATHS = 1000


def remotes(configured: DataFrame) -> DataFrame:
    """configured: repository_id, remote_name, urls, fetch (arrays).  One row for each place in the longer array; push and
    fetch columns agree.  A missing URL is null; the last refspec stands for missing ones, and the URL if there is none."""
    places = F.sequence(F.lit(0), F.greatest(F.size("urls"), F.size("fetch"), F.lit(1)) - 1)
    rows = configured.where(F.greatest(F.size("urls"), F.size("fetch")) > 0).withColumn("i", F.explode(places))
    url = F.get("urls", F.col("i"))
    refspec = F.when(F.size("fetch") > 0, F.get("fetch", F.least(F.col("i"), F.size("fetch") - 1))).otherwise(url)
    return rows.select("repository_id", "remote_name", url.alias("remote_push_url"), url.alias("remote_fetch_url"), refspec.alias("remote_push_refspec"), refspec.alias("remote_fetch_refspec"))


def subtrees(roots: DataFrame, entries: DataFrame) -> DataFrame:
    """roots: repository_id, tree_hash.  root, tree_hash and path ('' or 'a/b/') of each tree below each root, itself first.
    One join a level of nesting; a tree that stands at two places gives two rows."""
    folders = entries.where(F.col("tree_entry_mode") == DIRECTORY).select("repository_id", F.col("tree_hash").alias("_up"), F.col("blob_hash").alias("_down"), F.col("tree_entry_name").alias("_name"))
    level = roots.select("repository_id", F.col("tree_hash").alias("root"), "tree_hash", F.lit("").alias("path"))
    found = level
    while True:
        below = level.join(folders, (level["repository_id"] == folders["repository_id"]) & (level["tree_hash"] == folders["_up"]))
        level = below.select(level["repository_id"], "root", F.col("_down").alias("tree_hash"), F.concat("path", "_name", F.lit("/")).alias("path")).checkpoint()
        if level.isEmpty():
            return found
        found = found.union(level)


def _roots(commits: DataFrame) -> DataFrame:
    return commits.select("repository_id", "tree_hash").distinct()


def commit_trees(commits: DataFrame, entries: DataFrame) -> DataFrame:
    """All trees of each commit.  Distinct root trees are walked, then joined with their commits."""
    trees = subtrees(_roots(commits), entries).select("repository_id", "root", F.col("tree_hash").alias("_tree"))
    owners = commits.select("repository_id", "commit_hash", F.col("tree_hash").alias("root"))
    return owners.join(trees, ["repository_id", "root"]).select("repository_id", "commit_hash", F.col("_tree").alias("tree_hash"))


def root_files(commits: DataFrame, entries: DataFrame) -> DataFrame:
    """repository_id, tree_hash (the root), file_path, blob_hash, tree_entry_mode of every file below each distinct root tree."""
    trees = subtrees(_roots(commits), entries)
    files = entries.where(~F.col("tree_entry_mode").isin(DIRECTORY, SUBMODULE))
    inside = trees.join(files, ["repository_id", "tree_hash"])
    return inside.select("repository_id", F.col("root").alias("tree_hash"), F.concat("path", "tree_entry_name").alias("file_path"), "blob_hash", "tree_entry_mode")


def commit_files(commits: DataFrame, entries: DataFrame) -> DataFrame:
    owners = commits.select("repository_id", "commit_hash", "tree_hash")
    return owners.join(root_files(commits, entries), ["repository_id", "tree_hash"]).select("repository_id", "commit_hash", "file_path", "blob_hash", "tree_hash")


def files_at(wanted: DataFrame, entries: DataFrame, paths: DataFrame) -> DataFrame:
    """wanted: repository_id, tree_hash (a root), file_path, which is one of those in `paths`, and columns that are kept.
    Its rows whose path is a file below the root, with blob_hash.  One join a name of the longest path; names have no slash."""
    few = [r.file_path for r in paths.select("file_path").where("file_path is not null").distinct().take(FEW_PATHS + 1)]
    parts = F.split("file_path", "/")
    if len(few) > FEW_PATHS:
        depth = paths.agg(F.max(F.size(parts))).first()[0]
    else:
        depth = max((len(path.split("/")) for path in few), default=1)
        entries = entries.where(F.col("tree_entry_name").isin(sorted({name for path in few for name in path.split("/")})))
    entries = entries.select("repository_id", F.col("tree_hash").alias("_tree"), F.col("tree_entry_name").alias("_name"), F.col("blob_hash").alias("_to"), F.col("tree_entry_mode").alias("_mode"))
    kept, found = wanted.columns, None
    rows = wanted.withColumn("_tree", F.col("tree_hash"))
    for i in range(depth):
        last, folder = F.size(parts) == i + 1, F.col("_mode") == DIRECTORY
        rows = rows.withColumn("_name", F.get(parts, F.lit(i))).join(entries, ["repository_id", "_tree", "_name"]).where(F.when(last, ~F.col("_mode").isin(DIRECTORY, SUBMODULE)).otherwise(folder))
        if i + 1 < depth:
            rows = rows.checkpoint()
        files = rows.where(last).select(*kept, F.col("_to").alias("blob_hash"))
        found = files if found is None else found.union(files)
        rows = rows.where(~last).select(*kept, F.col("_to").alias("_tree"))
    return found


def commit_blobs(files: DataFrame, *, distinct: bool = False) -> DataFrame:
    """From commit_files: a row a file, or a row a blob with `distinct`."""
    rows = files.select("repository_id", "commit_hash", "blob_hash")
    return rows.distinct() if distinct else rows


def files(commits: DataFrame, entries: DataFrame, blobs: DataFrame) -> DataFrame:
    """Files of distinct root trees with their content; modes have the leading zero that this relation shows."""
    rows = root_files(commits, entries).withColumn("tree_entry_mode", F.lpad("tree_entry_mode", 7, "0"))
    content = blobs.select("repository_id", "blob_hash", "blob_content", "blob_size")
    return rows.join(content, ["repository_id", "blob_hash"]).select("repository_id", "file_path", "blob_hash", "tree_hash", "tree_entry_mode", "blob_content", "blob_size")


def is_binary(content: Column) -> Column:
    """Whether a NUL byte stands within the first bytes."""
    return F.locate("\x00", F.substring(content, 1, SNIFFED)) > 0


def blob_policy(blobs: DataFrame, *, most_bytes: int = MAX_BLOB_BYTES, allow_binary: bool = False) -> DataFrame:
    """Content of blobs that are too large, or binary where those are not allowed, becomes empty; rows and sizes stay."""
    hidden = F.col("blob_size") > most_bytes
    if not allow_binary:
        hidden = hidden | is_binary(F.col("blob_content"))
    return blobs.withColumn("blob_content", F.when(hidden, F.lit(b"")).otherwise(F.col("blob_content")))
