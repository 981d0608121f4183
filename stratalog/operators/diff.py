"""Line statistics of commits: signed counts of lines, so moved lines cost nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions.language import by_name
from stratalog.functions.loc import MARKS, line_kinds, lines
from stratalog.functions.refs import is_vendor
from stratalog.operators.relations import is_binary

KINDS = ("Code", "Comment", "Blank", "Other")


def pairs_with_parent(commits: DataFrame) -> DataFrame:
    """repository_id, commit_hash, from_hash: each commit and its first parent (null without one)."""
    return commits.select("repository_id", "commit_hash", F.get("commit_parents", F.lit(0)).alias("from_hash"))


def _sides(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """Files that differ between the two commits: path, and the blob on each side."""
    held = files.select("repository_id", F.col("commit_hash").alias("_c"), "file_path", "blob_hash")
    new = pairs.join(held, (pairs["repository_id"] == held["repository_id"]) & (pairs["commit_hash"] == held["_c"])).select(pairs["repository_id"], "commit_hash", "from_hash", "file_path", F.col("blob_hash").alias("new"))
    old = pairs.join(held, (pairs["repository_id"] == held["repository_id"]) & (pairs["from_hash"] == held["_c"])).select(pairs["repository_id"], "commit_hash", "from_hash", "file_path", F.col("blob_hash").alias("old"))
    key = ["repository_id", "commit_hash", "file_path"]
    both = new.drop("from_hash").join(old.drop("from_hash"), key, "full")
    return both.where(~F.col("new").eqNullSafe(F.col("old")) & ~is_vendor(F.col("file_path")))


def _file_lines(changed: DataFrame, blobs: DataFrame) -> DataFrame:
    """For each distinct (path's language, blob) its lines with their kind and count; binary blobs have none."""
    name = F.coalesce(by_name(F.col("file_path")), F.lit(""))
    used = changed.select("repository_id", name.alias("lang"), F.explode(F.array("new", "old")).alias("blob_hash")).where("blob_hash is not null").distinct()
    text = used.join(blobs.select("repository_id", "blob_hash", "blob_content"), ["repository_id", "blob_hash"]).where(~is_binary(F.col("blob_content")))
    plain = F.transform(lines(F.col("blob_content")), lambda x: F.struct(x.alias("line"), F.lit("other").alias("kind")))
    kinds = F.when(F.col("lang").isin(*MARKS), line_kinds(F.col("blob_content"), F.col("lang"))).otherwise(plain)
    placed = text.select("repository_id", "lang", "blob_hash", F.posexplode(kinds).alias("at", "x"))
    # The kind of a line is that of its last place.
    return placed.groupBy("repository_id", "lang", "blob_hash", F.col("x.line").alias("line")).agg(F.count("*").alias("n"), F.max_by("x.kind", "at").alias("kind"))


def commit_file_stats(pairs: DataFrame, files: DataFrame, blobs: DataFrame) -> DataFrame:
    """For each (repository_id, commit_hash, from_hash) of pairs and file that differs: Path, Language and, for each kind of line
    and in total, additions and deletions.  Vendored files are left out; binary files count nothing and have no language."""
    changed = _sides(pairs, files).withColumn("lang", F.coalesce(by_name(F.col("file_path")), F.lit(""))).checkpoint()
    held = _file_lines(changed, blobs)
    key = ["repository_id", "commit_hash", "file_path", "lang"]
    side = lambda column, sign: changed.select(*key, F.col(column).alias("blob_hash")).join(held, ["repository_id", "lang", "blob_hash"]).select(*key, "line", (F.col("n") * sign).alias("n"), F.when(F.lit(sign > 0), F.col("kind")).alias("new_kind"), F.when(F.lit(sign < 0), F.col("kind")).alias("old_kind"))
    net = side("new", 1).unionByName(side("old", -1)).groupBy(*key, "line").agg(F.sum("n").alias("n"), F.coalesce(F.max("new_kind"), F.max("old_kind")).alias("kind"))

    def total(condition: Column, sign: int) -> Column:
        return F.coalesce(F.sum(F.when(condition & (F.col("n") * sign > 0), F.col("n") * sign)), F.lit(0)).cast("long")

    def both(name: str, condition: Column) -> list[Column]:
        return [total(condition, 1).alias(f"{name}_additions"), total(condition, -1).alias(f"{name}_deletions")]

    counts = [c for kind in KINDS for c in both(kind.lower(), F.col("kind") == kind.lower())] + both("total", F.lit(True))
    summed = net.groupBy(*key).agg(*counts)
    names = [f"{k.lower()}_{x}" for k in (*KINDS, "total") for x in ("additions", "deletions")]
    joined = changed.select(*key).join(summed, key, "left")
    return joined.select("repository_id", "commit_hash", "file_path", F.when(F.col("total_additions").isNotNull(), F.col("lang")).otherwise("").alias("language"), *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])


def commit_stats(pairs: DataFrame, files: DataFrame, blobs: DataFrame) -> DataFrame:
    """Sums of commit_file_stats for each commit, with the number of files; commits that change nothing have zeros."""
    each = commit_file_stats(pairs, files, blobs)
    names = [c for c in each.columns if c.endswith(("_additions", "_deletions"))]
    summed = each.groupBy("repository_id", "commit_hash").agg(F.count("*").alias("files"), *[F.sum(n).alias(n) for n in names])
    joined = pairs.select("repository_id", "commit_hash").join(summed, ["repository_id", "commit_hash"], "left")
    return joined.select("repository_id", "commit_hash", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("files", *names)])


def as_json(stats: DataFrame) -> DataFrame:
    """repository_id, commit_hash and stats, the JSON text of the counts by kind."""
    kind = lambda k: F.struct(F.col(f"{k.lower()}_additions").alias("Additions"), F.col(f"{k.lower()}_deletions").alias("Deletions")).alias(k)
    return stats.select("repository_id", "commit_hash", F.to_json(F.struct(F.col("files").alias("Files"), *map(kind, (*KINDS, "Total")))).alias("stats"))
