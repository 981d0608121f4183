"""Queries over history-shaped relations and stored tables, each with the SQL that another engine checks it by.

Most are one SQL text over the relations: here the relations come from the operators of this package (walks, tree
descents, ...), in the check from closed forms over `conversations`.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions import compat, language, loc, refs, tree
from stratalog.operators import blame, diff, history, relations
from stratalog.plans.chain import chain
from stratalog.plans.indexes import Indexes
from stratalog.schemas import SCHEMAS
from stratalog.views import History, conversations_history

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The relations in closed form, for the checking engine.
CLOSED_FORM = """
turns AS (SELECT conv_id, turn, role, text, concat('conv/', conv_id) AS repository_id, sha1(concat(conv_id, ':', turn)) AS commit_hash,
                 sha1(concat('tree:', conv_id, ':', turn)) AS tree_hash FROM conversations),
tips AS (SELECT repository_id, conv_id, max(turn) AS last FROM turns GROUP BY repository_id, conv_id),
places AS (SELECT repository_id, conv_id, 'HEAD' AS ref_name, last AS tip FROM tips
           UNION ALL SELECT repository_id, conv_id, 'refs/heads/main', last FROM tips
           UNION ALL SELECT repository_id, conv_id, 'refs/tags/v0', 0 FROM tips
           UNION ALL SELECT repository_id, conv_id, 'refs/remotes/origin/old', greatest(last - 1, 0) FROM tips),
repositories AS (SELECT DISTINCT repository_id FROM turns),
refs AS (SELECT repository_id, ref_name, sha1(concat(conv_id, ':', tip)) AS commit_hash FROM places),
commits AS (SELECT repository_id, commit_hash, role AS commit_author_name, concat(role, '@mail', conv_id % 3, '.example.com') AS commit_author_email,
                   TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL '1' DAY + turn * INTERVAL '7' HOUR AS commit_author_when,
                   role AS committer_name, concat(role, '@mail', conv_id % 3, '.example.com') AS committer_email,
                   TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL '1' DAY + turn * INTERVAL '7' HOUR AS committer_when,
                   text AS commit_message, tree_hash,
                   CASE WHEN turn = 0 THEN 0 WHEN turn >= 2 AND turn % 3 = 0 THEN 2 ELSE 1 END AS n_parents FROM turns),
ref_commits AS (SELECT t.repository_id, t.commit_hash, p.ref_name, CAST(p.tip - t.turn AS BIGINT) AS history_index
                FROM turns t JOIN places p ON t.conv_id = p.conv_id AND t.turn <= p.tip
                UNION ALL
                SELECT u.repository_id, u.commit_hash, p.ref_name, CAST(p.tip - t.turn + 1 AS BIGINT)
                FROM turns t JOIN places p ON t.conv_id = p.conv_id AND t.turn <= p.tip JOIN turns u ON u.conv_id = t.conv_id AND u.turn = t.turn - 2
                WHERE t.turn % 3 = 0 AND t.turn >= 3),
listed AS (SELECT repository_id, tree_hash, 'chat.txt' AS tree_entry_name, sha1(text) AS blob_hash, '100644' AS tree_entry_mode FROM turns
           UNION SELECT repository_id, tree_hash, 'README.md', sha1(concat('# conv ', conv_id, chr(10))), '100644' FROM turns
           UNION SELECT repository_id, tree_hash, 'notes', sha1(concat('notes:', conv_id, ':', role)), '40000' FROM turns
           UNION SELECT repository_id, sha1(concat('notes:', conv_id, ':', role)), 'role.txt', sha1(role), '100644' FROM turns
           UNION SELECT repository_id, sha1(concat('notes:', conv_id, ':', role)), 'deep', sha1(concat('deep:', conv_id)), '40000' FROM turns
           UNION SELECT repository_id, sha1(concat('deep:', conv_id)), 'main.go', sha1(concat('package main', chr(10), chr(10), '// start', chr(10), 'func main() {}', chr(10))), '100755' FROM turns),
tree_entries AS (SELECT repository_id, tree_entry_name, blob_hash, tree_hash, tree_entry_mode FROM listed),
commit_trees AS (SELECT repository_id, commit_hash, tree_hash FROM turns
                 UNION ALL SELECT repository_id, commit_hash, sha1(concat('notes:', conv_id, ':', role)) FROM turns
                 UNION ALL SELECT repository_id, commit_hash, sha1(concat('deep:', conv_id)) FROM turns),
commit_files AS (SELECT repository_id, commit_hash, 'chat.txt' AS file_path, sha1(text) AS blob_hash, tree_hash FROM turns
                 UNION ALL SELECT repository_id, commit_hash, 'README.md', sha1(concat('# conv ', conv_id, chr(10))), tree_hash FROM turns
                 UNION ALL SELECT repository_id, commit_hash, 'notes/role.txt', sha1(role), tree_hash FROM turns
                 UNION ALL SELECT repository_id, commit_hash, 'notes/deep/main.go', sha1(concat('package main', chr(10), chr(10), '// start', chr(10), 'func main() {}', chr(10))), tree_hash FROM turns),
commit_blobs AS (SELECT repository_id, commit_hash, blob_hash FROM commit_files),
contents AS (SELECT repository_id, text AS content FROM turns UNION SELECT repository_id, role FROM turns
             UNION SELECT repository_id, concat('# conv ', conv_id, chr(10)) FROM turns
             UNION SELECT repository_id, concat('package main', chr(10), chr(10), '// start', chr(10), 'func main() {}', chr(10)) FROM turns),
blobs AS (SELECT repository_id, sha1(content) AS blob_hash, CAST(strlen(content) AS BIGINT) AS blob_size, content AS blob_content FROM contents),
files AS (SELECT DISTINCT f.repository_id, f.file_path, f.blob_hash, f.tree_hash, CASE WHEN f.file_path LIKE '%.go' THEN '0100755' ELSE '0100644' END AS tree_entry_mode, b.blob_content, b.blob_size
          FROM commit_files f JOIN blobs b ON f.repository_id = b.repository_id AND f.blob_hash = b.blob_hash)
"""


def _closed(sql: str) -> str:
    return f"WITH {CLOSED_FORM} {sql}"


def _relations(spark: SparkSession, sf_dir: str, text: str = "") -> History:
    """The relations; those that `text` names are registered as views, contents as text, which the queries match."""
    spark.sparkContext.setCheckpointDir(_shared(spark))
    held = conversations_history(spark, sf_dir)
    for name in set(SCHEMAS) & set(re.findall(r"\w+", text)):
        rows = getattr(held, name)
        if name in ("blobs", "files"):
            rows = rows.withColumn("blob_content", F.col("blob_content").cast("string"))
        elif name == "commits":
            rows = rows.withColumn("n_parents", F.size("commit_parents"))
        rows.createOrReplaceTempView(name)
    if text:
        compat.register(spark)
    return held


def _shared(spark: SparkSession) -> str:
    """The folder that executors share; a temporary one only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return found or tempfile.mkdtemp(prefix="spark-checkpoint-")


def _sql(name: str, text: str, check: str | None = None) -> None:
    """A query over the relations by SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _relations(spark, sf_dir, text)
        return spark.sql(text)

    QUERIES[name] = run
    ORACLES[name] = _closed(check or text)


def query(check: str | None, *, closed: bool = True) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if check is not None:
            ORACLES[f.__name__] = _closed(check) if closed else check
        return f

    return add


# Scans.
_sql("scan_repositories", "SELECT repository_id FROM repositories")
_sql("scan_refs", "SELECT repository_id, ref_name, commit_hash FROM refs")
_sql(
    "scan_commits",
    "SELECT repository_id, commit_hash, commit_author_name, commit_author_email, unix_timestamp(commit_author_when) AS author_epoch, committer_email, commit_message, tree_hash, CAST(n_parents AS INT) AS n_parents FROM commits",
    "SELECT repository_id, commit_hash, commit_author_name, commit_author_email, CAST(epoch(commit_author_when) AS BIGINT) AS author_epoch, committer_email, commit_message, tree_hash, CAST(n_parents AS INT) AS n_parents FROM commits",
)
for _name, _columns in {
    "ref_commits": "repository_id, commit_hash, ref_name, history_index",
    "commit_trees": "repository_id, commit_hash, tree_hash",
    "commit_blobs": "repository_id, commit_hash, blob_hash",
    "commit_files": "repository_id, commit_hash, file_path, blob_hash, tree_hash",
    "tree_entries": "repository_id, tree_entry_name, blob_hash, tree_hash, tree_entry_mode",
    "blobs": "repository_id, blob_hash, blob_size, blob_content",
    "files": "repository_id, file_path, blob_hash, tree_hash, tree_entry_mode, blob_content, blob_size",
}.items():
    _sql(f"scan_{_name}", f"SELECT {_columns} FROM {_name}")


@query(
    """, c AS (SELECT repository_id, concat('https://git.example.com/', repository_id, '.git') AS u, conv_id FROM tips),
    r AS (SELECT repository_id, u AS url, CASE WHEN conv_id % 5 = 0 THEN u ELSE '+refs/heads/*:refs/remotes/origin/*' END AS spec FROM c
          UNION ALL SELECT repository_id, replace(u, 'https:', 'ssh:'), CASE WHEN conv_id % 5 = 0 THEN replace(u, 'https:', 'ssh:') ELSE '+refs/heads/*:refs/remotes/origin/*' END FROM c WHERE conv_id % 2 = 0)
    SELECT repository_id, 'origin' AS remote_name, url AS remote_push_url, url AS remote_fetch_url, spec AS remote_push_refspec, spec AS remote_fetch_refspec FROM r"""
)
def scan_remotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relations(spark, sf_dir).remotes


# Histories, authors and files.
_sql("last_messages_in_head", "SELECT c.repository_id, c.commit_message FROM refs r JOIN commits c ON r.repository_id = c.repository_id AND r.commit_hash = c.commit_hash WHERE r.ref_name = 'HEAD'")

def _history_of(spark: SparkSession, sf_dir: str, *path: str) -> DataFrame:
    """A chain of relations from HEAD on."""
    return chain(_relations(spark, sf_dir), *path, where={path[0]: "ref_name = 'HEAD'"})


def _first_ten(rows: DataFrame, by: str) -> DataFrame:
    return rows.orderBy(F.desc(by), "repository_id").limit(10)


@query("SELECT t.text AS commit_message FROM ref_commits w JOIN turns t ON t.repository_id = w.repository_id AND t.commit_hash = w.commit_hash WHERE w.ref_name = 'HEAD'")
def messages_in_head_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history_of(spark, sf_dir, "ref_commits", "commits").select("commit_message")


# A history of turns 0 to n tells each once, and every third from 3 on, a merge, tells one more.
@query("SELECT repository_id, CAST(last + 1 + last // 3 AS BIGINT) AS commit_count FROM tips ORDER BY commit_count DESC, repository_id LIMIT 10")
def top_repositories_by_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    walked = _relations(spark, sf_dir).ref_commits.where("ref_name = 'HEAD'")
    return _first_ten(walked.groupBy("repository_id").agg(F.count("*").alias("commit_count")), "commit_count")


@query("SELECT repository_id, count(DISTINCT role) AS contributor_count FROM turns GROUP BY repository_id ORDER BY contributor_count DESC, repository_id LIMIT 10")
def top_repositories_by_contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    authors = _relations(spark, sf_dir).commits.groupBy("repository_id").agg(F.count_distinct("commit_author_email").alias("contributor_count"))
    return _first_ten(authors, "contributor_count")


@query("SELECT b.repository_id, f.file_path, b.blob_content FROM tips p JOIN turns t ON t.conv_id = p.conv_id AND t.turn = p.last JOIN commit_files f ON f.repository_id = t.repository_id AND f.commit_hash = t.commit_hash JOIN blobs b ON b.repository_id = f.repository_id AND b.blob_hash = f.blob_hash")
def files_of_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history_of(spark, sf_dir, "refs", "commit_files", "files").select("repository_id", "file_path", F.col("blob_content").cast("string").alias("blob_content"))


@query("SELECT repository_id, CAST(4 * (last + 1 + last // 3) AS BIGINT) AS num_files FROM tips ORDER BY num_files DESC, repository_id LIMIT 10")
def top_repositories_by_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _history_of(spark, sf_dir, "ref_commits", "commit_files", "files")
    return _first_ten(told.groupBy("repository_id").agg(F.count("file_path").alias("num_files")), "num_files")


@query("SELECT repository_id AS id, concat(role, '@mail', conv_id % 3, '.example.com') AS author, count(*) AS num_commits FROM turns GROUP BY ALL")
def top_committers_per_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _relations(spark, sf_dir).commits.groupBy(F.col("repository_id").alias("id"), F.col("commit_author_email").alias("author"))
    return made.agg(F.count("*").alias("num_commits")).orderBy(F.desc("num_commits"))


@query("SELECT concat(role, '@mail', conv_id % 3, '.example.com') AS author, count(*) AS num_commits FROM turns GROUP BY ALL")
def top_committers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relations(spark, sf_dir).commits.groupBy(F.col("commit_author_email").alias("author")).agg(F.count("*").alias("num_commits")).orderBy(F.desc("num_commits"))


@query("SELECT count(*) AS n FROM turns WHERE role <> 'user' OR conv_id % 3 <> 1")
def count_with_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relations(spark, sf_dir).commits.where(~(F.col("commit_author_email") == "user@mail1.example.com")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT t.repository_id FROM tips p JOIN turns t ON t.conv_id = p.conv_id AND t.turn = p.last JOIN listed l ON l.tree_hash = t.tree_hash WHERE lower(l.tree_entry_name) IN ('readme', 'readme.md', 'readme.txt')")
def has_readme(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _history_of(spark, sf_dir, "refs", "commits", "tree_entries")
    return entries.where(F.col("tree_entry_name").rlike(r"(?i)^readme(\.\w+)?$")).select("repository_id").distinct()


@query("SELECT commit_hash, 4 * count(*) AS n FROM ref_commits WHERE ref_name = 'HEAD' GROUP BY commit_hash")
def blobs_per_head_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history_of(spark, sf_dir, "ref_commits", "commits", "commit_blobs").groupBy("commit_hash").agg(F.count("blob_hash").alias("n"))


@query("SELECT * FROM (SELECT commit_hash, count(*) AS num FROM ref_commits GROUP BY ALL) WHERE num > 1")
def commits_in_many_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relations(spark, sf_dir).ref_commits.groupBy("commit_hash").agg(F.count("*").alias("num")).where("num > 1")


@query("SELECT repository_id, commit_hash, CASE WHEN turn > 2 AND turn % 3 = 0 THEN 'Merge' ELSE 'Commit' END AS commit_type FROM turns")
def merge_or_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.size("commit_parents") > 1, "Merge").otherwise("Commit")
    return _relations(spark, sf_dir).commits.select("repository_id", "commit_hash", kind.alias("commit_type"))


_WHEN = "TIMESTAMP '2024-01-01 00:00:00' + t.conv_id * INTERVAL '1' DAY + t.turn * INTERVAL '7' HOUR"


@query(f"""SELECT CAST(year(w) AS INT) AS y, CAST(month(w) AS INT) AS m, repository_id, committer_email, count(*) AS num_commits FROM (
    SELECT t.repository_id, concat(t.role, '@mail', t.conv_id % 3, '.example.com') AS committer_email, {_WHEN} AS w FROM turns t JOIN ref_commits r ON r.repository_id = t.repository_id AND r.commit_hash = t.commit_hash AND r.ref_name = 'HEAD') GROUP BY ALL""")
def commits_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _history_of(spark, sf_dir, "ref_commits", "commits")
    return told.groupBy(F.year("committer_when").alias("y"), F.month("committer_when").alias("m"), "repository_id", "committer_email").agg(F.count("*").alias("num_commits"))


@query(f"SELECT CAST(year(w) AS INT) AS first_commit_year, count(*) AS n FROM (SELECT min({_WHEN}) AS w FROM turns t GROUP BY t.repository_id) GROUP BY ALL")
def first_commit_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many repositories began in each year."""
    first = _relations(spark, sf_dir).commits.groupBy("repository_id").agg(F.min("commit_author_when").alias("w"))
    return first.groupBy(F.year("w").alias("first_commit_year")).agg(F.count("*").alias("n"))


@query(f"SELECT CASE dayofweek({_WHEN}) WHEN 0 THEN 'Sunday' WHEN 6 THEN 'Saturday' ELSE 'Weekday' END AS day, count(*) AS n FROM turns t GROUP BY ALL")
def commits_by_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.dayofweek("committer_when")
    return _relations(spark, sf_dir).commits.groupBy(F.when(day == 1, "Sunday").when(day == 7, "Saturday").otherwise("Weekday").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT concat('mail', conv_id % 3, '.example.com') AS raw_domain, concat('mail', conv_id % 3, '.example.com') AS domain, count(*) AS n FROM turns WHERE conv_id % 3 <> 0 GROUP BY ALL")
def email_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain by its place in a JSON array and in the array itself."""
    made = _relations(spark, sf_dir).commits.where("committer_email LIKE '%@%' AND committer_email NOT LIKE '%@mail0.%'")
    parts = F.split("committer_email", "@")
    return made.groupBy(F.get_json_object(F.to_json(parts), "$[1]").alias("raw_domain"), F.get(parts, F.lit(1)).alias("domain")).agg(F.count("*").alias("n"))


# Joins: pairs of the hierarchy, chains, and other kinds.
_sql("pair_repositories_refs", "SELECT r.repository_id, refs.ref_name FROM repositories r JOIN refs ON r.repository_id = refs.repository_id")
_sql("pair_repositories_tree_entries", "SELECT r.repository_id, te.tree_hash, te.tree_entry_name FROM repositories r JOIN tree_entries te ON te.repository_id = r.repository_id")
_sql("pair_repositories_blobs", "SELECT r.repository_id, b.blob_hash, b.blob_size FROM repositories r JOIN blobs b ON b.repository_id = r.repository_id")
_sql("pair_repositories_ref_commits", "SELECT r.repository_id, w.ref_name, w.commit_hash FROM repositories r JOIN ref_commits w ON w.repository_id = r.repository_id WHERE w.history_index = 1")
_sql("pair_ref_commits_commit_trees", "SELECT w.ref_name, w.commit_hash, t.tree_hash FROM ref_commits w JOIN commit_trees t ON t.repository_id = w.repository_id AND t.commit_hash = w.commit_hash")
_sql("pair_refs_ref_commits", "SELECT r.repository_id, r.ref_name, c.commit_hash, c.history_index FROM refs r JOIN ref_commits c ON r.ref_name = c.ref_name AND c.repository_id = r.repository_id")
_sql("pair_refs_tips", "SELECT r.repository_id, r.ref_name, c.history_index FROM refs r JOIN ref_commits c ON r.commit_hash = c.commit_hash AND r.ref_name = c.ref_name AND c.repository_id = r.repository_id")
_sql("pair_ref_commits_commits", "SELECT r.ref_name, r.history_index, c.commit_message FROM ref_commits r JOIN commits c ON r.repository_id = c.repository_id AND r.commit_hash = c.commit_hash")
_sql("pair_refs_commit_trees", "SELECT r.ref_name, t.tree_hash FROM refs r JOIN commit_trees t ON r.commit_hash = t.commit_hash AND r.repository_id = t.repository_id")
_sql("pair_refs_commit_blobs_blobs", "SELECT r.ref_name, b.blob_hash, b.blob_size FROM refs r JOIN commit_blobs cb ON r.commit_hash = cb.commit_hash AND r.repository_id = cb.repository_id JOIN blobs b ON cb.blob_hash = b.blob_hash AND cb.repository_id = b.repository_id")
_sql("pair_commits_main_tree", "SELECT c.commit_hash, t.tree_hash FROM commits c JOIN commit_trees t ON c.commit_hash = t.commit_hash AND c.tree_hash = t.tree_hash AND c.repository_id = t.repository_id")
_sql("pair_commits_tree_entries", "SELECT c.commit_hash, te.tree_entry_name, te.tree_entry_mode FROM commits c JOIN tree_entries te ON c.tree_hash = te.tree_hash AND c.repository_id = te.repository_id")
_sql("pair_tree_entries_blobs", "SELECT te.tree_entry_name, b.blob_size FROM tree_entries te JOIN blobs b ON te.blob_hash = b.blob_hash AND te.repository_id = b.repository_id")
_sql("pair_commit_files_files", "SELECT c.commit_hash, c.file_path, f.blob_size, f.tree_entry_mode FROM commit_files c NATURAL JOIN files f")
_sql("trees_with_readme", "SELECT c.commit_hash, b.blob_size FROM commits c JOIN commit_trees t ON c.commit_hash = t.commit_hash AND c.repository_id = t.repository_id JOIN tree_entries te ON t.tree_hash = te.tree_hash AND t.repository_id = te.repository_id JOIN blobs b ON te.blob_hash = b.blob_hash AND te.repository_id = b.repository_id WHERE te.tree_entry_name = 'README.md'")
_sql("natural_refs_history", "SELECT repository_id, ref_name, history_index FROM refs NATURAL JOIN ref_commits")
_sql("cross_roles", "SELECT a.commit_author_name AS a, b.commit_author_name AS b FROM (SELECT DISTINCT commit_author_name FROM commits) a CROSS JOIN (SELECT DISTINCT commit_author_name FROM commits) b")
_sql("left_refs_tags", "SELECT r.repository_id, r.ref_name, t.ref_name AS tag FROM refs r LEFT JOIN (SELECT repository_id, commit_hash, ref_name FROM refs WHERE ref_name LIKE 'refs/tags/%') t ON r.repository_id = t.repository_id AND r.commit_hash = t.commit_hash")
_sql("right_refs_commits", "SELECT c.commit_hash, r.ref_name FROM refs r RIGHT JOIN commits c ON r.commit_hash = c.commit_hash AND r.repository_id = c.repository_id")
_sql("theta_later_commits", "SELECT a.commit_hash AS earlier, count(*) AS n FROM ref_commits a JOIN ref_commits b ON a.repository_id = b.repository_id AND a.ref_name = b.ref_name AND a.history_index > b.history_index WHERE a.ref_name = 'HEAD' GROUP BY a.commit_hash")

# Subqueries, sorting, conditions, aggregates.
_sql("commits_in_subquery", "SELECT commit_hash FROM commits WHERE commit_hash IN (SELECT commit_hash FROM refs WHERE ref_name = 'HEAD') AND commit_author_name NOT IN (SELECT 'system' AS r)")
_sql("repositories_without_long_history", "SELECT repository_id FROM repositories r WHERE NOT EXISTS (SELECT 1 FROM ref_commits c WHERE c.repository_id = r.repository_id AND c.history_index >= 4)")
_sql("scalar_subquery", "SELECT repository_id, count(*) AS n, (SELECT count(*) FROM commits) AS all_commits FROM commits GROUP BY repository_id")
_sql("limit_offset", "SELECT commit_hash, ref_name FROM refs ORDER BY ref_name DESC, commit_hash LIMIT 15 OFFSET 5")
_sql("simple_case", "SELECT commit_hash, CASE n_parents WHEN 0 THEN 'Root' WHEN 1 THEN 'Commit' ELSE 'Merge' END AS commit_type FROM commits")
_sql("having_and_distinct", "SELECT commit_author_email, count(DISTINCT repository_id) AS repos, count(*) AS n FROM commits GROUP BY commit_author_email HAVING count(*) > 1")
_sql("sums_are_double", "SELECT repository_id, sum(CAST(blob_size AS DOUBLE)) AS total, avg(blob_size) AS mean, min(blob_size) AS least, max(blob_size) AS most FROM blobs GROUP BY repository_id")
_sql("first_and_last", "SELECT repository_id, min_by(commit_hash, commit_author_when) AS first_commit, max_by(commit_hash, commit_author_when) AS last_commit FROM commits GROUP BY repository_id",
     "SELECT repository_id, arg_min(commit_hash, commit_author_when) AS first_commit, arg_max(commit_hash, commit_author_when) AS last_commit FROM commits GROUP BY repository_id")
_sql("refs_by_kind", "SELECT is_tag(ref_name) AS tag, is_remote(ref_name) AS remote, count(*) AS n FROM refs GROUP BY 1, 2", "SELECT starts_with(ref_name, 'refs/tags/') AS tag, starts_with(ref_name, 'refs/remotes/') AS remote, count(*) AS n FROM refs GROUP BY 1, 2")
_sql("files_by_path_pattern", "SELECT repository_id, file_path FROM commit_files NATURAL JOIN refs WHERE ref_name = 'HEAD' AND file_path REGEXP '^notes/' AND file_path NOT REGEXP '[.]go$' AND file_path BETWEEN 'a' AND 'z'",
     "SELECT repository_id, file_path FROM commit_files NATURAL JOIN refs WHERE ref_name = 'HEAD' AND regexp_matches(file_path, '^notes/') AND NOT regexp_matches(file_path, '[.]go$') AND file_path BETWEEN 'a' AND 'z'")

_STRINGS = """SELECT commit_hash, char_length(commit_message) AS chars, {bytes}(commit_message) AS n_bytes, concat_ws('-', commit_author_name, 'x') AS joined, upper(commit_author_name) AS up,
    lpad(commit_author_name, 12, '*') AS padded, rpad(commit_author_name, 12, '*') AS padded_right, reverse(commit_author_name) AS back, replace(commit_message, 'e', 'E') AS replaced, repeat(commit_author_name, 2) AS twice,
    substring(commit_message, 3, 5) AS part, trim(concat('  ', commit_author_name, ' ')) AS bare, nullif(commit_author_name, 'user') AS not_user, coalesce(nullif(commit_author_name, 'user'), 'U') AS filled,
    {nothing} AS nothing FROM commits"""
_sql("string_functions", _STRINGS.format(bytes="octet_length", nothing="mid(commit_message, 0, 2)"), _STRINGS.format(bytes="strlen", nothing="''").replace("char_length", "length"))


# Walks, fused chains and their shortcuts.
@query("SELECT DISTINCT repository_id, commit_hash FROM turns")
def reachable_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _relations(spark, sf_dir)
    return history.reachable(held.refs, held.commits).select("repository_id", "commit_hash")


@query("SELECT t.repository_id, p.ref_name, t.commit_hash, CAST(p.tip - t.turn AS BIGINT) AS depth FROM turns t JOIN places p ON t.conv_id = p.conv_id AND t.turn <= p.tip")
def least_depth_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.sparkContext.setCheckpointDir(_shared(spark))
    held = conversations_history(spark, sf_dir, merges=False)
    longest = held.commits.groupBy("repository_id").count().agg(F.max("count")).first()[0] or 0
    return history.least_depth(held.refs, held.commits, depth=longest)


@query("SELECT t.repository_id, t.commit_hash, p.ref_name, CAST(p.tip - t.turn AS BIGINT) AS history_index FROM turns t JOIN places p ON t.conv_id = p.conv_id AND t.turn <= p.tip")
def ref_commits_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _relations(spark, sf_dir)
    return history.ref_commits(held.refs, held.commits, dedupe=True)


@query("SELECT repository_id, ref_name, history_index, commit_message, file_path, blob_size FROM (SELECT r.repository_id, r.ref_name, CAST(0 AS BIGINT) AS history_index, c.commit_message, f.file_path, b.blob_size FROM refs r JOIN commits c ON r.commit_hash = c.commit_hash JOIN commit_files f ON c.commit_hash = f.commit_hash JOIN blobs b ON f.blob_hash = b.blob_hash AND f.repository_id = b.repository_id)")
def chain_tips_to_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = chain(_relations(spark, sf_dir), "repositories", "refs", "ref_commits", "commits", "commit_files", "files", where={"ref_commits": "history_index = 0"})
    return joined.select("repository_id", "ref_name", "history_index", "commit_message", "file_path", "blob_size")


@query("SELECT c.repository_id, c.commit_hash, te.tree_entry_name, b.blob_size FROM commits c JOIN tree_entries te ON c.tree_hash = te.tree_hash AND c.repository_id = te.repository_id JOIN blobs b ON te.blob_hash = b.blob_hash AND te.repository_id = b.repository_id")
def chain_main_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = chain(_relations(spark, sf_dir), "repositories", "commits", "commit_trees", "tree_entries", "blobs", main_tree=True)
    return joined.select("repository_id", "commit_hash", "tree_entry_name", "blob_size")


@query("SELECT DISTINCT repository_id, commit_hash, blob_hash FROM commit_files")
def commit_blobs_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.commit_blobs(_relations(spark, sf_dir).commit_files, distinct=True)


@query("SELECT repository_id, blob_hash, blob_size, CASE WHEN blob_size > 200 THEN '' ELSE blob_content END AS content FROM blobs")
def blobs_with_size_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = relations.blob_policy(_relations(spark, sf_dir).blobs, most_bytes=200)
    return held.select("repository_id", "blob_hash", "blob_size", F.col("blob_content").cast("string").alias("content"))


# Content functions.
@query("SELECT r.repository_id, f.file_path, CASE WHEN f.file_path LIKE '%.txt' THEN 'Text' WHEN f.file_path LIKE '%.md' THEN 'Markdown' ELSE 'Go' END AS lang, false AS vendored FROM refs r JOIN commit_files f ON r.commit_hash = f.commit_hash AND r.repository_id = f.repository_id WHERE r.ref_name = 'HEAD'")
def languages_of_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = chain(_relations(spark, sf_dir), "refs", "commit_files", where={"refs": "ref_name = 'HEAD'"})
    path = F.col("file_path")
    return joined.select("repository_id", "file_path", language.language(path).alias("lang"), refs.is_vendor(path).alias("vendored"))


@query("SELECT 'Go' AS lang, CAST(2 * count(*) AS BIGINT) AS code, CAST(count(*) AS BIGINT) AS comments, CAST(count(*) AS BIGINT) AS blanks, count(*) AS files FROM refs WHERE ref_name = 'HEAD'")
def lines_per_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content is looked at once for each blob and path ending, before it is joined with the commits."""
    held = _relations(spark, sf_dir)
    joined = chain(held, "refs", "commit_files", where={"refs": "ref_name = 'HEAD'"}).select("repository_id", "file_path", "blob_hash")
    once = joined.groupBy("repository_id", "blob_hash", "file_path").agg(F.count("*").alias("uses"))
    counted = once.join(held.blobs, ["repository_id", "blob_hash"]).withColumn("l", loc.loc(F.col("file_path"), F.col("blob_content"))).where("l is not null")
    total = lambda k: F.sum(F.col(f"l.{k}") * F.col("uses"))
    return counted.groupBy(F.col("l.Language").alias("lang")).agg(total("Code").alias("code"), total("Comment").alias("comments"), total("Blank").alias("blanks"), F.sum("uses").alias("files"))


_DIFF = """, pairs AS (SELECT repository_id, conv_id, turn, commit_hash FROM turns),
    versions AS (SELECT conv_id, turn, 'chat.txt' AS file_path, text AS content FROM turns UNION ALL SELECT conv_id, turn, 'notes/role.txt', role FROM turns),
    split AS (SELECT conv_id, turn, file_path, unnest(string_split(CASE WHEN content LIKE concat('%', chr(10)) THEN substring(content, 1, length(content) - 1) ELSE content END, chr(10))) AS line FROM versions WHERE content <> ''),
    held AS (SELECT conv_id, turn, file_path, line, count(*) AS n FROM split GROUP BY conv_id, turn, file_path, line),
    net AS (SELECT conv_id, turn, file_path, line, sum(n) AS n FROM (SELECT conv_id, turn, file_path, line, n FROM held UNION ALL SELECT h.conv_id, h.turn + 1, h.file_path, h.line, -h.n FROM held h JOIN turns t ON t.conv_id = h.conv_id AND t.turn = h.turn + 1) GROUP BY conv_id, turn, file_path, line),
    sums AS (SELECT conv_id, turn, CAST(sum(CASE WHEN n > 0 THEN n ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE WHEN n < 0 THEN -n ELSE 0 END) AS BIGINT) AS d FROM net GROUP BY conv_id, turn)
    """
_FIRST = "CASE WHEN t.turn = 0 THEN {} ELSE 0 END"


@query(_DIFF + f"SELECT t.repository_id, t.commit_hash, CAST({_FIRST.format(2)} AS BIGINT) AS code_additions, CAST({_FIRST.format(1)} AS BIGINT) AS comment_additions, coalesce(s.a, 0) + {_FIRST.format(5)} AS total_additions, coalesce(s.d, 0) AS total_deletions FROM turns t LEFT JOIN sums s ON s.conv_id = t.conv_id AND s.turn = t.turn")
def commit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _relations(spark, sf_dir)
    stats = diff.commit_stats(diff.pairs_with_parent(held.commits), held.commit_files, held.blobs)
    return stats.select("repository_id", "commit_hash", "code_additions", "comment_additions", "total_additions", "total_deletions")


@query(_DIFF + """, files_net AS (SELECT conv_id, turn, file_path, CAST(sum(CASE WHEN n > 0 THEN n ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE WHEN n < 0 THEN -n ELSE 0 END) AS BIGINT) AS d FROM net GROUP BY conv_id, turn, file_path)
    SELECT t.repository_id, t.commit_hash, f.file_path, 'Text' AS language, f.a AS other_additions, f.d AS other_deletions FROM files_net f JOIN turns t ON t.conv_id = f.conv_id AND t.turn = f.turn
    JOIN versions v ON v.conv_id = f.conv_id AND v.turn = f.turn AND v.file_path = f.file_path LEFT JOIN versions p ON p.conv_id = f.conv_id AND p.turn = f.turn - 1 AND p.file_path = f.file_path WHERE p.content IS NULL OR p.content <> v.content
    UNION ALL SELECT repository_id, commit_hash, 'README.md', 'Markdown', 1, 0 FROM turns WHERE turn = 0
    UNION ALL SELECT repository_id, commit_hash, 'notes/deep/main.go', 'Go', 0, 0 FROM turns WHERE turn = 0""")
def commit_file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _relations(spark, sf_dir)
    stats = diff.commit_file_stats(diff.pairs_with_parent(held.commits), held.commit_files, held.blobs)
    return stats.select("repository_id", "commit_hash", "file_path", "language", "other_additions", "other_deletions")


@query("""SELECT t.repository_id, t.commit_hash, 'notes/role.txt' AS file_path, 0 AS linenum, t.role AS text FROM turns t JOIN tips p ON p.conv_id = t.conv_id AND p.last = t.turn
    UNION ALL SELECT t.repository_id, t.commit_hash, 'README.md', 0, concat('# conv ', t.conv_id) FROM turns t JOIN tips p ON p.conv_id = t.conv_id AND p.last = t.turn""")
def blame_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _relations(spark, sf_dir)
    heads = held.refs.where("ref_name = 'HEAD'").select("repository_id", "commit_hash", F.explode(F.array(F.lit("notes/role.txt"), F.lit("README.md"), F.lit("no such file"))).alias("file_path"))
    return blame.blame_in_trees(heads, held.commits, held.tree_entries, held.blobs).drop("author")


@query("SELECT r.repository_id, concat(t.role, '@mail', t.conv_id % 3, '.example.com') AS author, CAST(1 AS BIGINT) AS n FROM repositories r JOIN turns t ON t.repository_id = r.repository_id AND t.turn = 0")
def blame_authors_of_readme(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _relations(spark, sf_dir)
    heads = held.refs.where("ref_name = 'HEAD'").select("repository_id", "commit_hash", F.lit("README.md").alias("file_path"))
    lines = blame.as_json(blame.blame_in_trees(heads, held.commits, held.tree_entries, held.blobs)).select("repository_id", F.explode("blame").alias("bl"))
    return lines.groupBy("repository_id", F.get_json_object("bl", "$.author").alias("author")).agg(F.count("bl").alias("n"))


@query("SELECT r.repository_id, f.file_path FROM refs r JOIN commit_files f ON r.commit_hash = f.commit_hash AND r.repository_id = f.repository_id WHERE f.file_path LIKE '%.go' AND r.ref_name = 'HEAD'")
def index_on_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _relations(spark, sf_dir)
    rows = chain(held, "refs", "commit_files", where={"refs": "ref_name = 'HEAD'"})
    stored = Indexes(spark, f"{_shared(spark)}/indexes")
    stored.create("files_lang", "commit_files", rows, lang=language.language(F.col("file_path")))
    return stored.find("files_lang", lang="Go").select("repository_id", "file_path")


#: Texts that look like secrets or personal data: name and pattern, read alike by both engines.
_SECRETS = {"mail": "[a-z0-9.]+@[a-z0-9-]+[.](com|org|net)", "phone": "[+][0-9]{2,3}[ -]?[0-9]{2,4}[ -]?[0-9]{3,}", "hex key": "[0-9a-f]{32,}", "assigned": "(password|secret|token|api_key) ?[=:] ?[^ ]{6,}", "key block": "BEGIN [A-Z ]*PRIVATE KEY"}
_SECRET_CASES = " ".join(f"WHEN regexp_matches(b.blob_content, '{pattern}') THEN '{name}'" for name, pattern in _SECRETS.items())


@query(f"""SELECT * FROM (SELECT f.repository_id, f.commit_hash, f.file_path, f.blob_hash, CASE {_SECRET_CASES} END AS kind FROM commit_files f JOIN blobs b ON b.repository_id = f.repository_id AND b.blob_hash = f.blob_hash
    WHERE NOT contains(substring(b.blob_content, 1, 8000), chr(0))) WHERE kind IS NOT NULL""")
def leaks_in_commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents are matched once for each blob, before they are joined with commits and paths."""
    held = _relations(spark, sf_dir)
    text = F.col("blob_content").cast("string")
    kind = F.coalesce(*[F.when(text.rlike(pattern), name) for name, pattern in _SECRETS.items()])
    found = held.blobs.where(~relations.is_binary(F.col("blob_content"))).select("repository_id", "blob_hash", kind.alias("kind")).where("kind is not null")
    placed = found.join(held.commit_files, ["repository_id", "blob_hash"]).where(~refs.is_vendor(F.col("file_path")))
    return placed.select("repository_id", "commit_hash", "file_path", "blob_hash", "kind")


# The same kinds of work over the other stored tables.
def _tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def _over(name: str, tables: tuple[str, ...], text: str, check: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _tables(spark, sf_dir, *tables)
        compat.register(spark)
        return spark.sql(text)

    QUERIES[name] = run
    ORACLES[name] = check or text


_over(
    "hierarchy_orders_per_region",
    ("region", "nation", "customer", "orders"),
    "SELECT r_name, count(*) AS n_orders, count(DISTINCT c_custkey) AS customers, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name",
)
_over("hierarchy_parts_per_nation", ("nation", "customer", "orders", "lineitem", "part"), "SELECT n_name, p_brand, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY n_name, p_brand")
_over(
    "json_properties",
    ("events",),
    "SELECT event_id, json_extract(props, '$.k') AS k, json_unquote(json_extract(concat('{\"t\":\"', event_type, '\"}'), '$.t')) AS t FROM events",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, event_type AS t FROM events",
)
_over(
    "date_functions",
    ("events",),
    "SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, dayofweek(ts) AS dow, weekday(ts) AS wd, dayofyear(ts) AS doy, yearweek(ts) AS yw, unix_timestamp(ts + INTERVAL 1 MONTH) AS next_month, unix_timestamp(ts - INTERVAL 3 DAY) AS before FROM events",
    "SELECT event_id, CAST(year(ts) AS INT) AS y, CAST(month(ts) AS INT) AS m, CAST(day(ts) AS INT) AS d, CAST(hour(ts) AS INT) AS h, CAST(minute(ts) AS INT) AS mi, CAST(second(ts) AS INT) AS s, CAST(dayofweek(ts) + 1 AS INT) AS dow, CAST((dayofweek(ts) + 6) % 7 AS INT) AS wd, CAST(dayofyear(ts) AS INT) AS doy, CAST(isoyear(ts) * 100 + week(ts) AS INT) AS yw, CAST(floor(epoch(ts + INTERVAL 1 MONTH)) AS BIGINT) AS next_month, CAST(floor(epoch(ts - INTERVAL 3 DAY)) AS BIGINT) AS before FROM events",
)
_over(
    "math_functions",
    ("part",),
    "SELECT p_partkey, ceil(p_retailprice) AS up, floor(p_retailprice) AS down, round(p_retailprice, 1) AS r1, sqrt(p_retailprice) AS root, pow(p_size, 2) AS sq, ln(p_retailprice) AS l, log2(p_retailprice) AS l2, log10(p_retailprice) AS l10, log_base(2, p_size) AS lb, log_base(1, p_size) AS none, greatest(p_size, 10) AS g, least(p_size, 10) AS le, p_size DIV 7 AS q, p_size % 7 AS rest, shiftleft(p_size, 2) AS sl, p_size & 6 AS band, p_size | 6 AS bor, p_size ^ 6 AS bx FROM part",
    "SELECT p_partkey, CAST(ceil(p_retailprice) AS BIGINT) AS up, CAST(floor(p_retailprice) AS BIGINT) AS down, round(p_retailprice, 1) AS r1, sqrt(p_retailprice) AS root, CAST(p_size * p_size AS DOUBLE) AS sq, ln(p_retailprice) AS l, log2(p_retailprice) AS l2, log10(p_retailprice) AS l10, ln(p_size) / ln(2) AS lb, CAST(NULL AS DOUBLE) AS none, greatest(p_size, 10) AS g, least(p_size, 10) AS le, CAST(p_size // 7 AS BIGINT) AS q, p_size % 7 AS rest, p_size * 4 AS sl, p_size & 6 AS band, p_size | 6 AS bor, xor(p_size, 6) AS bx FROM part",
)
_LEAK = r'token = "[0-9a-f]{40}"'
_over("leak_scan", ("documents",), f"SELECT doc_id FROM documents WHERE text RLIKE '{_LEAK}'", f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{_LEAK}')")
_over(
    "leaks_in_documents",
    ("documents",),
    "SELECT doc_id, kind FROM (SELECT doc_id, CASE " + " ".join(f"WHEN text RLIKE '{p}' THEN '{n}'" for n, p in _SECRETS.items()) + " END AS kind FROM documents) t WHERE kind IS NOT NULL",
    "SELECT doc_id, kind FROM (SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in _SECRETS.items()) + " END AS kind FROM documents) t WHERE kind IS NOT NULL",
)


@query("SELECT doc_id, CAST(len(regexp_extract_all(lower(text), 'token')) AS INT) AS n FROM documents", closed=False)
def regexp_matches_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.size(compat.regexp_matches(F.col("text"), "token", "i")).alias("n"))


@query("SELECT doc_id, n, part FROM (SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS part FROM documents) x", closed=False)
def explode_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.posexplode(compat.split_literal(F.col("text"), F.lit("\n"))).alias("n", "part")).select("doc_id", (F.col("n") + 1).cast("long").alias("n"), "part")


@query("SELECT conv_id, turn, json_extract_string(concat('{\"role\":\"', role, '\",\"turn\":', turn, '}'), '$.role') AS role FROM conversations", closed=False)
def tree_of_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a small JSON file, parsed into a tree, of which an XPath picks the role."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    text = F.to_json(F.struct("role", "turn"))
    blobs = turns.select("conv_id", "turn", text.cast("binary").alias("blob_content")).withColumn("blob_hash", F.sha1("blob_content"))
    picked = tree.extract(F.col("uast"), "/Object/Pair[@token='role']/Value", "token")
    return tree.trees(blobs, F.lit("JSON")).select("conv_id", "turn", compat.json_unquote(F.get(picked, F.lit(0))).alias("role"))
