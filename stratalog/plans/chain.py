"""Chains of relations, joined from the repository down to the content by complete keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.schemas import CHAIN_KEYS
from stratalog.views import History


def chain(history: History, *names: str, where: dict[str, str] | None = None, main_tree: bool = False) -> DataFrame:
    """Joins relations given from high to low.  repository_id is always a key; `where` filters a relation before it is joined.

    Shortcuts: refs with ref_commits filtered to history_index 0 needs no walk (the tips are the refs themselves), and
    commits with commit_trees in `main_tree` form takes each commit's own tree without descending.
    Columns that stand in more than one relation are kept once if they are keys, else from the higher relation.
    """
    filters = where or {}

    def relation(name: str) -> DataFrame:
        if name == "ref_commits" and filters.get(name, "").replace(" ", "") == "history_index=0":
            tips = history.refs.join(history.commits.select("repository_id", "commit_hash"), ["repository_id", "commit_hash"], "left_semi")
            return tips.select("repository_id", "commit_hash", "ref_name", F.lit(0).cast("long").alias("history_index"))
        if name == "commit_trees" and main_tree:
            return history.commits.select("repository_id", "commit_hash", "tree_hash")
        rows = getattr(history, name)
        return rows.where(filters[name]) if name in filters else rows

    joined, above = relation(names[0]), [names[0]]
    for name in names[1:]:
        owner = next((a for a in reversed(above) if (a, name) in CHAIN_KEYS), None)
        if owner is None:
            raise ValueError(f"{name} can't be joined below {', '.join(above)}")
        keys = ["repository_id", *CHAIN_KEYS[owner, name]]
        if (owner, name) == ("commits", "commit_trees") and main_tree:
            keys.append("tree_hash")
        rows = relation(name)
        twice = [c for c in rows.columns if c in joined.columns and c not in keys]
        joined = joined.join(rows.drop(*twice), keys)
        above.append(name)
    return joined
