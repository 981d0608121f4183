"""The eleven relations, and which pairs of them a chain may join by which keys."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _B, _TS = T.StringType(), T.LongType(), T.BinaryType(), T.TimestampType()


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


SCHEMAS: dict[str, T.StructType] = {
    "repositories": _table(("repository_id", _S)),
    "remotes": _table(*[(c, _S) for c in ("repository_id", "remote_name", "remote_push_url", "remote_fetch_url", "remote_push_refspec", "remote_fetch_refspec")]),
    "refs": _table(("repository_id", _S), ("ref_name", _S), ("commit_hash", _S)),
    "commits": _table(
        ("repository_id", _S), ("commit_hash", _S), ("commit_author_name", _S), ("commit_author_email", _S), ("commit_author_when", _TS), ("committer_name", _S),
        ("committer_email", _S), ("committer_when", _TS), ("commit_message", _S), ("tree_hash", _S), ("commit_parents", T.ArrayType(_S)),
    ),
    "ref_commits": _table(("repository_id", _S), ("commit_hash", _S), ("ref_name", _S), ("history_index", _L)),
    "commit_trees": _table(("repository_id", _S), ("commit_hash", _S), ("tree_hash", _S)),
    "commit_blobs": _table(("repository_id", _S), ("commit_hash", _S), ("blob_hash", _S)),
    "commit_files": _table(("repository_id", _S), ("commit_hash", _S), ("file_path", _S), ("blob_hash", _S), ("tree_hash", _S)),
    "tree_entries": _table(("repository_id", _S), ("tree_entry_name", _S), ("blob_hash", _S), ("tree_hash", _S), ("tree_entry_mode", _S)),
    "blobs": _table(("repository_id", _S), ("blob_hash", _S), ("blob_size", _L), ("blob_content", _B)),
    "files": _table(("repository_id", _S), ("file_path", _S), ("blob_hash", _S), ("tree_hash", _S), ("tree_entry_mode", _S), ("blob_content", _B), ("blob_size", _L)),
}

#: Modes of tree entries, in the bare octal form.
DIRECTORY, SUBMODULE, SYMLINK = "40000", "160000", "120000"

#: From the higher relation of a pair to the lower one: the keys that join them, beside repository_id.
CHAIN_KEYS: dict[tuple[str, str], tuple[str, ...]] = {
    **{("repositories", t): () for t in ("remotes", "refs", "ref_commits", "commits", "tree_entries", "blobs")},
    ("remotes", "refs"): (),
    ("refs", "ref_commits"): ("ref_name",),
    **{("refs", t): ("commit_hash",) for t in ("commits", "commit_trees", "commit_blobs", "commit_files")},
    **{("ref_commits", t): ("commit_hash",) for t in ("commits", "commit_trees", "commit_blobs", "commit_files")},
    **{("commits", t): ("commit_hash",) for t in ("commit_trees", "commit_blobs", "commit_files")},
    ("commits", "tree_entries"): ("tree_hash",),
    ("commit_trees", "tree_entries"): ("tree_hash",),
    **{(t, "blobs"): ("blob_hash",) for t in ("tree_entries", "commit_blobs", "commit_files")},
    ("commit_files", "files"): ("tree_hash", "file_path", "blob_hash"),
}
