"""Predicates on ref names and paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of paths that hold vendored or ignored files (publicly known conventions).
VENDORED = (
    r"(^|/)vendor/", r"(^|/)vendors?/", r"(^|/)third[-_]?party/", r"(^|/)node_modules/", r"(^|/)bower_components/", r"(^|/)Godeps/_workspace/",
    r"(^|/)dist/", r"(^|/)deps/", r"(^|/)cache/", r"(^|/)extern(al)?s?/", r"(^|/)Carthage/", r"(^|/)Pods/", r"(^|/)\.git(attributes|ignore|modules)$",
    r"(^|/)\.yarn/", r"(^|/)\.vscode/", r"(^|/)env/", r"(^|/)gradlew(\.bat)?$", r"(^|/)mvnw(\.cmd)?$", r"(^|/)configure$", r"(^|/)jquery([^/]*)\.js$",
    r"\.min\.(js|css)$",
)


def is_tag(ref: Column) -> Column:
    """Whether a ref is a tag; null: false."""
    return F.coalesce(ref.startswith("refs/tags/"), F.lit(False))


def is_remote(ref: Column) -> Column:
    """Whether a ref is a remote one; null: false."""
    return F.coalesce(ref.startswith("refs/remotes/"), F.lit(False))


def is_vendor(path: Column) -> Column:
    """Whether a path is vendored; null: null."""
    return path.rlike("|".join(VENDORED))
