"""Syntax trees of files as XML text, so that Spark's own xpath functions read them.

An element for each node, named by its type, with the attributes token, role and pos where it has them.  Python, JSON
and well-formed XML can be parsed; other languages, texts that do not parse and texts over a limit give null.  Parse
distinct contents once and join the trees back: parsing is the one step here that runs in Python.
"""

from __future__ import annotations

import ast
import json
import re
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_BYTES = 5 << 20
_NOT_XML = re.compile("[^\\t\\n\\r\\x20-\\ud7ff\\ue000-\\ufffd\\U00010000-\\U0010ffff]")
# Roles of node types.
ROLES = {"FunctionDef": "Function", "AsyncFunctionDef": "Function", "ClassDef": "Type", "Import": "Import", "ImportFrom": "Import", "Name": "Identifier", "Constant": "Literal", "Call": "Call", "If": "If", "For": "For", "While": "While", "Return": "Return", "Assign": "Assignment"}


def _element(kind: str, token: str | None = None, pos: str | None = None) -> ET.Element:
    own = {"token": None if token is None else _NOT_XML.sub("", token), "role": ROLES.get(kind), "pos": pos}
    return ET.Element(kind, {k: v for k, v in own.items() if v is not None})


def _python(node: ast.AST) -> ET.Element:
    token = next((str(getattr(node, k)) for k in ("name", "id", "attr", "arg", "module", "value") if isinstance(getattr(node, k, None), str | int | float)), None)
    out = _element(type(node).__name__, token, f"{node.lineno}:{node.col_offset}" if hasattr(node, "lineno") else None)
    out.extend(_python(x) for x in ast.iter_child_nodes(node))
    return out


def _json(value: object, kind: str = "Value") -> ET.Element:
    if isinstance(value, dict | list):
        out = _element("Object" if isinstance(value, dict) else "Array")
        for k, v in value.items() if isinstance(value, dict) else enumerate(value):
            pair = _element("Pair" if isinstance(value, dict) else "Item", str(k))
            pair.append(_json(v))
            out.append(pair)
        return out
    return _element(kind, json.dumps(value))


def _parsed(text: bytes | None, language: str | None) -> str | None:
    if not text or not language or len(text) > MOST_BYTES:
        return None
    try:
        if language == "Python":
            tree = _python(ast.parse(text))
        elif language == "JSON":
            tree = _json(json.loads(text))
        elif language == "XML":
            tree = ET.fromstring(text)
        else:
            return None
        return ET.tostring(tree, encoding="unicode")
    except (SyntaxError, ValueError, ET.ParseError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def _parse(content: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([_parsed(c, x) for c, x in zip(content, language, strict=True)], dtype=object)


def trees(blobs: DataFrame, language: Column) -> DataFrame:
    """blobs (blob_hash, blob_content, ...) with `uast`, parsed once for each distinct blob and language."""
    keyed = blobs.withColumn("_lang", language)
    once = keyed.groupBy("blob_hash", "_lang").agg(F.any_value("blob_content").alias("_content"))
    parsed = once.select(F.col("blob_hash").alias("_hash"), F.col("_lang").alias("_of"), _parse(F.col("_content"), F.col("_lang")).alias("uast"))
    joined = keyed.join(parsed, (F.col("blob_hash") == F.col("_hash")) & F.col("_lang").eqNullSafe(F.col("_of")), "left")
    return joined.select(*blobs.columns, "uast")


def extract(tree: Column, path: str, key: str) -> Column:
    """Values of an attribute (token, role, pos, ...) over the nodes that an XPath finds; nodes without it give none."""
    return F.xpath(tree, F.lit(f"{path}/@{key}"))


def imports(tree: Column) -> Column:
    """Names that the file imports, in order."""
    return F.concat(F.xpath(tree, F.lit("//Import/alias/@token")), F.xpath(tree, F.lit("//ImportFrom/@token")))
