"""Kinds of lines: code, comment or blank, by the comment marks of the file's language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalog.functions.language import language

_C, _HASH, _XML = ("//", "/*", "*/"), ("#", None, None), (None, "<!--", "-->")
#: Language: line mark, block start, block end.  Languages that are not listed have no rules.
MARKS = {
    **dict.fromkeys(("C", "C++", "C#", "D", "Dart", "Go", "Groovy", "Java", "JavaScript", "Kotlin", "Objective-C", "PHP", "Rust", "Scala", "SCSS", "Swift", "TypeScript", "TSX", "Zig", "Protocol Buffer", "Less"), _C),
    **dict.fromkeys(("Python", "Ruby", "Shell", "Perl", "R", "Makefile", "YAML", "TOML", "Dockerfile", "Elixir", "Julia", "CMake", "HCL", "CoffeeScript"), _HASH),
    **dict.fromkeys(("HTML", "XML", "Vue"), _XML),
    "CSS": (None, "/*", "*/"), "SQL": ("--", "/*", "*/"), "Lua": ("--", "--[[", "]]"), "Haskell": ("--", "{-", "-}"), "Erlang": ("%", None, None),
    "TeX": ("%", None, None), "Clojure": (";", None, None), "Common Lisp": (";", None, None), "INI": (";", None, None), "JSON": (None, None, None),
}


def lines(content: Column) -> Column:
    """Lines of a text, without a last empty one and without carriage returns."""
    text = F.regexp_replace(F.regexp_replace(content.cast("string"), "\r\n", "\n"), "\n$", "")
    return F.when(F.octet_length(content) > 0, F.split(text, "\n")).otherwise(F.array().cast("array<string>"))


def _mark(name: Column, k: int) -> Column:
    pairs = [F.lit(x) for lang, marks in MARKS.items() if marks[k] for x in (lang, marks[k])]
    return F.element_at(F.create_map(*pairs), name)


def line_kinds(content: Column, name: Column) -> Column:
    """An array of struct(line, kind) with kind 'code', 'comment' or 'blank'; `name` is the language.  A first line that
    names an interpreter is code.  A block comment runs to its end mark, over lines."""
    line_mark, block, end = (_mark(name, k) for k in range(3))

    def step(state: Column, line: Column) -> Column:
        bare = F.trim(line)
        inside = state["inside"]
        opens = ~inside & F.coalesce(bare.startswith(block), F.lit(False))
        held = inside | opens
        rest = F.when(opens, F.expr("''")).otherwise(bare)
        body = F.when(opens, F.substring(bare, F.length(block) + 1, F.length(bare))).otherwise(rest)
        closes = held & F.coalesce(F.contains(body, end), F.lit(False))
        note = F.coalesce(bare.startswith(line_mark), F.lit(False)) & ~((F.size(state["out"]) == 0) & bare.startswith("#!"))
        kind = F.when(bare == "", "blank").when(held | note, "comment").otherwise("code")
        return F.struct((held & ~closes).alias("inside"), F.concat(state["out"], F.array(F.struct(line.alias("line"), kind.alias("kind")))).alias("out"))

    empty = F.expr("cast(array() as array<struct<line: string, kind: string>>)")
    return F.aggregate(lines(content), F.struct(F.lit(False).alias("inside"), empty.alias("out")), step, lambda s: s["out"])


def loc(path: Column, content: Column) -> Column:
    """struct(Code, Comment, Blank, Name, Language); null for null or empty content and for languages without rules."""
    name = language(path, content)
    kinds = line_kinds(content, name)
    count = lambda kind: F.size(F.filter(kinds, lambda x: x["kind"] == kind)).alias(kind.capitalize())
    known = name.isin(*MARKS) & (F.octet_length(content) > 0)
    return F.when(known, F.struct(count("code"), count("comment"), count("blank"), path.alias("Name"), name.alias("Language")))
