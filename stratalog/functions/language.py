"""Language of a file by its name, extension or first line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Publicly known file names, extensions and interpreters of languages.
FILE_NAMES = {
    ".gitignore": "Ignore List", ".dockerignore": "Ignore List", ".npmignore": "Ignore List", "Dockerfile": "Dockerfile", "Makefile": "Makefile",
    "GNUmakefile": "Makefile", "CMakeLists.txt": "CMake", "Gemfile": "Ruby", "Rakefile": "Ruby", "LICENSE": "Text", "COPYING": "Text", "README": "Text",
    "CHANGELOG": "Text", "go.mod": "Go Module", "Jenkinsfile": "Groovy", "Vagrantfile": "Ruby", ".bashrc": "Shell", ".profile": "Shell",
}
EXTENSIONS = {
    "c": "C", "h": "C", "cc": "C++", "cpp": "C++", "cxx": "C++", "hpp": "C++", "cs": "C#", "css": "CSS", "clj": "Clojure", "coffee": "CoffeeScript", "d": "D",
    "dart": "Dart", "ex": "Elixir", "exs": "Elixir", "elm": "Elm", "erl": "Erlang", "f90": "Fortran", "fs": "F#", "go": "Go", "gradle": "Gradle",
    "groovy": "Groovy", "hs": "Haskell", "htm": "HTML", "html": "HTML", "ini": "INI", "java": "Java", "js": "JavaScript", "mjs": "JavaScript", "json": "JSON",
    "jl": "Julia", "kt": "Kotlin", "less": "Less", "lisp": "Common Lisp", "lua": "Lua", "md": "Markdown", "markdown": "Markdown", "m": "Objective-C",
    "ml": "OCaml", "pas": "Pascal", "php": "PHP", "pl": "Perl", "pm": "Perl", "proto": "Protocol Buffer", "ps1": "PowerShell", "py": "Python", "r": "R",
    "rb": "Ruby", "rs": "Rust", "rst": "reStructuredText", "sass": "Sass", "scala": "Scala", "scss": "SCSS", "sh": "Shell", "bash": "Shell", "sql": "SQL",
    "swift": "Swift", "tex": "TeX", "tf": "HCL", "toml": "TOML", "ts": "TypeScript", "tsx": "TSX", "txt": "Text", "vb": "Visual Basic .NET", "vue": "Vue",
    "xml": "XML", "yaml": "YAML", "yml": "YAML", "zig": "Zig",
}
INTERPRETERS = {"python": "Python", "ruby": "Ruby", "node": "JavaScript", "bash": "Shell", "sh": "Shell", "zsh": "Shell", "perl": "Perl", "php": "PHP", "lua": "Lua", "Rscript": "R", "groovy": "Groovy"}


def _look_up(key: Column, known: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in known.items() for x in pair]
    return F.element_at(F.create_map(*pairs), key)


def by_name(path: Column) -> Column:
    """By file name, then by extension; null if neither is known."""
    name = F.substring_index(path, "/", -1)
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.coalesce(_look_up(name, FILE_NAMES), _look_up(extension, EXTENSIONS))


def language(path: Column, content: Column | None = None) -> Column:
    """With content, files that names leave open are told by the interpreter in the first line; a null argument gives null."""
    if content is None:
        return by_name(path)
    first = F.regexp_extract(F.substring_index(content.cast("string"), "\n", 1), r"^#!\s*(?:\S*/)?(?:env\s+)?(?:\S*/)?([A-Za-z]+)", 1)
    return F.when(path.isNotNull() & content.isNotNull(), F.coalesce(by_name(path), _look_up(first, INTERPRETERS)))
