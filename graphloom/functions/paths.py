"""Column expressions on paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages and categories by suffix, and roles by folder name.
LANGUAGES = {"py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "mts": "typescript", "tsx": "typescript", "c": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "h": "cpp", "hpp": "cpp", "cs": "csharp", "lua": "lua", "sh": "shell", "go": "go", "rs": "rust", "java": "java"}
DOCUMENTATION = ["md", "rst", "txt", "adoc"]
BUILD = ["cmake", "toml", "yaml", "yml", "gradle", "mk", "lock"]
BUILD_NAMES = ["makefile", "cmakelists.txt", "package.json", "pyproject.toml", "setup.py", "dockerfile"]
ROLES = {"test": ["test", "tests", "spec"], "tool": ["tool", "tools", "script", "scripts"], "example": ["example", "examples", "demo", "demos"], "generated": ["generated", "gen"], "third_party": ["vendor", "third_party", "extern", "external", "node_modules"]}


def normal(path: Column) -> Column:
    """With `/` and without leading `./`."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./+)+", "")


def suffix(path: Column) -> Column:
    """Lower case, without the dot; null without one."""
    s = F.lower(F.regexp_extract(path, r"[^/]\.([A-Za-z0-9]+)$", 1))
    return F.when(s != "", s)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def top_folder(path: Column) -> Column:
    """The first folder, `.` for files at the root."""
    first = F.regexp_extract(path, r"^([^/]+)/", 1)
    return F.when(first == "", F.lit(".")).otherwise(first)


def language(path: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), suffix(path))


def category(path: Column) -> Column:
    """`build`, `source`, `documentation` or `resource`, names of build files first."""
    s = suffix(path)
    return F.when(F.lower(file_name(path)).isin(BUILD_NAMES) | s.isin(BUILD), "build").when(language(path).isNotNull(), "source").when(s.isin(DOCUMENTATION), "documentation").otherwise("resource")


def roles(path: Column) -> Column:
    """The roles that the folders of path give, sorted."""
    folders = F.slice(F.split(F.lower(path), "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    given = [F.when(F.arrays_overlap(folders, F.array(*map(F.lit, names))), F.lit(role)) for role, names in sorted(ROLES.items())]
    return F.array_compact(F.array(*given))


def glob(pattern: str) -> str:
    """A regular expression for a glob: `*` and `?` stay within a folder, `**` doesn't, `[...]` is a class."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and (j := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : j]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]", j + 1
            continue
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in r".^$+{}()|\\" else c
        i += 1
    return f"^{out}$"
