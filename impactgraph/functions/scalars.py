"""Scalar functions as Spark columns, and glob patterns as regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Files whose change runs every test, and the shortest needle of an importer scan.
CONFIG_NAMES = ("package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "go.mod", "go.sum", "Cargo.toml", "Cargo.lock")
CONFIG_PATTERN = r"^(tsconfig.*\.json|\.env.*)$"
MIN_NEEDLE = 3
COMPUTED = "<computed>"
MODULE = "<module>"
# Languages by extension, and the runner of each language.
EXTENSIONS = {"ts": "ts", "tsx": "ts", "js": "ts", "jsx": "ts", "mts": "ts", "cts": "ts", "go": "go", "rs": "rust"}
RUNNERS = {"ts": "vitest", "go": "gotest", "rust": "cargo"}


def short_name(name: Column) -> Column:
    """The text after the last dot."""
    return F.substring_index(name, ".", -1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    """The directory of a path; empty at the root."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def stem(path: Column) -> Column:
    """The basename without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def path_order(path: Column) -> Column:
    """Paths order component by component, so that a/b comes before a-b."""
    return F.split(path, "/")


def language(path: Column) -> Column:
    """The language registered for the path's extension, in any ASCII case; null if there is none."""
    ext = F.lower(F.regexp_extract(basename(path), r".\.([^.]*)$", 1))
    out = F.lit(None).cast("string")
    for e, lang in EXTENSIONS.items():
        out = F.when(ext == e, lang).otherwise(out)
    return out


def needles(path: Column) -> Column:
    """Basename and stem, each if it has three characters or more."""
    return F.array_distinct(F.filter(F.array(basename(path), stem(path)), lambda n: F.char_length(n) >= MIN_NEEDLE))


def is_config_file(path: Column) -> Column:
    return basename(path).isin(*CONFIG_NAMES) | basename(path).rlike(CONFIG_PATTERN)


def runner(lang: Column) -> Column:
    out = F.lit("unknown")
    for k, v in RUNNERS.items():
        out = F.when(lang == k, v).otherwise(out)
    return out


def sh_quote(text: Column) -> Column:
    """Bare if only characters that no shell treats specially, else in single quotes."""
    quoted = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    return F.when(text.rlike(r"\A[A-Za-z0-9_./:=@^-]+\z"), text).otherwise(quoted)


def escape_go_regex(text: Column) -> Column:
    return F.regexp_replace(text, r"([.^$*+?()\[\]{}|\\])", r"\\$1")


def test_name(test_id: Column, name: Column) -> Column:
    return F.coalesce(test_id, F.array(name))


def command_line(path: Column, test: Column, lang: Column, computed: Column) -> Column:
    """The command that runs one test; null for a language without a runner."""
    vitest = F.concat(F.lit("vitest run "), sh_quote(path), F.when(computed, "").otherwise(F.concat(F.lit(" -t "), sh_quote(F.array_join(test, " > ")))))
    folder = parent_dir(path)
    package = F.when(folder == "", ".").otherwise(F.concat(F.lit("./"), folder))
    pattern = F.array_join(F.transform(test, lambda s: F.when(s == COMPUTED, ".*").otherwise(F.concat(F.lit("^"), escape_go_regex(s), F.lit("$")))), "/")
    gotest = F.concat(F.lit("go test "), sh_quote(package), F.lit(" -run "), sh_quote(pattern))
    cargo = F.concat(F.lit("cargo test "), sh_quote(F.array_join(test, "::")), F.when(computed, "").otherwise(" -- --exact"))
    return F.when(lang == "ts", vitest).when(lang == "go", gotest).when(lang == "rust", cargo)


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a glob: * and ? also match slashes, ** stands for whole components, {a,b} and [a-z] work.

    Raises ValueError for unclosed classes or alternates.
    """
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            n = len(pattern[i:]) - len(pattern[i:].lstrip("*"))
            first, after = i == 0 or pattern[i - 1] == "/", pattern[i + n : i + n + 1]
            if n == 2 and first and after == "/":
                out.append("(?:.*/)?")
                i += 3
                continue
            out.append(".+" if n == 2 and first and not after and i else ".*")
            i += n
            continue
        if c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + (3 if pattern[i + 1 : i + 2] in ("!", "^") else 2))
            if end < 0:
                raise ValueError(f"unclosed character class in {pattern!r}")
            body = pattern[i + 1 : end]
            negated = body[:1] in ("!", "^")
            out.append("[" + ("^" if negated else "") + re.sub(r"([\\\[\]&^])", r"\\\1", body[negated:]) + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise ValueError(f"unclosed alternates in {pattern!r}")
    return "(?s)^" + "".join(out) + "$"


def first_glob(path: Column, globs: list[str]) -> Column:
    """The first of the patterns, in declared order, that the path matches; null if none."""
    out = F.lit(None).cast("string")
    for g in reversed(globs):
        out = F.when(path.rlike(glob_regex(g)), g).otherwise(out)
    return out
