"""Repositories as sources: walking trees, listing changes, reading revisions, extracting files."""

from __future__ import annotations

import hashlib
import json
import os
import re
import subprocess
import tempfile
import tomllib
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.scalars import EXTENSIONS, glob_regex
from .lang import go, rust, ts

# Directories that are never walked, at any depth.
PRUNED = {"node_modules", "vendor", "target", ".impactgraph"}
CONFIG = "impactgraph.toml"
EXTRACT = {"ts": ts.extract, "go": go.extract, "rust": rust.extract}
DEF = "struct<name:string,kind:string,start_line:int,end_line:int,test_id:array<string>,computed_name:boolean,parent_idx:int,sig_hash:string,body_hash:string>"
REF = "struct<from_idx:int,ref_kind:string,name:string,qualifier:string,line:int>"
EXTRACTION = f"path string, lang string, content_hash string, defs array<{DEF}>, imports array<struct<raw:string,line:int>>, refs array<{REF}>, error string"


class GitError(RuntimeError):
    pass


def git(repo: str, *args: str) -> bytes:
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True)
    if done.returncode:
        raise GitError(done.stderr.decode(errors="replace").strip())
    return done.stdout


@dataclass(frozen=True)
class Config:
    always_run: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()


def load_config(root: str) -> Config:
    """impactgraph.toml: always-run and ignore, lists of globs. A missing file gives defaults; a malformed one raises ValueError."""
    try:
        with open(os.path.join(root, CONFIG), "rb") as f:
            raw = tomllib.load(f)
    except FileNotFoundError:
        return Config()
    lists = {k: raw.get(k, []) for k in ("always-run", "ignore")}
    if unknown := set(raw) - set(lists):
        raise ValueError(f"unknown settings {sorted(unknown)} in {CONFIG}")
    for globs in lists.values():
        if not isinstance(globs, list) or not all(isinstance(g, str) for g in globs):
            raise ValueError(f"{CONFIG}: globs must be lists of strings")
        for g in globs:
            glob_regex(g)
    return Config(tuple(lists["always-run"]), tuple(lists["ignore"]))


def ignored(path: str, globs: tuple[str, ...]) -> bool:
    return any(re.match(glob_regex(g), path) for g in globs)


def language_of(path: str) -> str | None:
    stem, dot, ext = path.rpartition("/")[2].rpartition(".")
    return EXTENSIONS.get(ext.lower()) if dot and stem else None


def _gitignored(root: str, paths: list[str]) -> set[str]:
    """Paths that .gitignore files exclude, also outside git: git itself answers, in a bare repository of its own."""
    if not paths or not any(os.path.basename(p) == ".gitignore" for p in _all_files(root)):
        return set()
    with tempfile.TemporaryDirectory() as own:
        subprocess.run(["git", "init", "-q", "--bare", own], check=True, capture_output=True)
        done = subprocess.run(["git", f"--git-dir={own}", f"--work-tree={root}", "check-ignore", "--no-index", "-z", "--stdin"], cwd=root, input="\0".join(paths).encode(), capture_output=True)
    return {p for p in done.stdout.decode().split("\0") if p}


def _all_files(root: str) -> list[str]:
    out = []
    for folder, dirs, files in os.walk(root):
        dirs[:] = [d for d in dirs if d not in PRUNED and not d.startswith(".")]
        rel = os.path.relpath(folder, root)
        out += [f if rel == "." else f"{rel}/{f}" for f in files]
    return out


def discover(root: str, ignore: tuple[str, ...] = ()) -> tuple[list[tuple[str, str]], set[str]]:
    """Sorted (path, language) of the files to index, and every path and directory there is (import targets need not be indexed).

    Dot-files, pruned directories, what .gitignore excludes and what `ignore` matches are left out. Paths order component by component.
    """
    every = [p for p in _all_files(root)]
    found = [p for p in every if not p.rpartition("/")[2].startswith(".") and language_of(p)]
    hidden = _gitignored(root, found)
    catalog = set(every)
    for p in every:
        while "/" in p:
            p = p.rpartition("/")[0]
            catalog.add(p)
    return [(p, language_of(p)) for p in sorted(found, key=lambda p: p.split("/")) if p not in hidden and not ignored(p, ignore)], catalog


def extract_source(path: str, lang: str, source: bytes) -> dict:
    x = EXTRACT[lang](source.decode("utf-8"), path)
    return {"path": path, "lang": lang, "content_hash": hashlib.sha256(source).hexdigest(), "defs": x.defs, "imports": x.imports, "refs": x.refs, "error": None}


def _extract_rows(frames):
    """Reads and extracts files, one row each; an unreadable file gives its error."""
    for frame in frames:
        rows = []
        for full, path, lang, source in zip(frame["full"], frame["path"], frame["lang"], frame["source"], strict=True):
            try:
                data = bytes(source) if source is not None else open(full, "rb").read()
                rows.append(extract_source(path, lang, data))
            except (OSError, UnicodeDecodeError) as e:
                rows.append({"path": path, "lang": lang, "content_hash": None, "defs": [], "imports": [], "refs": [], "error": str(e)})
        yield pd.DataFrame(rows, columns=["path", "lang", "content_hash", "defs", "imports", "refs", "error"])


def extractions(spark: SparkSession, files: list[tuple[str, str, str, bytes | None]]) -> DataFrame:
    """Extractions of files (full path or '', path, language, source or None to read it), spread over tasks by count."""
    df = spark.createDataFrame(files, "full string, path string, lang string, source binary")
    return df.repartition(max(1, min(len(files) // 64 + 1, 4096))).mapInPandas(_extract_rows, EXTRACTION)


def hashes(spark: SparkSession, root: str, found: list[tuple[str, str]]) -> DataFrame:
    """(path, lang, full, content_hash) of files on disk."""

    def run(frames):
        for f in frames:
            f["content_hash"] = [hashlib.sha256(open(p, "rb").read()).hexdigest() for p in f["full"]]
            yield f

    rows = [(p, lang, os.path.join(root, p)) for p, lang in found]
    df = spark.createDataFrame(rows, "path string, lang string, full string")
    return df.repartition(max(1, min(len(rows) // 64 + 1, 4096))).mapInPandas(run, "path string, lang string, full string, content_hash string")


def parse_status(raw: bytes) -> list[tuple[str, str, str | None]]:
    """(path, status, old path) from NUL-separated name-status output: Added, Modified, Deleted, Renamed. Other states raise GitError."""
    words, out, i = raw.decode().split("\0"), [], 0
    while i < len(words) and words[i]:
        state = words[i][0]
        if state in "RC":
            old, path = words[i + 1], words[i + 2]
            out.append((path, "Renamed", old) if state == "R" else (path, "Added", None))
            i += 3
            continue
        if state not in "MADT":
            raise GitError(f"unsupported change state {words[i]!r}")
        out.append((words[i + 1], {"M": "Modified", "T": "Modified", "A": "Added", "D": "Deleted"}[state], None))
        i += 2
    return out


def diffed_files(repo: str, start: str, end: str | None = None) -> list[tuple[str, str, str | None]]:
    """(path, status, old path) of the changes from one revision to another, or to the working tree."""
    return parse_status(git(repo, "diff", "--name-status", "-M", "-z", start, *([end] if end else []), "--"))


def untracked_files(repo: str) -> list[str]:
    return [p for p in git(repo, "ls-files", "--others", "--exclude-standard", "-z").decode().split("\0") if p]


def show_file(repo: str, rev: str, path: str) -> bytes | None:
    """The file at a revision; None if it does not exist there."""
    try:
        return git(repo, "show", f"{rev}:{path}")
    except GitError as e:
        if any(s in str(e) for s in ("does not exist", "exists on disk, but not in", "path not in")):
            return None
        raise


def show_files(repo: str, rev: str, paths: list[str]) -> dict[str, bytes | None]:
    """The files at a revision, all read by one process; None for those that do not exist there."""
    sha = git(repo, "rev-parse", "--verify", f"{rev}^{{commit}}").decode().strip()
    plain = [p for p in dict.fromkeys(paths) if "\n" not in p]
    out: dict[str, bytes | None] = {p: show_file(repo, sha, p) for p in dict.fromkeys(paths) if "\n" in p}
    if not plain:
        return out
    done = subprocess.run(["git", "-C", repo, "cat-file", "--batch"], input="".join(f"{sha}:{p}\n" for p in plain).encode(), capture_output=True)
    if done.returncode:
        raise GitError(done.stderr.decode(errors="replace").strip())
    raw, at = done.stdout, 0
    for p in plain:
        end = raw.index(b"\n", at)
        head = raw[at:end]
        at = end + 1
        if head.endswith(b" missing"):
            out[p] = None
            continue
        kind, size = head.split()[-2:]
        out[p] = raw[at : at + int(size)] if kind == b"blob" else None
        at += int(size) + 1
    return out


@contextmanager
def snapshot(repo: str, rev: str, shared: str):
    """A checkout of rev in a temporary worktree under a folder that executors see, removed at the end."""
    sha = git(repo, "rev-parse", "--verify", f"{rev}^{{commit}}").decode().strip()
    base = shared.removeprefix("file:")
    base = "/" + base.lstrip("/") if shared.startswith("file:") else base
    if "://" in base:
        raise ValueError(f"{shared} is no mounted folder: a revision can be checked out only where git can write")
    os.makedirs(base, exist_ok=True)
    folder = tempfile.mkdtemp(prefix=f"impactgraph-{sha[:12]}-", dir=base)
    try:
        git(repo, "worktree", "add", "--detach", "--force", folder, sha)
        yield folder
    finally:
        subprocess.run(["git", "-C", repo, "worktree", "remove", "--force", folder], capture_output=True)
        subprocess.run(["git", "-C", repo, "worktree", "prune"], capture_output=True)


def import_candidates(go_module: str | None, roots: list[str]):
    """For mapInPandas over (file_id, path, lang, raws): rows (file_id, ord, priority, candidate) of where each import may lead, best first."""

    def run(frames):
        for f in frames:
            rows = []
            for file_id, path, lang, raws in zip(f["file_id"], f["path"], f["lang"], f["raws"], strict=True):
                for n, raw in enumerate(raws):
                    options = ts.candidates(path, raw) if lang == "ts" else go.candidates(path, raw, go_module) if lang == "go" else rust.candidates(path, raw, roots)
                    rows += [(file_id, n, k, c) for k, c in enumerate(options)]
            yield pd.DataFrame(rows, columns=["file_id", "ord", "priority", "candidate"]).astype({"file_id": "int64", "ord": "int32", "priority": "int32"})

    return run


def to_json(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
