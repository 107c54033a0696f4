"""The property graph: files and definitions as nodes; contains, imports, calls and reads as edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

FILES = "file_id long, path string, dir string, lang string, content_hash string"
DEFS = "def_id long, file_id long, local_idx int, name string, short_name string, kind string, start_line int, end_line int, test_id array<string>, computed_name boolean, parent_idx int, sig_hash string, body_hash string"
KINDS = ("Function", "Method", "Class", "TestCase", "ModuleInit")


@dataclass(frozen=True)
class Graph:
    """files(file_id, path, dir, lang), defs(def_id, file_id, name, short_name, kind, ...), contains(parent, child),
    imports(from_file, to_file), calls(from_def, to_def, unknown_name) with exactly one of the last two set, reads(from_def, to_def)."""

    files: DataFrame
    defs: DataFrame
    contains: DataFrame
    imports: DataFrame
    calls: DataFrame
    reads: DataFrame
