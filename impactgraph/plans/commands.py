"""The user's commands as compositions of operators: index, stats, changes, select, why."""

from __future__ import annotations

import os
import shutil
import time
import uuid
from contextlib import nullcontext
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import diff, resolve, walk
from ..operators.graph import Graph
from ..sources import repo as R
from ..sources.lang import go as go_lang
from ..sources.staging import shared_dir, staged

VERSION = 1
SHIFT = 20  # def_id = file_id << SHIFT | local_idx
DEF_FIELDS = ("name", "kind", "start_line", "end_line", "test_id", "computed_name", "parent_idx", "sig_hash", "body_hash")


def stats(graph: Graph) -> DataFrame:
    """One row: files, defs, tests, calls (unknown ones too), reads, unresolved, imports, contains."""
    one = lambda df, **c: df.agg(*[e.alias(n) for n, e in c.items()])
    out = one(graph.files, files=F.count("*"))
    for part in (
        one(graph.defs, defs=F.count("*"), tests=F.count_if(F.col("kind") == "TestCase")),
        one(graph.calls, calls=F.count("*"), unresolved=F.count("unknown_name")),
        one(graph.reads, reads=F.count("*")),
        one(graph.imports, imports=F.count("*")),
        one(graph.contains, contains=F.count("*")),
    ):
        out = out.join(F.broadcast(part))  # single rows
    return out


def snapshot_path(root: str) -> str:
    return os.path.join(root, ".impactgraph", f"extractions-v{VERSION}")


def load_snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    """The last index's extractions; missing or unreadable means none."""
    try:
        df = spark.read.schema(R.EXTRACTION).parquet(snapshot_path(root))
        df.limit(1).collect()
        return df
    except Exception:  # whatever its state, an unreadable snapshot is rebuilt
        return None


def save_snapshot(extracted: DataFrame, root: str) -> None:
    """Written beside the old one, which it then replaces by renaming, so a reader never sees half a snapshot."""
    path = snapshot_path(root)
    fresh, old = f"{path}-{uuid.uuid4().hex}", f"{path}-old-{uuid.uuid4().hex}"
    extracted.coalesce(8).write.parquet(fresh)
    if os.path.exists(path):
        os.rename(path, old)
    os.rename(fresh, path)
    shutil.rmtree(old, ignore_errors=True)


@dataclass
class Index:
    graph: Graph
    extracted: DataFrame
    parsed: int
    reused: int


def build_index(spark: SparkSession, root: str, previous: DataFrame | None = None, ignore: tuple[str, ...] = ()) -> Index:
    """Extracts files whose content the previous snapshot does not hold, and builds the graph anew."""
    found, catalog = R.discover(root, ignore)
    if not found:
        extracted, parsed, reused = spark.createDataFrame([], R.EXTRACTION), 0, 0
    elif previous is None:
        extracted = staged(R.extractions(spark, [(os.path.join(root, p), p, lang, None) for p, lang in found]), "extractions")
        parsed, reused = len(found), 0
    else:
        marked = staged(resolve.reuse(R.hashes(spark, root, found), previous), "hashes")
        fresh = marked.where(~F.col("reused")).select("full", "path", "lang", F.lit(None).cast("binary").alias("source"))
        kept = previous.join(marked.where("reused").select("path", "content_hash"), ["path", "content_hash"], "left_semi").select(*spark.createDataFrame([], R.EXTRACTION).columns)
        extracted = staged(fresh.mapInPandas(R._extract_rows, R.EXTRACTION).unionByName(kept), "extractions")
        reused = marked.where("reused").count()
        parsed = len(found) - reused
    bad = extracted.where("error IS NOT NULL").select("path", "error").first()
    if bad is not None:
        raise ValueError(f"{bad['path']}: {bad['error']}")
    return Index(graph_of(spark, root, extracted, found, catalog), extracted, parsed, reused)


def graph_of(spark: SparkSession, root: str, extracted: DataFrame, found: list[tuple[str, str]], catalog: set[str]) -> Graph:
    """Files, definitions and edges of extractions; ids follow the sorted paths and the order in each file."""
    ids = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(found)], "file_id long, path string")
    files = extracted.join(ids, "path")
    table = staged(files.select("file_id", "path", X.parent_dir(F.col("path")).alias("dir"), "lang", "content_hash"), "files")
    defs = files.select("file_id", F.posexplode("defs").alias("local_idx", "d")).select("file_id", "local_idx", *[F.col(f"d.{f}").alias(f) for f in DEF_FIELDS])
    defs = defs.withColumns({"def_id": F.shiftleft("file_id", SHIFT) + F.col("local_idx"), "short_name": X.short_name(F.col("name"))})
    defs = staged(defs, "defs")
    refs = files.select("file_id", F.explode("refs").alias("r")).select("file_id", (F.shiftleft("file_id", SHIFT) + F.col("r.from_idx")).alias("from_def"), "r.ref_kind", "r.name")
    go_mod = os.path.join(root, "go.mod")
    module = go_lang.module_prefix(open(go_mod, encoding="utf-8").read()) if os.path.exists(go_mod) else None
    roots = sorted({p.rpartition("/")[0] for p in catalog if p.rpartition("/")[2] in ("lib.rs", "main.rs")})
    raws = files.where(F.size("imports") > 0).select("file_id", "path", "lang", F.col("imports.raw").alias("raws"))
    candidates = raws.mapInPandas(R.import_candidates(module, roots), "file_id long, ord int, priority int, candidate string")
    there = spark.createDataFrame([(p,) for p in sorted(catalog)], "path string")  # the repository's paths, as the driver's walk listed them
    hit = resolve.first_existing(candidates, there).select("file_id", "resolved")
    imports = staged(resolve.resolve_imports(hit, table), "imports")
    calls, reads = resolve.resolve_refs(refs, resolve.own_scopes(table, imports), defs, resolve.packages(table))
    return Graph(table, defs, resolve.contains_edges(defs), imports, staged(calls, "calls"), staged(reads, "reads"))


@dataclass
class Analysis:
    index: Index
    config: R.Config
    changed: int
    seeds: DataFrame | None  # (def_id, kind); None means that every test has to run
    reason: str = ""


AT = "array<long>"  # where a seed is first found: the change's place, a phase, and places within it


def _at(*parts) -> Column:
    return F.array(*[F.lit(p).cast("long") if isinstance(p, int) else p.cast("long") for p in parts])


def classify(spark: SparkSession, repo: str, start: str, index: Index, listed: DataFrame) -> tuple[DataFrame | None, str]:
    """Seeds (def_id, kind, at) of the changes listed (ord, path, status, old_path), or None with the reason why every test has to run: a changed
    configuration file, else the first change in order that cannot be traced. `at` orders seeds as they are found."""
    graph, none = index.graph, spark.createDataFrame([], f"def_id long, kind string, at {AT}")
    config = lambda c: F.when(X.is_config_file(F.col(c)), F.concat(F.lit("config file changed: "), F.col(c)))
    found = diff.first_reason(listed, F.coalesce(config("path"), config("old_path"))).first()
    if found is not None:
        return None, found["reason"]
    folder = X.parent_dir(F.col("path"))
    here = listed.join(graph.files.select("path", "file_id"), "path", "left")
    here = here.withColumns({"lang": X.language(F.col("path")), "needles": X.needles(F.col("path"))})
    gone, go = F.col("status") == "Deleted", F.col("lang") == "go"
    here = here.withColumn("needles", F.when(gone & go, F.array_union("needles", X.needles(folder))).when(gone | F.col("lang").isNull(), F.col("needles")))
    here = staged(here, "changes")
    untraced = F.when(gone & F.col("lang").isNotNull() & (F.size("needles") == 0), F.concat(F.lit("deleted file cannot be traced: "), "path"))
    unknown = F.when(~gone & F.col("lang").isNotNull() & F.col("file_id").isNull(), F.concat(F.lit("changed file is not in the index: "), "path"))
    diffed = here.where("status IN ('Modified', 'Renamed') AND lang IS NOT NULL AND file_id IS NOT NULL")
    rows = diffed.select("ord", "path", "lang", "file_id", F.coalesce("old_path", "path").alias("old")).orderBy("ord").collect()  # changed files
    try:
        sources = R.show_files(repo, start, [r["old"] for r in rows]) if rows else {}
    except R.GitError as e:
        return None, f"{rows[0]['path']}: {e}"
    known = [r for r in rows if sources[r["old"]] is not None]
    before = staged(R.extractions(spark, [("", r["path"], r["lang"], sources[r["old"]]) for r in known]), "old")
    errors = before.where("error IS NOT NULL").select("path", F.concat("path", F.lit(": "), "error").alias("broken"))
    found = diff.first_reason(here.join(errors, "path", "left"), F.coalesce(untraced, unknown, F.col("broken"))).first()
    if found is not None:
        return None, found["reason"]
    modules = graph.defs.where("kind = 'ModuleInit'").select("file_id", "def_id")
    init = lambda files, *at: modules.join(files, "file_id").select("def_id", F.lit("module_init").alias("kind"), _at(*at).alias("at"))
    siblings = resolve.same_directory(graph.files, here.where(gone & go))
    siblings = graph.files.join(siblings, "file_id", "left_semi").select("file_id", "dir").join(here.where(gone & go).select("ord", folder.alias("dir")), "dir")
    fresh = spark.createDataFrame([(r["ord"], r["file_id"]) for r in rows if sources[r["old"]] is None], "ord int, file_id long")  # nothing there before
    fresh = fresh.unionByName(here.where("status = 'Added' AND lang IS NOT NULL").select("ord", "file_id"))
    added = graph.defs.where("kind IN ('TestCase', 'ModuleInit')").join(fresh, "file_id")
    added = added.select("def_id", F.lit("added").alias("kind"), _at(F.col("ord"), (F.col("kind") == "ModuleInit").cast("int"), F.col("local_idx")).alias("at"))
    seeds = none.unionByName(init(siblings, F.col("ord"), F.col("file_id"))).unionByName(added)
    seeds = seeds.unionByName(changed_seeds(graph, before, spark.createDataFrame([(r["path"], r["file_id"], r["ord"]) for r in known], "path string, file_id long, ord int")))
    needles = here.select(F.explode("needles").alias("needle")).distinct()
    raw = index.extracted.select("path", F.explode("imports.raw").alias("raw")).join(graph.files.select("path", "file_id"), "path")
    seeds = seeds.unionByName(init(diff.scan_importers(raw, needles), 1 << 40, F.col("file_id")))
    return staged(seeds.groupBy("def_id", "kind").agg(F.min("at").alias("at")), "seeds"), ""


def changed_seeds(graph: Graph, before: DataFrame, at: DataFrame) -> DataFrame:
    """(def_id, kind, at) of files (path, file_id, ord) whose old and new definitions both are known."""
    old = before.join(at.select("path", "file_id"), "path").select("file_id", F.posexplode("defs").alias("local_idx", "d")).select("file_id", "local_idx", *[F.col(f"d.{f}").alias(f) for f in DEF_FIELDS])
    new = graph.defs.join(at.select("file_id"), "file_id", "left_semi")
    keyed = lambda df: df.withColumns({"k": F.col("kind"), "chain": X.test_name(F.col("test_id"), F.col("name"))})
    found = diff.diff_defs(keyed(old), keyed(new), ["file_id", "k", "chain"], ["local_idx"]).withColumn("kind", diff.seed_kind(F.col("change")))
    idx = F.when(F.col("kind") == "module_init", F.lit(0)).otherwise(F.col("new_idx"))
    found = found.withColumn("def_id", F.shiftleft("file_id", SHIFT) + idx).join(at.select("file_id", "ord"), "file_id")
    return found.select("def_id", "kind", _at(F.col("ord"), F.col("seen.gone").cast("int"), F.col("seen.first"), F.col("seen.ordinal")).alias("at"))


def analyze(spark: SparkSession, repo: str, start: str, end: str | None = None) -> Analysis:
    """Indexes the tree (or revision `end`) and classifies the changes since `start`; the snapshot is saved after changes are listed."""
    try:
        holder = R.snapshot(repo, end, shared_dir(spark)) if end else nullcontext(repo)
        with holder as root:
            config = R.load_config(root)
            index = build_index(spark, root, None if end else load_snapshot(spark, root), config.ignore)
            try:
                diffed, extra = R.diffed_files(repo, start, end), [] if end else R.untracked_files(repo)
            except R.GitError as e:
                return Analysis(index, config, 0, None, f"changes cannot be listed: {e}")
            listed = spark.createDataFrame([(i, *c) for i, c in enumerate(diffed)], "ord int, path string, status string, old_path string")
            listed = staged(diff.all_changes(listed, spark.createDataFrame([(len(diffed) + i, p) for i, p in enumerate(extra)], "ord int, path string")), "listed")
            seeds, reason = classify(spark, repo, start, index, listed.where(X.first_glob(F.col("path"), list(config.ignore)).isNull()))
            if not end:
                save_snapshot(index.extracted, root)
            return Analysis(index, config, listed.count(), seeds, reason)
    except R.GitError as e:
        empty = spark.createDataFrame([], R.EXTRACTION)
        return Analysis(Index(graph_of(spark, repo, empty, [], set()), empty, 0, 0), R.Config(), 0, None, f"revision cannot be read: {e}")


def tests_of(graph: Graph) -> DataFrame:
    """(def_id, file, name, runner, lang, computed) of all test cases."""
    own = lambda c, kind: F.col(c) if c in graph.defs.columns else F.lit(None).cast(kind)
    tests = graph.defs.where("kind = 'TestCase'").withColumns({"test_id": own("test_id", "array<string>"), "computed": F.coalesce(own("computed_name", "boolean"), F.lit(False))})
    tests = tests.join(graph.files.select("file_id", "path", "lang"), "file_id")
    return tests.select("def_id", F.col("path").alias("file"), X.test_name(F.col("test_id"), F.col("name")).alias("name"), X.runner(F.col("lang")).alias("runner"), "lang", "computed")


def report(tests: DataFrame) -> DataFrame:
    """(test): each test's line of the JSON report."""
    return tests.select(F.to_json(F.struct("file", "name", "runner", "lang", "computed")).alias("test"))


def selected(graph: Graph, seeds: DataFrame, always_run: list[str]) -> DataFrame:
    """The selected tests of tests_of: walked ones and those that an always-run glob matches, as one set."""
    tests = tests_of(graph)
    always = tests.where(X.first_glob(F.col("file"), always_run).isNotNull()).select("def_id")
    return tests.join(walk.impacted_tests(graph, seeds).union(always).distinct(), "def_id", "left_semi")


def candidates(tests: DataFrame, visited: DataFrame, always_run: list[str], query: str) -> DataFrame:
    """(def_id, file, name, match_str, walked, always_run_glob) of the selected tests whose `file :: name` holds the query; the walk explains first."""
    tests = tests.withColumn("match_str", F.concat(F.col("file"), F.lit(" :: "), F.array_join("name", " > ")))
    tests = tests.where(F.contains("match_str", F.lit(query))).withColumn("glob", X.first_glob(F.col("file"), always_run))
    walked = tests.join(visited.select("def_id", F.lit(True).alias("walked")), "def_id", "left").withColumn("walked", F.coalesce("walked", F.lit(False)))
    return walked.where("walked OR glob IS NOT NULL").select("def_id", "file", "name", "match_str", "walked", F.when(~F.col("walked"), F.col("glob")).alias("always_run_glob"))


def explained(graph: Graph, seeds: DataFrame, always_run: list[str], query: str) -> DataFrame:
    """(def_id, file, name, match_str, always_run_glob, path) of candidates; paths are resolved for those of the walk alone."""
    visited = walk.impact(graph, seeds)
    tests = candidates(tests_of(graph), visited, always_run, query)
    found = walk.paths(visited, tests.where("walked"))
    out = tests.join(found, "def_id", "left")
    return out.select("def_id", "file", "name", "match_str", "always_run_glob", F.coalesce("path", F.array().cast(found.schema["path"].dataType)).alias("path"))


def select(a: Analysis) -> DataFrame:
    return selected(a.index.graph, a.seeds, list(a.config.always_run)).orderBy(X.path_order(F.col("file")), "def_id")


def why(a: Analysis, query: str) -> DataFrame:
    return explained(a.index.graph, a.seeds, list(a.config.always_run), query).orderBy("def_id")


def index_report(spark: SparkSession, root: str, full: bool = False) -> dict:
    began = time.time()
    config = R.load_config(root)
    index = build_index(spark, root, None if full else load_snapshot(spark, root), config.ignore)
    save_snapshot(index.extracted, root)
    row = stats(index.graph).first().asDict()
    return {"version": VERSION, **{k: row[k] for k in ("files", "defs", "tests")}, "parsed": index.parsed, "reused": index.reused, "ms": int(1000 * (time.time() - began)), **{k: row[k] for k in ("calls", "reads", "unresolved")}}
