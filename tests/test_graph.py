"""Graph operators on hand-built graphs."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from impactgraph.functions import scalars as X
from impactgraph.operators import closure, diff, resolve, walk
from impactgraph.operators.graph import Graph


def graph(spark, defs, contains=(), imports=(), calls=(), reads=()):
    """defs: (id, file, name, kind)."""
    files = sorted({d[1] for d in defs} | {f for e in imports for f in e})
    return Graph(
        spark.createDataFrame([(f, f"src/{f}.ts", "src", "ts") for f in files], "file_id long, path string, dir string, lang string"),
        spark.createDataFrame([(*d, d[2].rsplit(".", 1)[-1]) for d in defs], "def_id long, file_id long, name string, kind string, short_name string"),
        spark.createDataFrame(list(contains), "parent long, child long"),
        spark.createDataFrame(list(imports), "from_file long, to_file long"),
        spark.createDataFrame(list(calls), "from_def long, to_def long, unknown_name string"),
        spark.createDataFrame(list(reads), "from_def long, to_def long"),
    )


@pytest.fixture(scope="module")
def small(spark):
    defs = [(0, 0, "<module>", "ModuleInit"), (1, 0, "add", "Function"), (2, 0, "Calc", "Class"), (3, 0, "Calc.push", "Method"),
            (10, 1, "<module>", "ModuleInit"), (11, 1, "calculate", "Function"), (12, 1, "t1", "TestCase"),
            (20, 2, "<module>", "ModuleInit"), (21, 2, "t2", "TestCase"), (30, 3, "<module>", "ModuleInit"), (31, 3, "t3", "TestCase"), (41, 4, "t4", "TestCase")]
    return graph(spark, defs, contains=[(2, 3), (0, 1)], imports=[(1, 0), (2, 1), (4, 2), (2, 4)], calls=[(11, 1, None), (12, 11, None), (21, None, "push"), (31, None, "push"), (3, 2, None)], reads=[(2, 1)])


def reached(small, spark, *ids):
    out = walk.impact(small, spark.createDataFrame([(i,) for i in ids], "def_id long")).collect()
    return {r["def_id"]: (r["depth"], r["pred"], r["edge"], r["unknown_name"]) for r in out}


def test_calls_reads_and_paths(small, spark):
    seeds = spark.createDataFrame([(1,), (99,)], "def_id long")
    visited = walk.impact(small, seeds)
    got = {r["def_id"]: (r["depth"], r["edge"]) for r in visited.collect()}
    # The class reads add; its method calls the class; unresolved calls of push widen only where files import file 0.
    assert got == {1: (0, None), 11: (1, "calls"), 2: (1, "reads"), 12: (2, "calls"), 3: (2, "calls"), 21: (3, "unknown_name")}
    paths = {r["def_id"]: [(h["from_def"], h["edge"], h["to_def"]) for h in r["path"]] for r in walk.paths(visited, spark.createDataFrame([(12,), (1,), (31,)], "def_id long")).collect()}
    assert paths == {12: [(1, "calls", 11), (11, "calls", 12)], 1: []}


def test_unknown_names_need_an_import(small, spark):
    got = reached(small, spark, 3)
    assert got[21] == (1, 3, "unknown_name", "push") and 31 not in got and got[2][2] == "contains"


def test_module_closure_is_one_hop(small, spark):
    got = reached(small, spark, 0)
    assert {d: got[d][:2] for d in (10, 12, 20, 21, 41)} == {d: (1, 0) for d in (10, 12, 20, 21, 41)} and 30 not in got and 31 not in got


def test_no_seeds_and_cycles(small, spark):
    assert reached(small, spark, 99) == {}
    cyc = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 3)], "src long, dst long")
    pairs = closure.reachable_pairs(cyc, spark.createDataFrame([(1,), (9,)], "root long")).collect()
    assert sorted((r["root"], r["member"]) for r in pairs) == [(1, 1), (1, 2), (1, 3), (9, 9)]


def test_overloads_pair_in_order(spark):
    schema = "file_id long, kind string, name string, local_idx int, sig_hash string, body_hash string"
    old = spark.createDataFrame([(1, "Function", "f", 1, "a", "x"), (1, "Function", "f", 2, "b", None), (1, "Function", "g", 3, "c", "y"), (1, "ModuleInit", "<module>", 0, "m", None)], schema)
    new = spark.createDataFrame([(1, "Function", "f", 1, "a", "x"), (1, "Function", "f", 2, "B", "z"), (1, "Function", "h", 3, "c", "y"), (1, "ModuleInit", "<module>", 0, "n", None), (1, "Function", "f", 4, "a", "x")], schema)
    got = {(r["name"], r["ordinal"]): (r["change"], r["new_idx"]) for r in diff.diff_defs(old, new, ["file_id", "name"], ["local_idx"]).collect()}
    assert got == {("f", 2): ("SigChanged", 2), ("f", 3): ("Added", 4), ("g", 1): ("Removed", None), ("h", 1): ("Added", 3), ("<module>", 1): ("ModuleInitChanged", 0)}


def test_imports_fan_out_only_when_no_file_matches(spark):
    files = spark.createDataFrame([(1, "a/x.go", "a"), (2, "a/y.go", "a"), (3, "b", ""), (4, "b/z.go", "b")], "file_id long, path string, dir string")
    targets = spark.createDataFrame([(4, "a"), (4, "a"), (1, "b"), (1, "a"), (2, "none")], "file_id long, resolved string")
    assert sorted(map(tuple, resolve.resolve_imports(targets, files).collect())) == [(1, 2), (1, 3), (4, 1), (4, 2)]


def test_self_recursion_alone_stays_unknown(spark):
    defs = spark.createDataFrame([(1, 1, "solo", "solo", "Function")], "def_id long, file_id long, name string, short_name string, kind string")
    refs = spark.createDataFrame([(1, 1, "call", "solo"), (1, 1, "read", "gone")], "file_id long, from_def long, ref_kind string, name string")
    scope = spark.createDataFrame([(1, 1)], "file_id long, target_file long")
    calls, reads = resolve.resolve_refs(refs, scope, defs)
    assert [tuple(r) for r in calls.collect()] == [(1, None, "solo")] and reads.count() == 0


@pytest.mark.parametrize("pattern,yes,no", [
    ("**/*.ts", ["a.ts", "x/y/a.ts"], ["a.tsx"]), ("src/*", ["src/a", "src/a/b"], ["src", "lib/a"]), ("a?c", ["abc", "a/c"], ["ac"]),
    ("{a,b}/[c-e]*", ["a/cat", "b/dog"], ["c/cat", "a/bat"]), ("x/**", ["x/a/b"], ["x"]), ("[!a]b", ["cb"], ["ab"]), ("a.b", ["a.b"], ["axb"])])
def test_globs(spark, pattern, yes, no):
    df = spark.createDataFrame([(p,) for p in yes + no], "path string")
    assert [r[0] for r in df.where(X.first_glob(F.col("path"), [pattern]).isNotNull()).collect()] == yes


def test_bad_globs():
    for g in ("a[b", "{a,b"):
        with pytest.raises(ValueError):
            X.glob_regex(g)


def test_command_lines(spark):
    weird = "a\"b$c`d\\e'f"
    rows = [("src/a b.ts", ["x", weird], "ts", False), ("src/a.ts", ["x"], "ts", True), ("p/a_test.go", ["TestA$b", "<computed>"], "go", True), ("a_test.go", [weird], "go", False), ("src/a.rs", ["tests", "works"], "rust", False), ("src/a.rs", [weird], "rust", True), ("x.py", ["t"], "py", False)]
    df = spark.createDataFrame(rows, "path string, name array<string>, lang string, computed boolean")
    got = [r[0] for r in df.select(X.command_line(F.col("path"), F.col("name"), F.col("lang"), F.col("computed"))).collect()]
    quoted = "a\"b$c`d\\e'\\''f"
    assert got == [f"vitest run 'src/a b.ts' -t 'x > {quoted}'", "vitest run src/a.ts", "go test ./p -run '^TestA\\$b$/.*'", "go test . -run '^a\"b\\$c`d\\\\e'\\''f$'", "cargo test tests::works -- --exact", f"cargo test '{quoted}'", None]


def test_path_functions(spark):
    df = spark.createDataFrame([("a/b/config.json",), (".env",), ("io.ts",), ("x.tar.gz",)], "p string")
    p = F.col("p")
    got = [tuple(r) for r in df.select(X.parent_dir(p), X.stem(p), X.needles(p), X.language(p)).collect()]
    assert got == [("a/b", "config", ["config.json", "config"], None), ("", ".env", [".env"], None), ("", "io", ["io.ts"], "ts"), ("", "x.tar", ["x.tar.gz", "x.tar"], None)]
    assert [r[0] for r in spark.createDataFrame([("a-b",), ("a/b",)], "p string").orderBy(X.path_order(p)).collect()] == ["a/b", "a-b"]


def test_stream_answers_batches(small, spark, tmp_path):
    from impactgraph.streaming.commits import watch

    spark.createDataFrame([(1,)], "def_id long").write.parquet(f"{tmp_path}/in")
    got = []
    q = watch(spark.readStream.schema("def_id long").parquet(f"{tmp_path}/in"), lambda: small, lambda tests, n: got.extend(r[0] for r in tests.collect()), f"{tmp_path}/check", once=True)
    q.awaitTermination(120)
    assert sorted(got) == [12, 21]


def test_packages_resolve_without_pairs_of_files(spark):
    """Equal to a scope of all pairs, on files without a directory, repeated definitions, referrers of two files and files of two directories."""
    files = spark.createDataFrame([(1, "a", "go"), (2, "a", "ts"), (3, "b", "go"), (4, "b", "go"), (4, "a", "go"), (5, None, "go"), (6, "c", None), (2, "b", "ts")], "file_id long, dir string, lang string")
    imports = spark.createDataFrame([(1, 2), (1, 3), (2, 6), (5, 1), (6, 6), (4, 3)], "from_file long, to_file long")
    defs = [(10 * f + k, f, n, "Function") for f in range(1, 7) for k, n in enumerate("xyz"[: f % 3 + 1])] + [(10, 2, "x", "Function"), (10, 3, "q", "Class"), (7, 3, "x", "ModuleInit"), (12, 1, "solo", "Function")]
    defs = spark.createDataFrame(defs, "def_id long, file_id long, short_name string, kind string")
    refs = [(f, d, kind, n) for f in (1, 2, 3, 4, 5, 6, None, 9) for d in ((f or 0) * 10, 10, None) for kind in ("call", "read") for n in ("x", "y", "q", "none", None)]
    refs = spark.createDataFrame([*refs, *refs[:9], (1, 12, "call", "solo"), (1, 12, "read", "solo")], "file_id long, from_def long, ref_kind string, name string")
    scope, targets = defaultdict(set), defaultdict(set)
    for f, t in [tuple(r) for r in resolve.scopes(files, imports).collect()]:
        scope[f].add(t)
    for d in defs.where("kind <> 'ModuleInit'").collect():
        targets[d["file_id"], d["short_name"]].add(d["def_id"])
    found, asked = defaultdict(set), set()
    for f, d, kind, n in map(tuple, refs.collect()):
        asked |= {(d, n)} if kind == "call" else set()
        found[kind, d, n] |= set().union(*(targets[t, n] for t in scope[f] if f)) - {d} if d is not None and n else set()
    edges = lambda kind: sorted({(d, t) for (k, d, _), to in found.items() for t in to if k == kind})
    unknown = sorted(((d, n) for d, n in asked if not found["call", d, n]), key=str)
    calls, reads = resolve.resolve_refs(refs, resolve.own_scopes(files, imports), defs, resolve.packages(files))
    assert sorted(map(tuple, reads.collect())) == edges("read")
    rows = calls.collect()
    assert sorted((r["from_def"], r["to_def"]) for r in rows if r["to_def"] is not None) == edges("call")
    assert sorted(((r["from_def"], r["unknown_name"]) for r in rows if r["to_def"] is None), key=str) == unknown
    by_pairs = resolve.resolve_refs(refs, resolve.scopes(files, imports), defs)[0].collect()
    assert sorted(map(str, by_pairs)) == sorted(map(str, rows))


def test_walk_lays_out_no_product_of_names_and_callers(spark, monkeypatch):
    """60 functions of one name in a file, 60 callers by that name in a file that imports it: 3,600 edges in all, none of which is stored."""
    defs = [(0, 0, "<module>", "ModuleInit"), (1, 1, "<module>", "ModuleInit")] + [(100 + i, 0, f"c{i}.push", "Method") for i in range(60)] + [(200 + i, 1, f"t{i}", "TestCase") for i in range(60)]
    g = graph(spark, defs, imports=[(1, 0)], calls=[(200 + i, None, "push") for i in range(60)] + [(100 + i, 99 + i, None) for i in range(1, 8)])
    seen = []
    kept = walk.staged
    monkeypatch.setattr(walk, "staged", lambda df, name: seen.append((name, (out := kept(df, name)).count())) or out)
    got = {r["def_id"]: (r["depth"], r["pred"], r["edge"]) for r in walk.impact(g, spark.createDataFrame([(105,), (103,)], "def_id long")).collect()}
    assert {d: got[d] for d in range(200, 260)} == {d: (1, 103, "unknown_name") for d in range(200, 260)}
    assert got[104] == (1, 103, "calls") and got[107] == (2, 106, "calls") and 102 not in got
    assert max(n for _, n in seen) <= len(defs)


def test_unknown_calls_are_told_without_edges(spark):
    """200 Go files of one directory, each with a function `f` and calls of `f` and `g`: 39,800 edges; unknown names are told by the least and greatest target."""
    files = spark.createDataFrame([(f, "a", "go") for f in range(200)], "file_id long, dir string, lang string")
    defs = spark.createDataFrame([(1000 + f, f, "f", "Function") for f in range(200)], "def_id long, file_id long, short_name string, kind string")
    refs = spark.createDataFrame([(f, 1000 + f, "call", n) for f in range(200) for n in "fg"], "file_id long, from_def long, ref_kind string, name string")
    none = spark.createDataFrame([], "from_file long, to_file long")
    calls, _ = resolve.resolve_refs(refs, resolve.own_scopes(files, none), defs, resolve.packages(files))
    unknown = calls.where("unknown_name IS NOT NULL")
    assert sorted(map(tuple, unknown.collect())) == [(1000 + f, None, "g") for f in range(200)]
    assert calls.where("to_def IS NOT NULL").count() == 200 * 199


def test_edges_of_one_name_are_dealt_out(spark):
    """A Go directory of 40 files, with 2,000 functions `f` and 2,000 calls of `f`: 4,000,000 edges under one key, of which no task makes more than its share, and none is
    shuffled though an id also stands for a name that nobody asks for."""
    files = spark.createDataFrame([(f, "a", "go") for f in range(40)], "file_id long, dir string, lang string")
    defs = spark.range(2000).selectExpr("1000 + id AS def_id", "id % 40 AS file_id", "'f' AS short_name", "'Function' AS kind")
    defs = defs.unionByName(defs.selectExpr("def_id", "file_id", "concat('test ', def_id) AS short_name", "'TestCase' AS kind"))
    refs = spark.range(2000).selectExpr("id % 40 AS file_id", "100000 + id AS from_def", "'call' AS ref_kind", "'f' AS name")
    none = spark.createDataFrame([], "from_file long, to_file long")
    calls, _ = resolve.resolve_refs(refs, resolve.own_scopes(files, none), defs, resolve.packages(files))
    edges = calls.where("to_def IS NOT NULL").select("from_def", "to_def")
    tasks = [r["count"] for r in edges.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(tasks) == 2000 * 2000 and max(tasks) < 0.8 * sum(tasks)
    assert "[from_def#" not in "".join(x for x in edges._jdf.queryExecution().executedPlan().toString().splitlines() if "HashAggregate" in x)
    ends = edges.agg(F.count_distinct("from_def"), F.count_distinct("to_def")).first()
    assert tuple(ends) == (2000, 2000) and edges.groupBy("from_def").count().agg(F.min("count"), F.max("count")).first()[:] == (2000, 2000)
