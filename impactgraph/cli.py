"""Command line: index, stats, changes, select, why. Exit codes: 0 done, 2 run every test, 1 error or no single explanation."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import scalars as X
from .plans import commands as C
from .sources import repo as R

# The words of `why` and of the reports, which users' scripts read.
VERBS = {"calls": "called by", "reads": "read by", "contains": "contained in", "import_closes": "imported by"}


def _labels(a: C.Analysis, ids: set[int]) -> dict[int, tuple[str, str]]:
    """Name and file of the definitions that a report shows."""
    spark = a.index.graph.defs.sparkSession
    wanted = spark.createDataFrame([(i,) for i in ids], "def_id long")
    rows = a.index.graph.defs.join(wanted, "def_id", "left_semi").join(a.index.graph.files.select("file_id", "path"), "file_id").select("def_id", "name", "path").collect()
    return {r["def_id"]: (r["name"], r["path"]) for r in rows}


def why_lines(row, label) -> list[str]:
    test = f'= test "{" > ".join(row["name"])}" ({row["file"]})'
    if row["always_run_glob"]:
        return [f"selected by always-run glob '{row['always_run_glob']}'", f"  {test}"]
    if not row["path"]:
        return [test]
    name, file = label[row["path"][0]["from_def"]]
    out = [f"changed {name} ({file})"]
    for hop in row["path"][:-1]:
        name, file = label[hop["to_def"]]
        verb = VERBS.get(hop["edge"]) or f'possibly called by (unresolved name "{hop["unknown_name"]}")'
        out.append(f"  {verb} {name} ({file})")
    return [*out, f"  {test}"]


def why_json(row, label) -> dict:
    point = lambda d: dict(zip(("name", "file"), label[d], strict=True))
    edge = lambda h: {"unknown_name": h["unknown_name"]} if h["edge"] == "unknown_name" else h["edge"]
    out = {"version": 1, "mode": "explained", "test": {"file": row["file"], "name": list(row["name"])}, "path": [{"from": point(h["from_def"]), "edge": edge(h), "to": point(h["to_def"])} for h in row["path"]]}
    return out | ({"always_run": row["always_run_glob"]} if row["always_run_glob"] else {})


def run(spark: SparkSession, argv: list[str], out=None, err=None) -> int:
    out, err = out or sys.stdout, err or sys.stderr
    parser = argparse.ArgumentParser(prog="impactgraph")
    parser.add_argument("--root", default=os.getcwd())
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("index").add_argument("--full", action="store_true")
    sub.add_parser("stats")
    for name in ("changes", "select", "why"):
        p = sub.add_parser(name)
        if name == "why":
            p.add_argument("test")
        p.add_argument("--from", dest="start", required=True)
        p.add_argument("--to", dest="end")
        p.add_argument("--format", choices=("json", "text", "args"), default="json")
    args = parser.parse_args(argv)
    say = lambda x: print(x if isinstance(x, str) else R.to_json(x), file=out)
    try:
        if args.command == "index":
            say(C.index_report(spark, args.root, args.full))
            return 0
        if args.command == "stats":
            had = C.load_snapshot(spark, args.root)
            if had is None:
                raise ValueError("no index; run index first")
            found, catalog = R.discover(args.root, R.load_config(args.root).ignore)
            row = C.stats(C.graph_of(spark, args.root, had, found, catalog)).first().asDict()
            path = C.snapshot_path(args.root)
            size = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)
            say({"version": 1, **{k: row[k] for k in ("files", "defs", "tests")}, "edges": row["calls"] + row["reads"] + row["imports"] + row["contains"], **{k: row[k] for k in ("calls", "reads", "unresolved")}, "cache_bytes": size})
            return 0
        a = C.analyze(spark, args.root, args.start, args.end)
        if a.seeds is None:
            if args.format == "json":
                say({"version": 1, "mode": "run_all", "reason": a.reason})
            else:
                print(f"run all: {a.reason}", file=err if args.command == "select" else out)
            return 2
        if args.command == "changes":
            rows = a.seeds.join(a.index.graph.defs, "def_id").join(a.index.graph.files, "file_id").select("def_id", "name", "path", a.seeds["kind"], "at").orderBy("at", "def_id", "kind").collect()
            if args.format == "json":
                say({"version": 1, "mode": "selection", "seeds": [{"def": r["name"], "file": r["path"], "kind": r["kind"]} for r in rows], "stats": {"changed_files": a.changed, "seeds": len(rows)}})
            else:
                say("\n".join(f"{r['path']} :: {r['name']} [{r['kind']}]" for r in rows) or "no impacted defs")
            return 0
        if args.command == "select":
            tests = C.select(a)
            n_seeds = a.seeds.count()
            total = a.index.graph.defs.where("kind = 'TestCase'").count()
            if args.format == "args":
                for r in tests.select(X.command_line(F.col("file"), F.col("name"), F.col("lang"), F.col("computed")).alias("line")).where("line IS NOT NULL").distinct().orderBy("line").collect():
                    say(r["line"])
                return 0
            if args.format == "json":
                rows = [json.loads(r["test"]) for r in C.report(tests).collect()]
                say({"version": 1, "mode": "selection", "tests": rows, "stats": {"total_known": total, "selected": len(rows), "seeds": n_seeds, "changed_files": a.changed}})
            else:
                rows = tests.collect()
                for r in rows:
                    say(f"{r['file']} :: {' > '.join(r['name'])}")
                print(f"selected {len(rows)}/{total} tests ({n_seeds} seeds, {a.changed} changed files)", file=err)
            return 0
        rows = C.why(a, args.test).collect()
        if not rows:
            say({"version": 1, "mode": "not_selected", "query": args.test} if args.format == "json" else f'not selected: no impacted test matches "{args.test}"')
            return 1
        if len(rows) > 1:
            say({"version": 1, "mode": "ambiguous", "query": args.test, "candidates": [{"file": r["file"], "name": list(r["name"])} for r in rows]} if args.format == "json" else "\n".join([f'ambiguous match for "{args.test}", candidates:', *(f"  {r['match_str']}" for r in rows)]))
            return 1
        label = _labels(a, {d for h in rows[0]["path"] for d in (h["from_def"], h["to_def"])})
        say(why_json(rows[0], label) if args.format == "json" else "\n".join(why_lines(rows[0], label)))
        return 0
    except ValueError as e:
        print(f"error: {e}", file=err)
        return 1


def main() -> int:
    spark = SparkSession.builder.appName("impactgraph").getOrCreate()
    return run(spark, sys.argv[1:])


if __name__ == "__main__":
    sys.exit(main())
