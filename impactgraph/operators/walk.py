"""The impact walk: which definitions, and so which tests, can observe a change of the seeds.

Rules: a caller or reader of an impacted definition is impacted; so is its container unless that is a module initialiser; so is a caller by an
unresolved name equal to its short name, if the caller's file imports its file, directly or not; an impacted module initialiser impacts the
initialisers and tests of all files that import its file, at one hop however long the import chain is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import discard, staged
from .closure import gathered, importer_closure
from .graph import Graph

#: Edge kinds in the order in which ties between equally short paths are broken.
EDGES = ("calls", "reads", "contains", "unknown_name", "import_closes")


def reverse_edges(graph: Graph) -> DataFrame:
    """(src, dst, rank): src impacted means dst impacted, for calls, reads and containers."""
    calls = graph.calls.where("to_def IS NOT NULL").select(F.col("to_def").alias("src"), F.col("from_def").alias("dst"), F.lit(0).alias("rank"))
    reads = graph.reads.select(F.col("to_def").alias("src"), F.col("from_def").alias("dst"), F.lit(1).alias("rank"))
    parents = graph.contains.join(graph.defs.where("kind <> 'ModuleInit'").select("def_id"), F.col("parent") == F.col("def_id"), "left_semi")
    return calls.unionByName(reads).unionByName(parents.select(F.col("child").alias("src"), F.col("parent").alias("dst"), F.lit(2).alias("rank")))


def fresh(rows: DataFrame, known: list[DataFrame], by: list[str], name: str) -> DataFrame:
    """The staged rows that no table of known holds. Known rows are first narrowed to those that rows ask for, so that a small round sorts no large table."""
    rows = staged(rows, name)
    if not known:
        return rows
    hit = reduce(DataFrame.unionByName, [k.select(*by).join(rows.select(*by), by, "left_semi") for k in known])
    out = staged(rows.join(hit, by, "left_anti"), name)
    discard(rows)
    return out


def impact(graph: Graph, seeds: DataFrame) -> DataFrame:
    """(def_id, depth, pred, edge, unknown_name): every impacted definition with its fewest hops and first predecessor.

    Seeds have depth 0 and no predecessor. Among equally short paths the predecessor is the least (edge kind, id, name). Edges by unresolved names and by
    the import closure are not laid out: of a round's definitions one a (file, name) and one initialiser a file are carried to the files that import it, and
    each (file, name) and each importing file is opened once, in its first round, as later ones reach nothing new.
    """
    edges = staged(reverse_edges(graph).repartition("src"), "reverse-edges")
    unknown = graph.calls.where("unknown_name IS NOT NULL").select(F.col("from_def").alias("to_def"), "unknown_name")
    unknown = staged(unknown.join(graph.defs.select(F.col("def_id").alias("to_def"), F.col("file_id").alias("member")), "to_def"), "unknown")
    named = graph.defs.select("def_id", F.col("file_id").alias("root"), F.col("short_name").alias("unknown_name"))
    named = staged(named.join(unknown.select("unknown_name").distinct(), "unknown_name", "left_semi"), "named")
    modules = staged(graph.defs.where("kind = 'ModuleInit'").select("def_id", F.col("file_id").alias("root")), "modules")
    members = staged(graph.defs.where("kind IN ('ModuleInit', 'TestCase')").select(F.col("def_id").alias("to_def"), F.col("file_id").alias("member")), "members")
    closure = staged(importer_closure(graph.imports, named.select("root").union(modules.select("root")).distinct()), "importers")
    front = seeds.select("def_id").distinct().join(graph.defs.select("def_id"), "def_id", "left_semi")
    empty = {"pred": F.lit(None).cast("long"), "rank": F.lit(None).cast("int"), "unknown_name": F.lit(None).cast("string")}
    front = staged(front.select("def_id", F.lit(0).alias("depth")).withColumns(empty), "walk")
    parts, opened, closed, depth = [front], [], [], 0
    none = F.lit(None).cast("string").alias("unknown_name")
    while True:
        depth += 1
        ids = front.select("def_id")
        near = ids.join(edges, F.col("def_id") == F.col("src")).select(F.col("dst").alias("to_def"), "rank", F.col("src").alias("from_def"), none)
        names = fresh(ids.join(named, "def_id").groupBy("root", "unknown_name").agg(F.min("def_id").alias("from_def")), opened, ["root", "unknown_name"], "names")
        wide = names.join(closure, "root").groupBy("member", "unknown_name").agg(F.min("from_def").alias("from_def"))
        wide = wide.join(unknown, ["member", "unknown_name"]).select("to_def", F.lit(3).alias("rank"), "from_def", "unknown_name")
        files = ids.join(modules, "def_id").groupBy("root").agg(F.min("def_id").alias("from_def")).join(closure, "root")
        files = fresh(files.groupBy("member").agg(F.min("from_def").alias("from_def")), closed, ["member"], "closed")
        far = files.join(members, "member").select("to_def", F.lit(4).alias("rank"), "from_def", none)
        new = near.unionByName(wide).unionByName(far).groupBy("to_def").agg(F.min(F.struct("rank", "from_def", "unknown_name")).alias("how"))
        new = new.select(F.col("to_def").alias("def_id"), F.lit(depth).alias("depth"), F.col("how.from_def").alias("pred"), F.col("how.rank").alias("rank"), F.col("how.unknown_name").alias("unknown_name"))
        front = fresh(new, parts, ["def_id"], "walk")
        opened, closed = gathered([*opened, names], "names"), gathered([*closed, files], "closed")
        if front.isEmpty():
            discard(front, edges, closure, modules, members, unknown, named, *opened, *closed)
            break
        parts = gathered([*parts, front], "walk", keep=1)
    names = F.array(*[F.lit(e) for e in EDGES])
    return reduce(DataFrame.unionByName, parts).select("def_id", "depth", "pred", F.when(F.col("rank").isNotNull(), F.element_at(names, F.col("rank") + 1)).alias("edge"), "unknown_name")


def impacted_tests(graph: Graph, seeds: DataFrame) -> DataFrame:
    """(def_id): the impacted test cases."""
    return impact(graph, seeds).join(graph.defs.where("kind = 'TestCase'").select("def_id"), "def_id", "left_semi").select("def_id")


def paths(visited: DataFrame, tests: DataFrame) -> DataFrame:
    """(def_id, path array<struct<from_def, edge, unknown_name, to_def>>): hops from the seed to each of the tests. A seeded test has an empty path.

    Predecessors are followed from the given tests only, so a filter on tests prunes the work.
    """
    hop = "struct<from_def:long,edge:string,unknown_name:string,to_def:long>"
    back = visited.select(F.col("def_id").alias("at"), "pred", "edge", "unknown_name")
    open_ = staged(tests.select("def_id").distinct().join(visited.select("def_id"), "def_id", "left_semi").select("def_id", F.col("def_id").alias("at"), F.array().cast(f"array<{hop}>").alias("path")), "paths")
    done = []
    while True:
        step = staged(open_.join(back, "at"), "paths")
        done = gathered([*done, staged(step.where("pred IS NULL").select("def_id", "path"), "paths")], "paths")
        more = step.where("pred IS NOT NULL")
        discard(open_)
        grown = F.concat(F.array(F.struct(F.col("pred").alias("from_def"), "edge", "unknown_name", F.col("at").alias("to_def")).cast(hop)), "path")
        open_ = staged(more.select("def_id", F.col("pred").alias("at"), grown.alias("path")), "paths")
        discard(step)
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, done)
