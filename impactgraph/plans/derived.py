"""A property graph over the star-schema tables; one SQL text serves Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import Graph

TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem")
N = "(SELECT count(*) FROM supplier)"
SQL = {
    "files": "SELECT s_suppkey AS file_id, concat('src/', n_name, '/', s_name, '.ts') AS path, concat('src/', n_name) AS dir, CASE s_suppkey % 3 WHEN 0 THEN 'ts' WHEN 1 THEN 'go' ELSE 'rust' END AS lang FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "defs": f"""SELECT s_suppkey AS def_id, s_suppkey AS file_id, '<module>' AS name, '<module>' AS short_name, 'ModuleInit' AS kind FROM supplier
      UNION ALL SELECT 1000000 + p_partkey, p_partkey % {N}, p_name, split_part(p_name, '.', -1), 'Function' FROM part
      UNION ALL SELECT 2000000 + o_orderkey, o_custkey % {N}, concat('test ', cast(o_orderkey AS varchar(20))), concat('test ', cast(o_orderkey AS varchar(20))), 'TestCase' FROM orders""",
    "contains": "SELECT 1000000 + p_partkey - p_partkey % 10 AS parent, 1000000 + p_partkey AS child FROM part WHERE p_partkey % 10 <> 0",
    "imports": f"""SELECT s_suppkey AS from_file, cast(floor(s_suppkey / 2) AS bigint) AS to_file FROM supplier WHERE s_suppkey > 0
      UNION SELECT s_suppkey, s_suppkey + 1 FROM supplier WHERE s_suppkey % 10 = 4 AND s_suppkey + 1 < {N}
      UNION SELECT s_suppkey + 1, s_suppkey FROM supplier WHERE s_suppkey % 10 = 4 AND s_suppkey + 1 < {N}""",
    "known_calls": f"""SELECT 2000000 + l_orderkey AS from_def, 1000000 + l_partkey AS to_def FROM lineitem WHERE l_linenumber = 1
      UNION SELECT 1000000 + p_partkey, 1000000 + cast(floor(p_partkey / 2) AS bigint) FROM part WHERE p_partkey > 0
      UNION SELECT 2000000 + o_orderkey, 1999999 + o_orderkey FROM orders WHERE o_orderkey % 5 = 1
      UNION SELECT s_suppkey, 1000000 + 5 * s_suppkey FROM supplier WHERE s_suppkey % 7 = 3 AND 5 * s_suppkey IN (SELECT p_partkey FROM part)""",
    "unknown_calls": "SELECT DISTINCT 2000000 + l_orderkey AS from_def, p_name AS unknown_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 3 AND l_discount > 0.08",
    "reads": "SELECT DISTINCT 2000000 + l_orderkey AS from_def, 1000000 + l_partkey AS to_def FROM lineitem WHERE l_linenumber = 2 AND l_returnflag = 'R'",
}
SEEDS = {"small": [1000063, 1000064], "module": [4], "widen": [1000015]}

#: CTEs of the derived graph, for oracles.
WITH = ",\n".join(f"{k} AS ({v})" for k, v in SQL.items())
#: Every rule as one reverse edge list (src impacted means dst impacted).
REVERSE = """closure AS (SELECT file_id AS root, file_id AS member FROM files UNION SELECT c.root, i.from_file FROM closure c JOIN imports i ON i.to_file = c.member),
rev AS (
  SELECT to_def AS src, from_def AS dst FROM known_calls UNION SELECT to_def, from_def FROM reads
  UNION SELECT c.child, c.parent FROM contains c JOIN defs d ON d.def_id = c.parent WHERE d.kind <> 'ModuleInit'
  UNION SELECT d.def_id, u.from_def FROM defs d JOIN unknown_calls u ON u.unknown_name = d.short_name JOIN defs f ON f.def_id = u.from_def JOIN closure c ON c.root = d.file_id AND c.member = f.file_id
  UNION SELECT m.def_id, t.def_id FROM defs m JOIN closure c ON c.root = m.file_id JOIN defs t ON t.file_id = c.member WHERE m.kind = 'ModuleInit' AND t.kind IN ('ModuleInit', 'TestCase') AND t.def_id <> m.def_id)"""


def tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    for t in names:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def frame(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(SQL[name])


def derived(spark: SparkSession, sf_dir: str) -> Graph:
    tables(spark, sf_dir)
    known = frame(spark, "known_calls").selectExpr("from_def", "to_def", "cast(null AS string) AS unknown_name")
    unknown = frame(spark, "unknown_calls").selectExpr("from_def", "cast(null AS bigint) AS to_def", "unknown_name")
    return Graph(frame(spark, "files"), frame(spark, "defs"), frame(spark, "contains"), frame(spark, "imports"), known.unionByName(unknown), frame(spark, "reads"))


def seeds(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([(d, "body") for d in SEEDS[name]], "def_id long, kind string")
