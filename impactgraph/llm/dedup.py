"""Exact deduplication with an extendible-hash index on shared files. DataFrame operations only.

A text's 64-bit key addresses a slot of a directory by its leading bits; the slot names a bucket of the index. The directory starts as one bucket
and doubles: each round splits the buckets that hold more than `capacity` keys by one more bit, the others keep their local depth. Only
counts move for that. Then the rows go to owner tasks, which hold ranges of (bucket, key): within a key, texts are compared by their bytes, equal ones become one entry
and different ones that share the key are chained. A document finds its entry through the directory: slot, bucket, key, and, where the key has a chain, its bytes.

Keys with more than one in `hot` of all rows, `hot` at most, are pre-aggregated before the shuffle and looked up by a broadcast of that bounded size, so
a group of copies that holds a third of all rows is no task's burden.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, discard, documents, spare, staged

OUT = ("keep_id", "group_size", "kept", "text_sha256")
MAX_DEPTH = 16


def default_key(norm: Column) -> Column:
    return F.xxhash64(norm)


def leading(bits: int, key: str = "key") -> Column:
    """The leading bits of a 64-bit key as a number."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def build_directory(keys: DataFrame, capacity: int, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(slot, bucket, depth): the directory over distinct keys (key): the slot is a key's max_depth leading bits, the bucket its first slot, depth its local depth.

    Doubling goes on while a bucket holds more than `capacity` keys, one bit a round, over counts by slot: 2 ** max_depth rows at most, whatever the number of
    keys. A bucket that shares all max_depth bits stays as it is, however full. Slots without keys are left out.
    """
    rest = staged(keys.groupBy(leading(max_depth).alias("slot")).agg(F.count("*").alias("entries")), "slots")
    parts, depth = [], 0
    while True:
        prefix = F.shiftright("slot", max_depth - depth)
        sized = rest.groupBy(prefix.alias("prefix")).agg(F.sum("entries").alias("held"))
        marked = staged(rest.withColumn("prefix", prefix).join(sized, "prefix"), "doubling")
        full = (F.col("held") > capacity) & F.lit(depth < max_depth)
        done = marked.where(~full).select("slot", F.shiftleft("prefix", max_depth - depth).alias("bucket"), F.lit(depth).alias("depth"))
        parts.append(done)
        rest = marked.where(full).select("slot", "entries")
        if rest.isEmpty():
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            return staged(out, "directory")
        depth += 1


def addressed(rows: DataFrame, directory: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """rows (key, ...) with the bucket that the directory gives their keys. The directory has 2 ** max_depth rows at most, so it is broadcast."""
    slot = spare(rows.columns, "__slot")
    named = F.broadcast(directory.select(F.col("slot").alias(slot), "bucket"))
    return rows.withColumn(slot, leading(max_depth)).join(named, slot).drop(slot)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 100_000, key=default_key, hot: int = 1000, part_bytes: int = 32 << 20) -> tuple[DataFrame, DataFrame]:
    """The directory, and the index on shared files: (bucket, key, chain, links, keep_id, group_size, text_sha256, norm, hot), one row a distinct text.

    chain is the entry's place in its key's chain, from 0, and links the chain's length; norm, the text, is kept only in chains of more than one. Files hold ranges of
    (bucket, key) in order.
    """
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn("key", key(F.col("norm")).cast("long"))
    counted = staged(rows.groupBy("key").agg(F.count("*").alias("rows"), F.sum(F.octet_length("norm")).alias("bytes")), "keys")
    total = counted.agg(F.sum("rows").alias("n"), F.sum("bytes").alias("bytes")).first()
    directory = build_directory(counted, capacity)
    often = staged(counted.where(F.col("rows") > F.lit((total["n"] or 0) / hot)).select("key"), "hot")  # fewer than `hot` rows
    rows = addressed(rows, directory)
    same = [F.max("id").alias("keep_id"), F.count("*").alias("group_size")]
    owners = int(max(1, -(-(total["bytes"] or 0) // part_bytes)))
    cold = rows.join(F.broadcast(often), "key", "left_anti").repartitionByRange(owners, "bucket", "key").groupBy("bucket", "key", "norm").agg(*same)
    warm = rows.join(F.broadcast(often), "key", "left_semi").groupBy("bucket", "key", "norm").agg(*same)
    of_key = Window.partitionBy("bucket", "key")

    def entries(df: DataFrame, is_hot: bool) -> DataFrame:
        df = df.withColumns({"chain": F.row_number().over(of_key.orderBy("norm")) - 1, "links": F.count("*").over(of_key), "text_sha256": F.sha2("norm", 256)})
        return df.withColumns({"norm": F.when(F.col("links") > 1, F.col("norm")), "hot": F.lit(is_hot) & (F.col("group_size") > F.lit((total["n"] or 0) / hot))})

    columns = ["bucket", "key", "chain", "links", "keep_id", "group_size", "text_sha256", "norm", "hot"]
    index = staged(entries(cold, False).unionByName(entries(warm, True)).select(*columns), "index")
    discard(counted, often)
    return directory, index


def lookup(docs: DataFrame, directory: DataFrame, index: DataFrame, id_col: str = "doc_id", text_col: str = "text", key=default_key) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256 of their entries; a row without an entry in the bucket that the directory names is lost."""
    docs = docs.drop(*OUT)
    names = docs.columns
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    own_key, own_bucket = spare(names, "__key"), spare(names, "__bucket")
    keyed = docs.withColumn(own_key, key(norm).cast("long"))
    slot = spare(keyed.columns, "__slot")
    named = F.broadcast(directory.select(F.col("slot").alias(slot), F.col("bucket").alias(own_bucket)))  # 2 ** max_depth rows at most
    keyed = keyed.withColumn(slot, leading(MAX_DEPTH, own_key)).join(named, slot)
    entry = {"bucket": spare(names, "__eb"), "key": spare(names, "__ek"), "norm": spare(names, "__en"), "links": spare(names, "__el")}
    entries = index.withColumnsRenamed(entry).drop("chain")
    same = (F.col(own_bucket) == F.col(entry["bucket"])) & (F.col(own_key) == F.col(entry["key"]))
    alone, chained = F.col(entry["links"]) == 1, F.col(entry["links"]) > 1
    often = F.broadcast(entries.where(F.col("hot") & alone).drop("hot"))  # fewer than `hot` entries, without texts
    heads = F.broadcast(index.where(F.col("hot") & (F.col("links") == 1)).select(F.col("key").alias(own_key)))
    rest = keyed.join(heads, own_key, "left_anti")
    found = keyed.join(often, same).unionByName(rest.join(entries.where(~F.col("hot") & alone).drop("hot"), same))
    if not index.where("links > 1").isEmpty():  # colliding keys: the document's own bytes choose the entry
        found = found.unionByName(keyed.join(entries.where(chained).drop("hot"), same & (norm == F.col(entry["norm"]))))
    return found.withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id"))).select(*names, *OUT)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 100_000, key=default_key) -> DataFrame:
    """Every row of docs with keep_id, group_size, kept and text_sha256 added.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty and the largest id of a group stays.
    Rows that repeat an id and text are all members; each is marked kept when its id is the group's largest. A null id
    belongs to its group but is kept only if all ids of the group are null (keep_id is then null). An empty table gives an
    empty result. Columns of the input that bear an output's name are replaced, all others stay. `key` gives the 64-bit key and may collide.
    """
    docs = docs.drop(*OUT)
    directory, index = build_index(docs, id_col, text_col, capacity, key)
    return lookup(docs, directory, index, id_col, text_col, key)


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
