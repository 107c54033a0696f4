"""Comparing two versions of a file's definitions, and the seeds that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff_defs(old: DataFrame, new: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by..., ordinal, change, new_idx, old_idx, seen): definitions of equal key pair in declaration order; leftovers are Added or Removed.

    Both sides have the columns `by` (identity: file, kind, name chain), `order`, kind, sig_hash and body_hash (nullable). A changed signature is SigChanged even if the body
    changed too; module initialisers compare signatures only and give ModuleInitChanged. Equal pairs give no row. new_idx and old_idx are the
    sides' local_idx where they have one. `seen` orders changes as declarations are first seen: the new side's keys by their first place, then keys of the old side
    alone, and within a key by ordinal.
    """
    key = Window.partitionBy(*by)
    idx = lambda df: F.col("local_idx") if "local_idx" in df.columns else F.lit(None).cast("int")

    def side(df: DataFrame, s: str) -> DataFrame:
        df = df.withColumns({"ordinal": F.row_number().over(key.orderBy(*order)), "__idx": idx(df)}).withColumn("__first", F.min("__idx").over(key))
        kept = [F.col(c).alias(f"{s}_{c}") for c in ("sig_hash", "body_hash", "kind")]
        return df.select(*by, "ordinal", *kept, F.col("__idx").alias(f"{s}_idx"), F.col("__first").alias(f"{s}_first"), F.lit(True).alias(s))

    both = side(old, "old").join(side(new, "new"), [*by, "ordinal"], "full")
    module = F.coalesce("new_kind", "old_kind") == "ModuleInit"
    change = (
        F.when(F.col("old").isNull(), "Added")
        .when(F.col("new").isNull(), "Removed")
        .when(~F.col("old_sig_hash").eqNullSafe(F.col("new_sig_hash")), F.when(module, "ModuleInitChanged").otherwise("SigChanged"))
        .when(~module & ~F.col("old_body_hash").eqNullSafe(F.col("new_body_hash")), "BodyChanged")
    )
    first = F.min("new_first").over(key)
    seen = F.struct(first.isNull().alias("gone"), F.coalesce(first, F.min("old_first").over(key)).alias("first"), F.col("ordinal").alias("ordinal"))
    both = both.withColumns({"change": change, "seen": seen})
    return both.where("change IS NOT NULL").select(*by, "ordinal", "change", "new_idx", "old_idx", "seen")


def seed_kind(change):
    """The seed that a change gives: removals and initialiser changes fall on the file's initialiser."""
    return F.when(change == "BodyChanged", "body").when(change == "SigChanged", "signature").when(change == "Added", "added").otherwise("module_init")


def scan_importers(imports_raw: DataFrame, needles: DataFrame) -> DataFrame:
    """(file_id): files with a raw import that contains one of the needles. A substring join; needles come from changed paths, a few a change."""
    return imports_raw.join(needles, F.contains(F.col("raw"), F.col("needle")), "left_semi").select("file_id").distinct()


def all_changes(diffed: DataFrame, untracked: DataFrame) -> DataFrame:
    """The rows of diffed (path, status, ...), and the untracked ones (path, ...) as Added where the diff does not name them."""
    fresh = untracked.dropDuplicates(["path"]).join(diffed.select("path"), "path", "left_anti").withColumn("status", F.lit("Added"))
    return diffed.unionByName(fresh, allowMissingColumns=True).select(*diffed.columns)


def first_reason(changes: DataFrame, reason) -> DataFrame:
    """(reason): that of the first change in order (ord) that has one; no row if none does."""
    return changes.withColumn("reason", reason).where("reason IS NOT NULL").agg(F.min_by("reason", "ord").alias("reason")).where("reason IS NOT NULL")
