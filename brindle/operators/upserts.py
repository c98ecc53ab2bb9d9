"""Keyed table updates as pure functions (target, source) -> new target, for batch and ``foreachBatch``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.ranking import top_per_group


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order: list[Column] | None = None, fill_only: tuple[str, ...] = ()) -> DataFrame:
    """One row per key: source values win where not null; columns in ``fill_only`` keep the target's value if it has one."""
    if order:
        source = top_per_group(source, keys, order)
    rest = [c for c in target.columns if c not in keys]
    s = source.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in rest if c in source.columns])
    joined = target.join(s, keys, "full")
    pick = lambda c: F.coalesce(c, f"_new_{c}") if c in fill_only else F.coalesce(f"_new_{c}", c)
    return joined.select(*keys, *[(pick(c) if c in source.columns else F.col(c)).alias(c) for c in rest])


def insert_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target and those source rows (one per key) whose key it lacks."""
    new = source.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(new, allowMissingColumns=True)


def remove_keys(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(source.select(*keys).distinct(), keys, "left_anti")


def evolve(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Adds missing columns with a type and a default."""
    for name, (kind, default) in columns.items():
        df = df if name in df.columns else df.withColumn(name, F.lit(default).cast(kind))
    return df


def next_version(versions: DataFrame, key: str) -> DataFrame:
    return versions.groupBy(key).agg((F.max("version") + 1).alias("version"))


def merge_provenance(sources: Column, entry: Column) -> Column:
    """Adds an entry to a provenance list unless it is there."""
    return F.array_union(F.coalesce(sources, F.array(entry)), F.array(entry))


def promotion(target: Column, lint_passed: Column, gate_passed: Column) -> Column:
    """Why a recipe may not move to ``target`` (lint, unsupported, gate), or ok; only an activation passes the gate."""
    return F.when(~lint_passed, "lint").when(~target.isin("candidate", "active", "deprecated"), "unsupported").when((target == "active") & ~gate_passed, "gate").otherwise("ok")
