"""Wildcard rules and layered settings.

Rules are long-form: tier (0 project, 1 global), kind (default, profile, override, assign), key, target, and a struct
of nullable settings. Rule tables are written by hand and small; their size is checked before they are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import scalars as S

MOST_RULES = 10_000


def _small(rules: DataFrame) -> DataFrame:
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    return F.broadcast(rules)


def best_rule(names: DataFrame, rules: DataFrame, name: str = "name") -> DataFrame:
    """Each distinct name with the key that matches it best: within a tier by (specificity, key); the project's wins if its specificity is as high. NULL if none.

    One aggregate over the matches, whose candidates are combined before the shuffle.
    """
    matched = names.select(name).distinct().join(_small(rules.select("tier", "key")), S.key_matches(F.col("key"), F.col(name)))
    order = F.struct(S.specificity(F.col("key")), (-F.col("tier")).alias("near"), F.col("key"))
    best = matched.groupBy(name).agg(F.max_by(F.struct("tier", "key"), order).alias("rule"))
    return names.select(name).distinct().join(best, name, "left").select(name, F.col("rule.tier").alias("tier"), F.col("rule.key").alias("key"))


def assigned(names: DataFrame, rules: DataFrame, assignments: DataFrame, name: str = "name") -> DataFrame:
    """As best_rule, but an assignment (tier, name, key) to an existing key comes first, the project's before the global."""
    keys = rules.select("key", F.col("tier").alias("key_tier"))
    given = assignments.join(_small(keys), "key").groupBy(name).agg(F.min_by(F.struct(F.col("key_tier").alias("tier"), F.col("key")), F.struct("tier", "key_tier")).alias("given"))
    found = best_rule(names, rules, name).join(given, name, "left")
    return found.select(name, F.coalesce("given.tier", "tier").alias("tier"), F.coalesce("given.key", "key").alias("key"), F.col("given").isNotNull().alias("assigned"))


def layered(base: dict[str, object], *layers: str, fields: Sequence[str]) -> list[Column]:
    """Each field from the last layer (struct column, least first) that sets it, else from base."""
    return [F.coalesce(*(F.col(f"{x}.{f}") for x in reversed(layers)), F.lit(base[f])).alias(f) for f in fields]


def deviations(base: str, found: str, fields: Sequence[str]) -> Column:
    """The fields of found that differ from base (NULL-safe), the others NULL."""
    return F.struct(*(F.when(~F.col(f"{base}.{f}").eqNullSafe(F.col(f"{found}.{f}")), F.col(f"{found}.{f}")).alias(f) for f in fields))


def overrides_set(column: str, fields: Sequence[str]) -> Column:
    return sum((F.col(f"{column}.{f}").isNotNull().cast("int") for f in fields), F.lit(0))


def unique_key(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """wanted (key) with ``free``: itself if not taken, else with the least suffix " N" from 2 that isn't."""
    stem = taken.select(F.regexp_extract("key", r"^(.*) (\d+)$", 1).alias("stem"), F.regexp_extract("key", r"^(.*) (\d+)$", 2).alias("n")).where("n <> ''")
    used = stem.select("stem", F.col("n").cast("long").alias("n")).where("n >= 2").distinct()
    order = Window.partitionBy("stem").orderBy("n")
    gap = used.withColumn("r", F.row_number().over(order) + 1).where("n = r").groupBy("stem").agg((F.max("n") + 1).alias("next"))
    plain = taken.select(F.col("key").alias("k2")).distinct()
    out = wanted.join(plain, wanted["key"] == plain["k2"], "left").join(gap, wanted["key"] == gap["stem"], "left")
    return out.select("key", F.when(F.col("k2").isNull(), F.col("key")).otherwise(F.concat_ws(" ", "key", F.coalesce("next", F.lit(2)).cast("string"))).alias("free"))


def rename(rules: DataFrame, assignments: DataFrame, tier: int, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Rules and assignments after a rename in one tier; a global one passes over names the project assigns to a key of its own by that name."""
    own = rules.where((F.col("tier") < tier) & (F.col("key") == old)).limit(1)
    shadowed = F.broadcast(own.agg(F.count("*").alias("own")))
    changed = rules.withColumn("key", F.when((F.col("tier") == tier) & (F.col("key") == old), F.lit(new)).otherwise(F.col("key")))
    follow = (F.col("key") == old) & ((F.col("tier") == tier) | (F.col("tier") < tier) & (F.col("own") == 0))
    moved = assignments.join(shadowed, F.lit(True)).withColumn("key", F.when(follow, F.lit(new)).otherwise(F.col("key"))).drop("own")
    return changed, moved


def stale_assignments(assignments: DataFrame, rules: DataFrame) -> DataFrame:
    """Assignments whose key no tier defines."""
    return assignments.join(rules.select("key").distinct(), "key", "left_anti")
