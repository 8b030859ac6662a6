"""Person identity: patches folded per person in arrival order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.functions import scalars as fn

UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def identify_patches(patches: DataFrame) -> DataFrame:
    """Patches with trimmed external_id, reject reason, and aliases (UUIDs only, as the project's pseudonyms)."""
    external = fn.blank_to_null(F.col("external_id"))
    reason = F.when(F.col("cookieless"), "cookieless project").when(external.isNull(), "external id required").when(F.size("aliases") == 0, "identifier required")
    hashed = F.transform(F.filter("aliases", lambda a: F.lower(a).rlike(UUID)), lambda a: fn.hash_id(a, F.col("project_id")))
    return patches.withColumns({"external_id": external, "reject_reason": reason, "distinct_ids": F.array_sort(F.array_distinct(hashed))})


def fold_field(name: str, clear: str, order: str = "seq"):
    """The last write of a field: a clearing writes null, a value writes itself, null writes nothing."""
    wrote = F.col(clear) | F.col(name).isNotNull()
    value = F.when(~F.col(clear), F.col(name))
    return F.max_by(F.when(wrote, F.struct(value.alias("v"))), F.when(wrote, F.col(order)))["v"]


def fold_persons(patches: DataFrame, fields: dict[str, str | None]) -> DataFrame:
    """One row a person (project_id, external_id): each field's last write. fields maps a field to its clear flag."""
    df = patches
    for name, clear in fields.items():
        if clear is None:
            df = df.withColumn(f"_clear_{name}", F.lit(False))
    return df.groupBy("project_id", "external_id").agg(*[fold_field(n, c or f"_clear_{n}").alias(n) for n, c in fields.items()], F.count(F.lit(1)).alias("patches"))


def trait_writes(patches: DataFrame) -> DataFrame:
    """(project_id, external_id, trait, w): each trait's last write; part 1 is a removal, which comes after its patch's writes."""
    key = ["project_id", "external_id"]
    none = F.array().cast("array<struct<part:int,trait:string,value:string>>")
    sets = F.transform(F.map_entries("traits"), lambda e: F.struct(F.lit(0).alias("part"), e["key"].alias("trait"), e["value"].alias("value")))
    unsets = F.transform("unset_traits", lambda t: F.struct(F.lit(1).alias("part"), t.alias("trait"), F.lit(None).cast("string").alias("value")))
    each = patches.select(*key, "seq", F.explode(F.concat(F.coalesce(sets, none), F.coalesce(unsets, none))).alias("o")).select(*key, "seq", "o.*")
    return each.groupBy(*key, "trait").agg(F.max_by(F.struct("seq", "part", "value"), F.struct("seq", "part")).alias("w"))


def trait_replacements(patches: DataFrame) -> DataFrame:
    """(project_id, external_id, since): when all traits of a person were last replaced."""
    return patches.groupBy("project_id", "external_id").agg(F.max(F.when(F.col("replace_traits"), F.col("seq"))).alias("since"))


def current_traits(writes: DataFrame, replacements: DataFrame) -> DataFrame:
    """(project_id, external_id, trait, value): last writes that no later replacement has dropped and that are no removals.

    A write that another one of its trait has followed cannot count, so the last ones suffice; this is the merge on read
    of the two folds' outputs, which may come from a batch or from the change logs of streams.
    """
    key = ["project_id", "external_id"]
    live = writes.join(replacements, key, "left").where("(since IS NULL OR w.seq >= since) AND w.part = 0")
    return live.select(*key, "trait", F.col("w.value").alias("value"))


def fold_traits(patches: DataFrame) -> DataFrame:
    """Traits of patches since each person's last replace; removals of a patch come after its writes.

    patches carries traits (map), replace_traits and unset_traits (array).
    """
    return current_traits(trait_writes(patches), trait_replacements(patches))


def fold_aliases(patches: DataFrame) -> DataFrame:
    """(project_id, distinct_id, external_id): the last person that claimed each id."""
    return patches.select("project_id", "external_id", "seq", F.explode("distinct_ids").alias("distinct_id")).groupBy("project_id", "distinct_id").agg(F.max_by("external_id", "seq").alias("external_id"))
