"""Upserts and table maintenance. Every function returns the table's new state; sinks publish it.

Incoming batches are reduced to one row per key before they meet the table. New ids follow the highest
id in the order of md5(key): rows are numbered inside 4096 hash prefixes and each prefix starts where
the ones before it end, so no step numbers the whole batch in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.rows import one_per_id
from ..session import settle, unsent
from .conflicts import merge_fill_missing
from .relations import join_medical_search

PREFIX_LENGTH = 3


def assign_ids(rows: DataFrame, table: DataFrame, key: Column, id_column: str = "id") -> DataFrame:
    """Give each row the next free id of `table`; `key` must be a unique text."""
    keyed = rows.withColumn("_hash", F.md5(key)).withColumn("_prefix", F.substring("_hash", 1, PREFIX_LENGTH))
    inside = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_prefix").orderBy("_hash", key)))
    # At most 4096 rows reach this window.
    sizes = keyed.groupBy("_prefix").agg(F.count("*").alias("_size"))
    starts = sizes.withColumn("_start", F.sum("_size").over(Window.orderBy("_prefix")) - F.col("_size")).drop("_size")
    top = table.agg(F.coalesce(F.max(id_column), F.lit(0)).cast("bigint").alias("_top"))
    numbered = inside.join(F.broadcast(starts), "_prefix").crossJoin(F.broadcast(top))
    return numbered.withColumn(id_column, F.col("_top") + F.col("_start") + F.col("_n")).drop("_hash", "_prefix", "_n", "_start", "_top")


def _key_text(keys: list[str]) -> Column:
    parts = [F.concat(F.length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string")) for k in keys]
    return F.concat_ws("|", *[F.coalesce(p, F.lit("-")) for p in parts])


def last_per_key(batch: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The row with the highest position per key, null keys counting as equal."""
    others = [c for c in batch.columns if c not in keys and c != position]
    last = F.max_by(F.struct(*others), F.col(position)) if others else F.max(position)
    return batch.groupBy(*keys).agg(last.alias("_last")).select(*keys, *([f"_last.{c}" for c in others]))


def upsert(
    table: DataFrame, batch: DataFrame, keys: list[str], update: list[str], null_safe: bool = False, id_column: str = "id", top: DataFrame | None = None
) -> DataFrame:
    """New state of `table`: matched rows take the `update` columns, unmatched batch rows are inserted with new ids.

    New ids follow the highest one of `top`, where `table` is only a part of the whole. `batch` has one row per key. With an empty `update` the call only inserts. A null key matches nothing
    unless `null_safe` is set, in which case null equals null.
    """
    def same(left: str, right: str) -> Column:
        tests = [(F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) if null_safe else F.col(f"{left}.{k}") == F.col(f"{right}.{k}")) for k in keys]
        return reduce(Column.__and__, tests)

    t, b = table.alias("t"), batch.alias("b")
    changed = {c: F.when(F.col("b._hit"), F.col(f"b.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in update}
    if update:
        hit = batch.select(*keys, *update).withColumn("_hit", F.lit(True)).alias("b")
        kept = t.join(hit, same("t", "b"), "left").select(*[changed.get(c, F.col(f"t.{c}")) for c in table.columns])
    else:
        kept = table
    fresh = b.join(t, same("b", "t"), "left_anti")
    inserted = assign_ids(fresh, table if top is None else top, _key_text(keys), id_column)
    columns = [F.col(c) if c in inserted.columns else F.lit(None).cast(kind).alias(c) for c, kind in table.dtypes]
    return kept.unionByName(inserted.select(*columns))


def upsert_people(table: DataFrame, batch: DataFrame, update: bool, position: str = "position", top: DataFrame | None = None) -> DataFrame:
    """People by uuid. One feed updates known people, the others only add new ones (first mention)."""
    others = [c for c in batch.columns if c not in ("uuid", position)]
    pick = F.max_by if update else F.min_by
    one = batch.groupBy("uuid").agg(pick(F.struct(*others), F.col(position)).alias("p")).select("uuid", "p.*")
    return upsert(table, one, ["uuid"], others if update else [], top=top)


def upsert_titles(table: DataFrame, batch: DataFrame, position: str = "position", top: DataFrame | None = None) -> DataFrame:
    keys = ["dog_id", "short_name", "long_name"]
    return upsert(table, last_per_key(batch, keys, position), keys, ["has_winner_year", "winner_year"], null_safe=True, top=top)


def upsert_litters(table: DataFrame, batch: DataFrame, position: str = "position", top: DataFrame | None = None) -> DataFrame:
    keys = ["dam_id", "sire_id", "date_of_birth"]
    update = [c for c in batch.columns if c not in keys and c != position and c in table.columns and c != "id"]
    return upsert(table, last_per_key(batch, keys, position), keys, update, null_safe=True, top=top)


def upsert_medical(table: DataFrame, batch: DataFrame, position: str = "position", top: DataFrame | None = None) -> DataFrame:
    """Health records by animal and certificate number; a null number equals a null number, the batch's last row wins.

    Where the table already holds a key more than once, only its lowest id is updated.
    """
    keys = ["dog_id", "ofa_number"]
    update = [c for c in batch.columns if c not in keys and c != position and c in table.columns and c != "id"]
    lowest = table.groupBy(*keys).agg(F.min("id").alias("_target"))
    one = last_per_key(batch, keys, position)
    a, b = one.alias("a"), lowest.alias("b")
    on = (F.col("a.dog_id") == F.col("b.dog_id")) & F.col("a.ofa_number").eqNullSafe(F.col("b.ofa_number"))
    placed = a.join(b, on, "left").select("a.*", "b._target")
    hits = placed.filter("_target is not null").select(F.col("_target").alias("id"), *[F.col(c).alias(f"_new_{c}") for c in update], F.lit(True).alias("_hit"))
    kept = table.join(hits, "id", "left").withColumns({c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in update})
    fresh = assign_ids(placed.filter("_target is null").drop("_target"), table if top is None else top, _key_text(keys))
    columns = [F.col(c) if c in fresh.columns else F.lit(None).cast(kind).alias(c) for c, kind in table.dtypes]
    return kept.select(*table.columns).unionByName(fresh.select(*columns))


def upsert_registry(registry: DataFrame, records: DataFrame, matches: DataFrame) -> DataFrame:
    """Matched records fill what the registry lacks, all others become new animals.

    Of new records with one uuid the lowest rec_id stands; a record without uuid is an animal of its own.
    """
    matches = settle(matches)
    merged = merge_fill_missing(registry, records, matches)
    fresh = records.join(unsent(matches.filter("matched_id is null").select("rec_id")), "rec_id", "left_semi")
    key = F.coalesce(F.nullif(F.col("uuid"), F.lit("")), F.concat(F.lit("rec "), F.col("rec_id").cast("string")))
    one = fresh.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*fresh.columns), "rec_id").alias("r")).select("_key", "r.*")
    added = assign_ids(one, registry, F.col("_key"))
    columns = [F.col(c).cast(kind).alias(c) if c in added.columns else F.lit(None).cast(kind).alias(c) for c, kind in registry.dtypes]
    return merged.unionByName(added.select(*columns))


def update_overwrite(
    registry: DataFrame, records: DataFrame, columns: list[str], set_columns: str | None = None, position: str | None = None
) -> DataFrame:
    """Lay new values over animals by id. `set_columns` names an array column listing which columns the record sets;
    a set column overwrites even with null. Parents are always replaced. Of several records for one id the one of
    the highest `position` holds."""
    always = [c for c in ("sire_id", "dam_id") if c in records.columns]
    wanted = list(dict.fromkeys(columns + always))
    used = dict.fromkeys(["id", *wanted, *(c for c in (set_columns, position) if c)])
    new = one_per_id(records.select(*used), "id", position).select(
        "id", *[F.col(c).alias(f"_new_{c}") for c in wanted], F.lit(True).alias("_hit"),
        (F.col(set_columns) if set_columns else F.array(*[F.lit(c) for c in wanted])).alias("_set"))
    joined = registry.join(new, "id", "left")

    def value(c: str) -> Column:
        applies = F.col("_hit") if c in always else F.col("_hit") & F.array_contains("_set", c)
        return F.when(applies, F.col(f"_new_{c}")).otherwise(F.col(c))

    return joined.withColumns({c: value(c) for c in wanted}).select(*registry.columns)


def link_people(links: DataFrame, batch: DataFrame) -> DataFrame:
    """Replace all links of the animals in the batch."""
    return links.join(batch.select("dog_id").distinct(), "dog_id", "left_anti").unionByName(batch.select(*links.columns).distinct())


def link_siblings(links: DataFrame, batch: DataFrame) -> DataFrame:
    return links.unionByName(batch.select(*links.columns)).distinct()


def link_puppies(registry: DataFrame, puppies: DataFrame) -> DataFrame:
    """Set birth_litter_id from (puppy_id, litter_id); the lowest litter wins where a puppy is listed twice."""
    one = puppies.groupBy(F.col("puppy_id").alias("id")).agg(F.min("litter_id").alias("_litter"))
    held = F.col("birth_litter_id") if "birth_litter_id" in registry.columns else F.lit(None).cast("bigint")
    return registry.join(one, "id", "left").withColumn("birth_litter_id", F.coalesce("_litter", held)).drop("_litter")


def set_litter_parent(litters: DataFrame, registry: DataFrame, parent: str = "parent_id") -> DataFrame:
    """The page's own animal becomes sire or dam of its litters, by its sex."""
    sexes = registry.select(F.col("id").alias(parent), F.col("sex").alias("_sex"))
    joined = litters.join(sexes, parent, "left")
    return joined.withColumn("sire_id", F.when(F.col("_sex") == 1, F.col(parent)).otherwise(F.col("sire_id"))).withColumn(
        "dam_id", F.when(F.col("_sex") == 2, F.col(parent)).otherwise(F.col("dam_id"))).drop("_sex")


def link_parents(registry: DataFrame, found: DataFrame) -> DataFrame:
    """Set sire_id and dam_id from (id, sire_id, dam_id) where a parent was found; of several found the lowest id."""
    new = found.groupBy("id").agg(F.min("sire_id").alias("_sire"), F.min("dam_id").alias("_dam"))
    joined = registry.join(new, "id", "left")
    return joined.withColumns({"sire_id": F.coalesce("_sire", "sire_id"), "dam_id": F.coalesce("_dam", "dam_id")}).select(*registry.columns)


def patch_notes(registry: DataFrame, patches: DataFrame, position: str | None = None) -> DataFrame:
    """Overwrite the note columns with provided values; null leaves a note as it is.

    Of several values for one note the one of the highest `position` holds, or the greatest without a position.
    """
    columns = [c for c in ("notes", "data_correctness_notes") if c in patches.columns]
    order = [position] if position else []
    new = patches.groupBy("id").agg(*[F.max(F.when(F.col(c).isNotNull(), F.struct(*order, c)))[c].alias(f"_new_{c}") for c in columns])
    held = {c: F.col(c) if c in registry.columns else F.lit(None).cast("string") for c in columns}
    return registry.join(new, "id", "left").withColumns({c: F.coalesce(F.col(f"_new_{c}"), held[c]) for c in columns}).drop(*[f"_new_{c}" for c in columns])


def delete_medical(records: DataFrame, ids: DataFrame) -> DataFrame:
    return records.join(ids.select("id"), "id", "left_anti")


def medical_for_animals(records: DataFrame, dogs: DataFrame) -> DataFrame:
    return records.join(dogs.select(F.col("id").alias("dog_id")), "dog_id", "left_semi")


def medical_batch(requests: DataFrame, registry: DataFrame, records: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Look up each request's animal, store its result rows under it, and report (request_id, success, records_count).

    `results` holds (found_id, position, registry, ...), the rows known for a found animal.
    """
    found = join_medical_search(requests, registry, records).select("request_id", "dog_id", "found_id")
    rows = found.filter("found_id is not null").join(results, "found_id")
    counts = rows.groupBy("request_id").agg(F.count("*").alias("n"))
    outcome = found.join(counts, "request_id", "left").select(
        "request_id", "dog_id", F.col("found_id").isNotNull().alias("success"), F.coalesce("n", F.lit(0)).alias("records_count"))
    return upsert_medical(records, rows.drop("request_id", "found_id")), outcome
