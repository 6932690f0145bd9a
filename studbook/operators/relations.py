"""Joins between animals, people, litters, titles and health records.

Every relation comes out in long form, one row per related record. An animal with millions of
related rows therefore never becomes one oversized row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rows import stack_rows

# The slim view of a parent or sibling.
SLIM_COLUMNS = [
    "id", "uuid", "registered_name", "call_name", "sex", "date_of_birth", "color", "source",
    "has_conflicts", "dam_id", "sire_id", "dam_name", "sire_name",
]


def view_slim(dogs: DataFrame) -> DataFrame:
    return dogs.select(*[F.col(c) if c in dogs.columns else F.lit(None).alias(c) for c in SLIM_COLUMNS])


def join_parent(dogs: DataFrame, registry: DataFrame, role: str, columns: list[str]) -> DataFrame:
    """Every animal with the chosen columns of its `sire` or `dam`, null when there is none."""
    parent = registry.select(
        F.col("id").alias(f"{role}_key"), *[F.col(c).alias(f"{role}_{c}_value") for c in columns]
    )
    child = dogs.alias("c")
    return child.join(parent.alias("p"), F.col(f"c.{role}_id") == F.col(f"p.{role}_key"), "left").drop(f"{role}_key")


def join_offspring(dogs: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per (parent, child, role)."""
    children = registry.select(
        F.col("id").alias("child_id"),
        stack_rows(["parent_id", "role"], (F.col("sire_id"), F.lit("sire")), (F.col("dam_id"), F.lit("dam"))),
    ).filter(F.col("parent_id").isNotNull())
    return children.join(dogs.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")


def join_people(dogs: DataFrame, links: DataFrame, people: DataFrame, person_key: str) -> DataFrame:
    """Many-to-many through a link table: (dog_id, person id, name, ...)."""
    renamed = people.withColumnRenamed("id", person_key)
    return (
        links.join(dogs.select(F.col("id").alias("dog_id")), "dog_id", "left_semi")
        .join(renamed, person_key)
    )


def join_siblings(dogs: DataFrame, links: DataFrame, registry: DataFrame) -> DataFrame:
    """Siblings in the direction the link is stored."""
    sibling = registry.select(
        F.col("id").alias("sibling_id"), F.col("registered_name").alias("sibling_name"), F.col("sex").alias("sibling_sex")
    )
    return links.join(dogs.select(F.col("id").alias("dog_id")), "dog_id", "left_semi").join(sibling, "sibling_id")


def join_records(dogs: DataFrame, records: DataFrame, columns: list[str]) -> DataFrame:
    """One-to-many on `dog_id` with the animal's name beside every record."""
    names = dogs.select(F.col("id").alias("dog_id"), "registered_name")
    return records.join(names, "dog_id").select("dog_id", "registered_name", *columns)


def join_birth_litter(dogs: DataFrame, litters: DataFrame) -> DataFrame:
    """Every animal with the litter it was born in, by parents and date."""
    litter = litters.select(
        F.col("id").alias("birth_litter_id"), "dam_id", "sire_id", "date_of_birth", "male_count", "female_count"
    )
    return dogs.join(litter, ["dam_id", "sire_id", "date_of_birth"], "left")


def join_litters_by_role(dogs: DataFrame, litters: DataFrame) -> DataFrame:
    """Litters an animal took part in, with its role."""
    roles = [(r, f"{r}_id") for r in ("dam", "sire", "mating_partner") if f"{r}_id" in litters.columns]
    parts = stack_rows(["role", "dog_id"], *[(F.lit(r), F.col(c)) for r, c in roles])
    long = litters.select(F.col("id").alias("litter_id"), "date_of_birth", parts).filter("dog_id is not null")
    return long.join(dogs.select(F.col("id").alias("dog_id")), "dog_id", "left_semi")


def resolve_parent_ids(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Parent identifiers as text to registry ids; unknown ones stay null."""
    known = first_match(registry, "uuid").select("uuid", "id")
    for role in ("sire", "dam"):
        lookup = known.select(F.col("uuid").alias(f"{role}_uuid"), F.col("id").alias(f"{role}_id"))
        records = records.join(lookup, f"{role}_uuid", "left")
    return records


def first_match(table: DataFrame, *keys: str) -> DataFrame:
    """The lowest id per key. Aggregating first keeps a repeated key from multiplying rows in a later join."""
    present = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    return table.filter(present).groupBy(*keys).agg(F.min("id").alias("id"))


def join_medical_search(requests: DataFrame, registry: DataFrame, records: DataFrame) -> DataFrame:
    """Find the animal of a request: registration number, else name, else certificate number."""
    by_number = first_match(registry, "registration_number").withColumnRenamed("id", "by_number")
    by_name = first_match(registry, "registered_name").withColumnRenamed("id", "by_name")
    certificates = records.filter("ofa_number is not null").groupBy("ofa_number").agg(F.min("dog_id").alias("by_certificate"))
    return (
        requests.join(by_number, "registration_number", "left")
        .join(by_name, "registered_name", "left")
        .join(certificates, "ofa_number", "left")
        .withColumn("found_id", F.coalesce("by_number", "by_name", "by_certificate"))
        .withColumn("found_by", F.when(F.col("by_number").isNotNull(), "registration_number")
                    .when(F.col("by_name").isNotNull(), "name")
                    .when(F.col("by_certificate").isNotNull(), "certificate"))
        .drop("by_number", "by_name", "by_certificate")
    )


def entity_profile(
    dogs: DataFrame, registry: DataFrame, owners: DataFrame, breeders: DataFrame, siblings: DataFrame,
    titles: DataFrame, medical: DataFrame, litters: DataFrame, merge_log: DataFrame,
) -> DataFrame:
    """Every relation of every given animal as (dog_id, relation, related_id, label).

    `owners` and `breeders` are the results of join_people. An animal without relations keeps one row
    with a null relation, so nobody is lost.
    """
    wanted = dogs.select(F.col("id").alias("dog_id"), "sire_id", "dam_id")
    long_parents = wanted.select("dog_id", stack_rows(
        ["relation", "related_id"], (F.lit("sire"), F.col("sire_id")), (F.lit("dam"), F.col("dam_id")),
    )).filter("related_id is not null")
    names = registry.select(F.col("id").alias("related_id"), F.col("registered_name").alias("label"))
    parents = long_parents.join(names, "related_id")

    def related(table: DataFrame, relation: str, key: str, label: str) -> DataFrame:
        return table.select(
            "dog_id", F.lit(relation).alias("relation"), F.col(key).alias("related_id"), F.col(label).cast("string").alias("label")
        )

    by_role = join_litters_by_role(dogs, litters).withColumn("relation", F.concat(F.lit("litter_as_"), "role"))
    ids = dogs.select(F.col("id").alias("dog_id"))
    many = [
        related(titles, "title", "id", "short_name"),
        related(medical, "medical_record", "id", "ofa_number"),
        related(merge_log, "merge_log", "log_id", "field"),
        related(owners, "owner", "owner_id", "name"),
        related(breeders, "breeder", "breeder_id", "name"),
    ]
    unioned = reduce(DataFrame.unionByName, many).join(ids, "dog_id", "left_semi")
    rest = [
        parents.select("dog_id", "relation", "related_id", "label"),
        related(join_siblings(dogs, siblings, registry), "sibling", "sibling_id", "sibling_name"),
        by_role.select("dog_id", "relation", F.col("litter_id").alias("related_id"), F.col("date_of_birth").cast("string").alias("label")),
        related(join_birth_litter(dogs, litters).filter("birth_litter_id is not null").withColumnRenamed("id", "dog_id"),
                "birth_litter", "birth_litter_id", "date_of_birth"),
    ]
    found = reduce(DataFrame.unionByName, rest, unioned)
    # An outer join would shuffle all rows of one animal together; the anti join only moves its id.
    alone = ids.join(found.select("dog_id").distinct(), "dog_id", "left_anti")
    nothing = {c: F.lit(None).cast(kind) for c, kind in found.dtypes if c != "dog_id"}
    return found.unionByName(alone.withColumns(nothing))
