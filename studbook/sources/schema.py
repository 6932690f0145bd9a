"""The ten registry tables with fixed types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

HEALTH_TYPE = "array<struct<name:string,screening_test_result:string,notes:string>>"

# Table name -> columns, as Spark DDL.
TABLES = {
    "dog": (
        "id bigint, uuid string, registered_name string, call_name string, link_name string, sex int, "
        "year_of_birth int, month_of_birth int, day_of_birth int, date_of_birth date, "
        "year_of_death int, month_of_death int, day_of_death int, date_of_death date, "
        "land_of_birth string, land_of_birth_code string, land_of_standing string, size double, weight double, color string, "
        "color_marking string, eyes_color string, variety string, distinguishing_features string, prefix_titles string, "
        "suffix_titles string, other_titles string, registration_status int, registration_number string, brand_chip string, "
        "coi double, coi_updated_on timestamp_ntz, incomplete_pedigree boolean, photo_url string, locked boolean, removed boolean, "
        "show_ad boolean, is_new boolean, modified boolean, modified_at timestamp_ntz, "
        f"health_info_general {HEALTH_TYPE}, health_info_genetic {HEALTH_TYPE}, neutered boolean, approved_for_breeding boolean, "
        "frozen_semen boolean, artificial_insemination boolean, source string, has_conflicts boolean, "
        "conflicts map<string,map<string,string>>, kennel string, notes string, data_correctness_notes string, club string, "
        "sports array<string>, dam_id bigint, dam_uuid string, dam_name string, dam_link_name string, "
        "sire_id bigint, sire_uuid string, sire_name string, sire_link_name string, birth_litter_id bigint"
    ),
    "dogsiblinglink": "dog_id bigint, sibling_id bigint",
    "dogbreederlink": "dog_id bigint, breeder_id bigint",
    "dogownerlink": "dog_id bigint, owner_id bigint",
    "breeder": "id bigint, uuid string, name string, is_breeder boolean",
    "owner": "id bigint, uuid string, name string, is_main_owner boolean",
    "litter": (
        "id bigint, date_of_birth date, litter_male_count int, litter_female_count int, litter_undef_count int, "
        "sire_id bigint, dam_id bigint, mating_partner_id bigint"
    ),
    "title": (
        "id bigint, dog_id bigint, short_name string, long_name string, is_prefix boolean, has_winner_year boolean, winner_year int"
    ),
    "medical_record": (
        "id bigint, dog_id bigint, registry string, test_date timestamp_ntz, report_date timestamp_ntz, age_in_months int, "
        "conclusion string, ofa_number string, source string, notes string"
    ),
    "mergelog": (
        "id bigint, dog_id bigint, resolved_fields map<string,string>, old_values map<string,string>, new_values map<string,string>, "
        "conflicts map<string,string>, resolved_date timestamp_ntz, resolved_by_user_id bigint"
    ),
}


def table_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns of the table in order and type; a column the input lacks becomes null."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table_schema(name)
    ])


def entity_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Stored tables by name; the fixed schema spares the reader any inference."""
    return {name: spark.read.schema(table_schema(name)).parquet(f"{folder}/{name}") for name in TABLES}


def entity_tables_jdbc(spark: SparkSession, url: str, properties: dict[str, str], partitions: int = 64) -> dict[str, DataFrame]:
    """The same tables from a live database, tables with an id read in parallel id ranges."""
    tables = {}
    for name in TABLES:
        if "id" not in table_schema(name).names:
            tables[name] = spark.read.jdbc(url, name, properties=properties)
            continue
        low, high = spark.read.jdbc(url, f"(select min(id) as low, max(id) as high from {name}) b", properties=properties).first()
        tables[name] = spark.read.jdbc(
            url, name, column="id", lowerBound=low or 0, upperBound=(high or 0) + 1, numPartitions=partitions, properties=properties)
    return tables
