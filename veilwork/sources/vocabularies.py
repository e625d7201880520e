"""Vocabularies and registries from their published file layouts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.operators.suppress import is_drug_name

# registry column -> name of its field in the published file (fixed values)
REGISTRY_FIELDS = {
    "specialty": "Healthcare Provider Taxonomy Code_1",
    "address_1": "Provider First Line Business Practice Location Address",
    "city": "Provider Business Practice Location Address City Name",
    "state": "Provider Business Practice Location Address State Name",
    "zip": "Provider Business Practice Location Address Postal Code",
    "phone": "Provider Business Practice Location Address Telephone Number",
}


def drug_names(spark: SparkSession, path: str) -> DataFrame:
    """Brand, generic and ingredient names of a drug directory in JSON (``results``)."""
    schema = "results array<struct<brand_name:string,generic_name:string,active_ingredients:array<struct<name:string>>>>"
    r = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("results").alias("r"))
    names = F.concat(F.array("r.brand_name"), F.coalesce(F.split("r.generic_name", ","), F.array()), F.coalesce("r.active_ingredients.name", F.array()))
    return r.select(F.explode(names).alias("term")).select(F.trim("term").alias("term")).where(is_drug_name(F.col("term"))).distinct()


def diagnoses(spark: SparkSession, path: str) -> DataFrame:
    """Descriptions of a fixed-width code list: the long one from column 78, else the short one from 17."""
    line = spark.read.text(path).select(F.rtrim("value").alias("v")).where("length(v) >= 80")
    long, short = F.trim(F.substring("v", 78, 10_000)), F.trim(F.substring("v", 17, 61))
    return line.select(F.when(long != "", long).otherwise(short).alias("term")).where("length(term) >= 5").distinct()


def lab_tests(spark: SparkSession, path: str) -> DataFrame:
    """Long names (five letters or more) and components (three or more) of a test list."""
    t = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    long = t.select(F.trim("LONG_COMMON_NAME").alias("term")).where("length(term) >= 5")
    return long.unionByName(t.select(F.trim("COMPONENT").alias("term")).where("length(term) >= 3")).distinct()


def facilities(spark: SparkSession, path: str, column: str = "Facility Name") -> DataFrame:
    """Names of a facility list; all capitals become title case."""
    t = spark.read.option("header", True).option("escape", '"').csv(path).select(F.trim(F.col(column)).alias("n")).where("length(n) >= 3")
    return t.select(F.when(F.col("n") == F.upper("n"), F.initcap("n")).otherwise(F.col("n")).alias("term")).distinct()


def provider_registry(spark: SparkSession, path: str) -> DataFrame:
    """Twelve columns of the provider registry; a person's name is first and last, an organisation's its legal name."""
    t = spark.read.option("header", True).option("escape", '"').csv(path)
    text = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    person = text("Entity Type Code") == "1"
    first, last = text("Provider First Name"), text("Provider Last Name (Legal Name)")
    return t.where(text("NPI") != "").select(
        F.col("NPI").alias("npi"),
        text("Entity Type Code").alias("entity_type"),
        F.when(person, F.trim(F.concat_ws(" ", first, last))).otherwise(text("Provider Organization Name (Legal Business Name)")).alias("provider_name"),
        F.when(person, first).otherwise("").alias("first_name"),
        F.when(person, last).otherwise("").alias("last_name"),
        F.when(person, text("Provider Credential Text")).otherwise("").alias("credential"),
        *(text(field).alias(name) for name, field in REGISTRY_FIELDS.items()),
    )


def paged(spark: SparkSession, fetch: Callable[[int, int], list[dict]], schema: str, size: int = 1000) -> DataFrame:
    """Rows of a source read page by page, ``fetch(offset, size)``, until a page is short."""

    def pages() -> Iterator[dict]:
        offset = 0
        while page := fetch(offset, size):
            yield from page
            offset += len(page)
            if len(page) < size:
                return

    return spark.createDataFrame(list(pages()), schema)


def clinical_notes(spark: SparkSession, path: str, least: int = 100) -> DataFrame:
    """(text, specialty, description, sample_name) of a CSV of transcriptions of ``least`` characters or more."""
    t = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return t.select(F.trim("transcription").alias("text"), F.col("medical_specialty").alias("specialty"), "description", "sample_name").where(F.length("text") >= least)
