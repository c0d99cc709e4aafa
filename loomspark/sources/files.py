"""File sources and sinks: catalogs, cases, guides, versioned tables, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CATALOG = (
    "schema_version int, source struct<source_id:string,title:string,url:string,publisher:string,version:string,checked_at:string>, "
    "entities array<struct<entity_id:string,entity_type:string,canonical_name:string,description:string,aliases:array<string>>>, "
    "relations array<struct<subject_entity_id:string,predicate:string,object_entity_id:string>>"
)
CASES = "id string, query string, family string, expected_sources array<string>, expected_terms array<string>, no_evidence boolean, security boolean"


def catalog(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, aliases and relations of catalog files of schema version 1; a malformed file or other version fails."""
    raw = spark.read.schema(CATALOG).option("mode", "FAILFAST").json(paths, multiLine=True)
    if not raw.filter("schema_version is null or schema_version <> 1").isEmpty():
        raise ValueError("catalogs must have schema_version 1")
    entities = raw.select("source.source_id", F.explode("entities").alias("e")).select("source_id", "e.entity_id", "e.entity_type", F.col("e.canonical_name").alias("name"), "e.aliases")
    names = F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    aliases = entities.select("entity_id", "entity_type", F.explode(names).alias("alias"))
    relations = raw.select(F.explode("relations").alias("r")).select(F.col("r.subject_entity_id").alias("subject"), "r.predicate", F.col("r.object_entity_id").alias("object"))
    return entities.drop("aliases"), aliases, relations


def cases(spark: SparkSession, path: str, least: int = 100, families: tuple[str, ...] = ()) -> DataFrame:
    """Evaluation cases of a JSON Lines file; refused if they are too few, repeat ids, lack a family or a query."""
    rows = spark.read.schema(CASES).option("mode", "FAILFAST").json(path)
    got = rows.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.collect_set("family").alias("families"), F.count(F.when(F.trim("query") == "", 1)).alias("blank")).first()
    missing = set(families) - set(got["families"])
    if got["n"] < least or got["ids"] != got["n"] or got["blank"] or missing:
        raise ValueError(f"invalid cases: {got['n']} rows, {got['ids']} ids, {got['blank']} blank queries, missing families {sorted(missing)}")
    return rows


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of a JSON object keyed by case: (id, sources, answer)."""
    whole = spark.read.text(path, wholetext=True)
    made = F.from_json("value", "map<string, struct<sources:array<string>, answer:string>>")
    return whole.select(F.explode(made).alias("id", "p")).select("id", "p.sources", "p.answer")


def guides(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Guides of several JSON Lines files; of one job_name the last file's, then its last line's, counts. Bad lines are left out."""
    schema = "job_name string, sections map<string,string>, skills array<string>, _bad string"
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").json(paths).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    rows = rows.withColumn("place", F.monotonically_increasing_id()).filter("_bad is null and job_name is not null")
    w = Window.partitionBy("job_name").orderBy(F.desc("file"), F.desc("at"), F.desc("place"))
    return rows.withColumn("n", F.row_number().over(w)).filter("n = 1").select("job_name", "sections", "skills")


def write_reports(reports: DataFrame, folder: str) -> None:
    """Markdown reports (report_date, job, markdown) as text partitioned by date and job, and a manifest of what was written."""
    reports.select("report_date", "job", F.col("markdown").alias("value")).write.mode("errorifexists").partitionBy("report_date", "job").text(f"{folder}/reports")
    manifest = reports.groupBy("report_date", "status").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("job")).alias("jobs"))
    manifest.coalesce(1).write.mode("errorifexists").json(f"{folder}/manifest")


def restored(jobs: DataFrame, revisions: DataFrame, max_attempts: int = 5) -> DataFrame:
    """Jobs of a backup: leases are dropped, spent jobs die. Refused with more than one active revision."""
    if revisions.filter("active").count() > 1:
        raise ValueError("more than one active revision")
    leased = F.col("state") == "leased"
    state = F.when(leased & (F.col("attempts") >= max_attempts), "dead_letter").when(leased, "queued").otherwise(F.col("state"))
    return jobs.withColumn("state", state)
