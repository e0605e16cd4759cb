"""Provider answers about people, web-search answers, and the role dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions.text import fields, let, squeeze

DOMAIN_PEOPLE = ("struct<emails:array<struct<value:string,type:string,confidence:double,first_name:string,last_name:string,position:string,"
                 "seniority:string,department:string,linkedin:string,sources:array<struct<uri:string>>>>>")
SEARCH_RESULTS = "struct<results:array<struct<url:string,title:string,content:string,engine:string>>>"
MAX_SEARCH_RESULTS = 10

# The default roles, best first; the first role whose keyword a title holds decides.
TARGET_ROLES = (
    ("Practice Owner", "owner", ("practice owner", "owner", "proprietor", "founder", "co-founder", "principal dentist", "managing partner",
                                 "managing director", "ceo", "chief executive")),
    ("Dentist Owner", "owner", ("dentist owner", "owner dentist", "doctor owner", "owner and dentist", "dentist and owner")),
    ("Practice Manager", "manager", ("practice manager", "clinic manager", "general manager", "centre manager", "center manager")),
    ("Office Manager", "manager", ("office manager", "front office manager", "business manager", "administrator")),
    ("Operations Manager", "operations", ("operations manager", "director of operations", "operations director", "coo")),
)
FALLBACK_ROLES = (
    ("Dentist", "dentist", ("dentist", "doctor", "dds", "dmd", "bds", "orthodontist", "prosthodontist", "periodontist", "endodontist",
                            "oral surgeon", "implantologist")),
)
EXCLUDED_WORDS = ("associate", "hygienist", "receptionist", "assistant", "front desk", "coordinator", "technician", "nurse", "intern",
                  "student", "trainee", "patient", "testimonial", "locum", "visiting", "consultant")


def load_roles(spark: SparkSession, path: str) -> DataFrame:
    """A roles file (target_roles, fallback_roles, exclude_keywords) as rows (kind, rank, name, role_type, keyword, place in the file)."""
    role = "array<struct<name:string,role_type:string,keywords:array<string>>>"
    raw = spark.read.schema(f"target_roles {role}, fallback_roles {role}, exclude_keywords array<string>").option("multiLine", True).json(path)

    def rows(column: str, kind: str, rank: Column) -> DataFrame:
        return raw.select(F.posexplode(column).alias("at", "r")).select(
            F.lit(kind).alias("kind"), rank.alias("rank"), "r.name", "r.role_type", F.explode("r.keywords").alias("keyword"), F.col("at").alias("place"))

    excluded = raw.select(F.lit("excluded").alias("kind"), F.lit(99).alias("rank"), F.lit(None).cast("string").alias("name"),
                          F.lit("other").alias("role_type"), F.explode("exclude_keywords").alias("keyword"), F.lit(0).alias("place"))
    every = rows("target_roles", "target", F.col("at")).unionByName(rows("fallback_roles", "fallback", F.lit(50))).unionByName(excluded)
    return every.withColumn("keyword", F.trim(F.regexp_replace(F.lower("keyword"), r"[\s\-/]+", " ")))


def classify_by_roles(rows: DataFrame, title: str, roles: DataFrame, out: str = "role") -> DataFrame:
    """Rows with struct(kind, rank, role_name, role_type) of a title by the roles given (see ``load_roles``), as
    ``classify_title`` does by its own. The roles are a file's, so they reach every row as one array."""
    step = F.when(F.col("kind") == "target", 0).when(F.col("kind") == "excluded", 1).otherwise(2)
    role = F.struct(step.alias("step"), "place", "kind", "rank", F.col("name").alias("role_name"), "role_type", "keyword")
    listed = roles.agg(F.array_sort(F.collect_list(role))).scalar()
    padded = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(title), r"(?U)[\s\-/]+", " ")), F.lit(" "))
    known = rows.withColumn("__roles", listed).withColumn("__padded", padded)
    found = F.filter("__roles", lambda r: F.contains(F.col("__padded"), F.concat(F.lit(" "), r["keyword"], F.lit(" "))))
    first = F.try_element_at(found, F.lit(1))
    held = F.struct(*[first[c].alias(c) for c in ("kind", "rank", "role_name", "role_type")])
    return known.withColumn(out, F.when(first.isNotNull(), held)).drop("__roles", "__padded")


def classify_title(title: Column) -> Column:
    """struct(kind, rank, role_name, role_type) of a job title, NULL when no role keyword is in it.

    Keywords match whole words of the title with hyphens and slashes read as spaces: target roles
    in order, then excluded words, then fallback roles.
    """
    def held(padded: Column, words) -> Column:
        test = F.lit(False)
        for word in words:
            test = test | F.contains(padded, F.lit(f" {word.replace('-', ' ')} "))
        return test

    def role(kind: str, rank: int, name: str | None, role_type: str) -> Column:
        return fields(kind=F.lit(kind), rank=F.lit(rank), role_name=F.lit(name).cast("string"), role_type=F.lit(role_type))

    def decide(padded: Column) -> Column:
        steps = [F.when(held(padded, words), role("target", i, name, kind)) for i, (name, kind, words) in enumerate(TARGET_ROLES)]
        steps.append(F.when(held(padded, EXCLUDED_WORDS), role("excluded", 99, None, "other")))
        steps += [F.when(held(padded, words), role("fallback", 50, name, kind)) for name, kind, words in FALLBACK_ROLES]
        return F.coalesce(*steps)

    return let(F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(title), r"(?U)[\s\-/]+", " ")), F.lit(" ")), decide)


def ingest_domain_people(responses: DataFrame, column: str = "raw") -> DataFrame:
    """One row per address a people provider returned; values without @ are skipped."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    rows = responses.withColumn("r", F.from_json(column, DOMAIN_PEOPLE))
    rows = rows.select(*[c for c in responses.columns if c != column], F.posexplode("r.emails").alias("pos", "e"))
    rows = rows.withColumn("email", F.trim("e.value")).where(F.contains("email", F.lit("@")))
    first, last = text(F.col("e.first_name")), text(F.col("e.last_name"))
    name = F.nullif(F.concat_ws(" ", first, last), F.lit(""))
    confidence = F.least(F.greatest(F.coalesce("e.confidence", F.lit(0.0)), F.lit(0.0)), F.lit(100.0))
    urls = F.filter(F.transform("e.sources", lambda s: s["uri"]), lambda u: F.coalesce(u, F.lit("")) != "")
    return rows.select(
        *[c for c in responses.columns if c != column], "pos", "email", F.coalesce(name, "email").alias("name"), first.alias("first_name"),
        last.alias("last_name"), squeeze(F.col("e.position")).alias("position"), F.col("e.seniority").alias("seniority"),
        ((F.coalesce("e.type", F.lit("")) == "generic") | name.isNull()).alias("generic"), F.col("e.linkedin").alias("linkedin_url"),
        F.slice(urls, 1, 10).alias("source_urls"), F.size(urls).alias("n_sources"), F.round(confidence / 100, 3).cast("decimal(4,3)").alias("confidence"))


def ingest_search_results(answers: DataFrame, column: str = "raw", best: int = MAX_SEARCH_RESULTS) -> DataFrame:
    """Search results with a URL, ranked as returned, the best ones."""
    found = F.filter(F.from_json(column, SEARCH_RESULTS)["results"], lambda r: F.coalesce(r["url"], F.lit("")) != "")
    rest = [c for c in answers.columns if c != column]
    rows = answers.select(*rest, F.posexplode(F.slice(found, 1, best)).alias("rank", "r"))
    return rows.select(*rest, "rank", "r.url", *[F.coalesce(F.col(f"r.{c}"), F.lit("")).alias(c) for c in ("title", "content", "engine")])
