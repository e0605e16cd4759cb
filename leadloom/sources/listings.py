"""Listing payloads (one JSON text per place) to typed business rows, the payload kept beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import urls
from leadloom.functions.places import normalize_listed_phone, parse_address
from leadloom.functions.text import normalize_text

LISTING = ("struct<name:string,place_id:string,coordinates:struct<latitude:string,longitude:string>,address:string,rating:string,"
           "reviews_count:string,categories:array<string>,website:string,phone:string,hours:array<string>,link:string>")


def _cleaned(items: Column) -> Column:
    squeezed = F.transform(F.coalesce(items, F.array().cast("array<string>")),
                           lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.filter(squeezed, lambda x: x.isNotNull() & (x != ""))


def ingest_listings(raw: DataFrame, country: Column, column: str = "raw", source: str = "google_maps") -> DataFrame:
    """Typed rows of parseable listings with a name; numbers that do not parse become NULL."""
    place = F.from_json(column, LISTING)
    rows = raw.withColumn("p", place).withColumn("name", F.left(normalize_text(F.col("p.name")), F.lit(255)))
    rows = rows.where(F.col("name").isNotNull()).withColumns({
        "website_url": urls.normalize_website(F.col("p.website")), "address": normalize_text(F.col("p.address")),
        "google_maps_url": normalize_text(F.col("p.link")), "country": normalize_text(country)})
    rows = rows.withColumn("located", parse_address(F.col("address"), F.col("country")))
    hours = _cleaned(F.col("p.hours"))
    kept = [c for c in raw.columns if c not in (column, "name")]
    return rows.select(
        *kept, "name", F.get(_cleaned(F.col("p.categories")), 0).alias("category"), "website_url",
        F.nullif(F.regexp_replace(urls.hostname(F.col("website_url")), r"^www\.", ""), F.lit("")).alias("domain"),
        normalize_listed_phone(F.col("p.phone"), F.col("country")).alias("phone"), "address", "located.city", "located.state",
        "located.postal_code", "country", F.col("p.coordinates.latitude").try_cast("decimal(10,7)").alias("latitude"),
        F.col("p.coordinates.longitude").try_cast("decimal(10,7)").alias("longitude"),
        F.coalesce(normalize_text(F.col("p.place_id")), urls.place_id_from_url(F.col("google_maps_url"))).alias("google_place_id"),
        "google_maps_url", F.col("p.rating").try_cast("decimal(2,1)").alias("google_rating"),
        F.col("p.reviews_count").try_cast("double").cast("int").alias("google_review_count"),
        F.when(F.size(hours) > 0, hours).alias("opening_hours"), F.lit(source).alias("source"),
        F.col("google_maps_url").alias("source_url"))


def keep_raw(raw: DataFrame, column: str = "raw", source: str = "google_maps", discovered_at: Column | None = None) -> DataFrame:
    """The unnormalised payload as VARIANT, with its source name and time."""
    return raw.withColumns({"raw_data": F.try_parse_json(column), "source": F.lit(source),
                            "discovered_at": discovered_at if discovered_at is not None else F.lit(None).cast("timestamp")}).drop(column)


def search_queries(campaigns: DataFrame) -> DataFrame:
    """Search terms times locations (the country when a campaign names no place), country appended
    unless the location already contains it."""
    empty = F.array().cast("array<string>")
    country = F.trim(F.coalesce("target_country", F.lit("")))
    usable = lambda c: F.filter(F.transform(F.coalesce(F.col(c), empty), lambda x: F.trim(x)), lambda x: x != "")
    places = F.when(F.size(usable("target_locations")) > 0, usable("target_locations")).when(country != "", F.array(country)).otherwise(empty)
    rows = campaigns.select("id", country.alias("c"), usable("search_terms").alias("terms"), places.alias("places"))
    rows = rows.select("id", "c", "places", F.posexplode("terms").alias("term_no", "term"))
    rows = rows.select("id", "c", "term_no", "term", F.posexplode("places").alias("place_no", "place"))
    full = F.when((F.col("c") != "") & ~F.contains(F.lower("place"), F.lower("c")), F.concat("place", F.lit(", "), "c")).otherwise(F.col("place"))
    return rows.select(F.col("id").alias("campaign_id"), "term_no", "place_no", F.concat("term", F.lit(" in "), full).alias("query"))
