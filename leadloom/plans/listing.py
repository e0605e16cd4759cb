"""Listing queries."""

from pyspark.sql import functions as F

from leadloom.functions import places, text, urls
from leadloom.operators import listings
from leadloom.plans.registry import query
from leadloom.sources import listings as source

_KEYS = """SELECT *, lower(replace(name, '#', ' ')) AS nk, lower(address) AS ak, regexp_replace(lower(domain), '^www\\.', '') AS dk FROM {v_listings}"""
_SAME = """CASE WHEN a.place_id IS NOT NULL AND b.place_id IS NOT NULL THEN a.place_id = b.place_id
 WHEN a.maps_url IS NOT NULL AND a.maps_url = b.maps_url THEN true WHEN a.nk IS NULL OR a.nk IS DISTINCT FROM b.nk THEN false
 WHEN a.ak IS NOT NULL AND b.ak IS NOT NULL THEN a.ak = b.ak ELSE coalesce(a.dk = b.dk, false) END"""


def _split(v):
    """The first source is saved, the rest was found now."""
    rows = listings.identify(v.v_listings)
    saved = rows.where(F.col("arrival") % 4 == 0).withColumnRenamed("arrival", "id")
    return rows.where(F.col("arrival") % 4 != 0), saved


@query("listing_matches", "J1 J2", f"""
WITH k AS MATERIALIZED ({_KEYS}), m AS (SELECT a.arrival, b.arrival AS saved_id, b.campaign_id, a.campaign_id <> b.campaign_id AS other
  FROM k a JOIN k b ON a.arrival % 4 <> 0 AND b.arrival % 4 = 0 AND (a.nk = b.nk OR a.maps_url = b.maps_url OR a.place_id = b.place_id) AND {_SAME})
SELECT k.arrival, x.saved_id, x.campaign_id AS saved_campaign_id FROM k LEFT JOIN (SELECT DISTINCT ON (arrival) * FROM m ORDER BY arrival, other, saved_id) x
  ON x.arrival = k.arrival WHERE k.arrival % 4 <> 0""")
def listing_matches(v):
    found, saved = _split(v)
    return listings.first_match(found, saved).select(
        "arrival", F.col("match.id").alias("saved_id"), F.col("match.campaign_id").alias("saved_campaign_id"))


@query("new_listings", "J2 U5", f"""
WITH k AS MATERIALIZED ({_KEYS}) SELECT arrival, name FROM k a WHERE arrival % 4 <> 0 AND NOT EXISTS (
 SELECT 1 FROM k b WHERE b.arrival % 4 = 0 AND (a.nk = b.nk OR a.maps_url = b.maps_url OR a.place_id = b.place_id) AND {_SAME})""")
def new_listings(v):
    found, saved = _split(v)
    return listings.new_listings(found, saved).select("arrival", "name")


@query("greedy_listings", "W11", f"""
WITH RECURSIVE k AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY arrival) AS n FROM ({_KEYS}) x),
p AS MATERIALIZED (SELECT a.n AS later, b.n AS earlier FROM k a JOIN k b ON b.n < a.n AND (a.nk = b.nk OR a.maps_url = b.maps_url OR a.place_id = b.place_id) AND {_SAME}),
e AS MATERIALIZED (SELECT k.n, k.arrival, coalesce(list(p.earlier) FILTER (p.earlier IS NOT NULL), []) AS earlier FROM k LEFT JOIN p ON p.later = k.n GROUP BY 1, 2),
f(n, arrival, accepted, taken) AS (
  SELECT 0::bigint, NULL::bigint, false, []::bigint[]
  UNION ALL
  SELECT e.n, e.arrival, NOT list_has_any(f.taken, e.earlier), CASE WHEN list_has_any(f.taken, e.earlier) THEN f.taken ELSE list_append(f.taken, e.n) END
  FROM f JOIN e ON e.n = f.n + 1)
SELECT arrival, accepted FROM f WHERE n > 0""")
def greedy_listings(v):
    return listings.greedy_dedupe(v.v_listings).select("arrival", "accepted")


@query("insert_new", "S3", """
WITH x AS (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY arrival) AS rn FROM {v_listings} WHERE arrival % 4 <> 0 OR arrival % 8 = 0)
SELECT arrival, place_id FROM x WHERE place_id IS NULL OR (rn = 1 AND place_id NOT IN (SELECT place_id FROM {v_listings} WHERE arrival % 8 = 4 AND place_id IS NOT NULL))""")
def insert_new(v):
    phase = F.col("arrival") % 8
    existing = v.v_listings.where(phase == 4)
    incoming = v.v_listings.where((F.col("arrival") % 4 != 0) | (phase == 0))
    return listings.insert_new(existing, incoming, "place_id", "arrival").select("arrival", "place_id")


def _raw(v):
    """Places as a listing service sends them, one JSON text each."""
    rows, key = v.v_listings, F.col("arrival").cast("string")
    kind = F.col("arrival") % 5
    place = F.struct(
        F.when(kind == 4, F.lit("  ")).otherwise(F.concat(F.lit("  "), "name", F.lit("​  Ltd "))).alias("name"),
        F.when(kind == 0, F.col("place_id")).alias("place_id"),
        F.struct(F.concat(F.lit("24."), key).alias("latitude"), F.when(kind == 1, "east").otherwise("67.5").alias("longitude")).alias("coordinates"),
        F.concat(F.coalesce("address", F.lit("Plot")), F.when(kind == 0, ", Karachi, 75300, Pakistan").when(kind == 1, ", Lahore, Punjab 54000, Pakistan")
                 .when(kind == 2, ", London SW1A 2AA, UK").otherwise(", Islamabad, Pakistan")).alias("address"),
        F.when(kind == 2, "n/a").otherwise(F.concat(F.lit("4."), (F.col("arrival") % 10).cast("string"))).alias("rating"),
        F.when(kind == 3, F.lit("many")).otherwise(key).alias("reviews_count"), F.array(F.lit(" "), F.lit("Dental  clinic")).alias("categories"),
        F.when(F.col("domain").isNotNull(), F.concat(F.lit("HTTP://"), F.upper("domain"), F.lit(":80/a/#x"))).alias("website"),
        F.concat(F.lit("92300"), F.lpad(key, 7, "0")).alias("phone"), F.array(F.lit("Mon  9-5"), F.lit("")).alias("hours"),
        F.concat(F.lit("https://maps.example.com/!19s"), F.coalesce("place_id", F.lit("none")), F.lit("?x=!3d1.5!4d-2")).alias("link"))
    return rows.select("arrival", F.to_json(place).alias("raw"))


@query("ingest_listings", "S1 X1 X9 X11", """
SELECT arrival, name || ' Ltd' AS name, 'Dental clinic' AS category, CASE WHEN domain IS NOT NULL THEN 'http://' || regexp_replace(lower(domain), '^www\\.', '') || '/a' END AS website_url,
 regexp_replace(lower(domain), '^www\\.', '') AS domain, '+92300' || lpad(cast(arrival AS varchar), 7, '0') AS phone,
 CASE k WHEN 0 THEN 'Karachi' WHEN 1 THEN 'Lahore' WHEN 2 THEN 'London' ELSE 'Islamabad' END AS city, CASE k WHEN 1 THEN 'Punjab' END AS state,
 CASE k WHEN 0 THEN '75300' WHEN 1 THEN '54000' WHEN 2 THEN 'SW1A 2AA' END AS postal_code, place_id AS google_place_id,
 cast(CASE k WHEN 2 THEN NULL ELSE '4.' || (arrival % 10) END AS decimal(2, 1)) AS google_rating, CASE WHEN k <> 3 THEN arrival END AS google_review_count,
 cast('24.' || arrival AS decimal(10, 7)) AS latitude, cast(CASE WHEN k <> 1 THEN '67.5' END AS decimal(10, 7)) AS longitude, 'Mon 9-5' AS hours
FROM (SELECT *, arrival % 5 AS k FROM {v_listings}) x WHERE k <> 4""")
def ingest_listings(v):
    rows = source.ingest_listings(_raw(v), F.lit("Pakistan"))
    return rows.select("arrival", "name", "category", "website_url", "domain", "phone", "city", "state", "postal_code", "google_place_id",
                       "google_rating", "google_review_count", "latitude", "longitude", F.array_join("opening_hours", "|").alias("hours"))


@query("keep_raw", "S2", """
SELECT arrival, CASE WHEN arrival % 5 = 0 THEN place_id END AS place_id, '67.5' AS longitude FROM {v_listings} WHERE arrival % 5 <> 1""")
def keep_raw(v):
    kept = source.keep_raw(_raw(v))
    read = lambda path: F.try_variant_get("raw_data", path, "string")
    return kept.select("arrival", read("$.place_id").alias("place_id"), read("$.coordinates.longitude").alias("longitude")).where(F.col("arrival") % 5 != 1)


@query("parsed_addresses", "X9 X20", """
SELECT id, CASE k WHEN 0 THEN 'Karachi' WHEN 1 THEN 'Lahore' WHEN 2 THEN 'Austin' WHEN 3 THEN 'London' WHEN 4 THEN 'Islamabad' END AS city,
 CASE k WHEN 1 THEN 'Punjab' WHEN 2 THEN 'TX' END AS state, CASE k WHEN 0 THEN '75300' WHEN 1 THEN '54000' WHEN 2 THEN '78701' WHEN 3 THEN 'SW1A 2AA' END AS postal_code,
 CASE k WHEN 0 THEN 'Karachi' WHEN 1 THEN 'Lahore' WHEN 3 THEN 'UK' WHEN 4 THEN 'Islamabad' WHEN 2 THEN 'United States' END AS location
FROM (SELECT c_custkey AS id, c_custkey % 6 AS k FROM {customer}) x""")
def parsed_addresses(v):
    kind, key = F.col("c_custkey") % 6, F.col("c_custkey").cast("string")
    address = (F.when(kind == 0, F.concat(F.lit("Building, Room # "), key, F.lit(", Block 3 Gulshan-e-Iqbal, Karachi, 75300, Pakistan")))
               .when(kind == 1, F.concat(F.lit("Shop "), key, F.lit(", Main Blvd, Gulberg III, Lahore, Punjab 54000, Pakistan")))
               .when(kind == 2, F.concat(key, F.lit(" Congress Ave, Austin 1, Austin, TX 78701, United States")))
               .when(kind == 3, F.concat(key, F.lit(" Downing St, London SW1A 2AA, UK"))).when(kind == 4, F.concat(F.lit("Plot "), key, F.lit(", F-7 Markaz, Islamabad, Pakistan")))
               .otherwise(F.concat(F.lit("B-"), key, F.lit(" karachi"))))
    rows = v.customer.select(F.col("c_custkey").alias("id"), address.alias("address"))
    parsed = rows.withColumn("p", places.parse_address(F.col("address"), F.lit("Pakistan")))
    return parsed.select("id", "p.city", "p.state", "p.postal_code", places.business_location(F.lit(None).cast("string"), F.col("address"), F.lit("Pakistan")).alias("location"))


@query("listing_numbers", "X8 X10", """
SELECT c_custkey AS id, 1000 + c_custkey AS reviews, '+92300' || lpad(cast(c_custkey AS varchar), 7, '0') AS phone, right('92300' || lpad(cast(c_custkey AS varchar), 7, '0'), 9) AS key,
 '+1212' || lpad(cast(c_custkey AS varchar), 7, '0') AS us FROM {customer}""")
def listing_numbers(v):
    key = F.col("c_custkey")
    padded = F.lpad(key.cast("string"), 7, "0")
    phone = places.normalize_phone(F.concat(F.lit("0300-"), padded), F.lit("Pakistan"))
    return v.customer.select(
        key.alias("id"), places.parse_review_count(F.concat(F.lit("4.7\n("), F.format_number(key + 1000, 0), F.lit(")"))).alias("reviews"),
        phone.alias("phone"), places.phone_key(phone).alias("key"),
        places.normalize_phone(F.concat(F.lit("(212) "), F.substring(padded, 1, 3), F.lit("-"), F.substring(padded, 4, 4)), F.lit("USA")).alias("us"))


@query("refresh_fields", "S16", """
SELECT id, coalesce(nullif(nc, ''), category) AS category, coalesce(nr, google_review_count) AS google_review_count, CASE WHEN coalesce(website_url, '') = '' THEN 'https://new.org' ELSE website_url END AS website_url,
 CASE WHEN coalesce(city, '') = '' THEN 'Lahore' ELSE city END AS city,
 concat_ws(',', CASE WHEN coalesce(nc, '') <> '' AND nc <> category THEN 'category' END, CASE WHEN nr IS NOT NULL AND nr IS DISTINCT FROM google_review_count THEN 'google_review_count' END,
  CASE WHEN coalesce(website_url, '') = '' THEN 'website_url' END, CASE WHEN coalesce(city, '') = '' THEN 'city' END) AS changed
FROM (SELECT *, CASE id % 4 WHEN 0 THEN 'BUILDING' WHEN 1 THEN '' END AS nc, CASE WHEN id % 2 = 0 THEN 120 END AS nr FROM {v_businesses}) x""")
def refresh_fields(v):
    key = F.col("c_custkey")
    fresh = v.customer.select(key.alias("id"), F.when(key % 4 == 0, "BUILDING").when(key % 4 == 1, "").alias("new_category"),
                              F.when(key % 2 == 0, 120).alias("new_google_review_count"), F.lit("https://new.org").alias("new_website_url"),
                              F.lit("Lahore").alias("new_city"))
    return listings.refresh_fields(v.v_businesses, fresh).select(
        "id", "category", "google_review_count", "website_url", "city", F.array_join("changed", ",").alias("changed"))


@query("backfill_place_ids", "M12 X11", """
WITH b AS (SELECT arrival AS id, CASE WHEN arrival % 3 <> 0 THEN place_id END AS stored, place_id AS link_id FROM {v_listings}
 UNION ALL SELECT arrival + 1000000000, NULL, place_id FROM {v_listings}),
r AS (SELECT id, link_id AS place_id, min(id) OVER (PARTITION BY link_id) AS lowest FROM b WHERE stored IS NULL AND link_id IS NOT NULL)
SELECT id, place_id, id <> lowest OR place_id IN (SELECT stored FROM b WHERE stored IS NOT NULL) AS taken FROM r""")
def backfill_place_ids(v):
    link = F.concat(F.lit("https://maps.example.com/data=!19s"), "place_id", F.lit("?y=1"))
    own = v.v_listings.select(F.col("arrival").alias("id"), F.when(F.col("arrival") % 3 != 0, F.col("place_id")).alias("google_place_id"), link.alias("google_maps_url"))
    twin = v.v_listings.select((F.col("arrival") + 1000000000).alias("id"), F.lit(None).cast("string").alias("google_place_id"), link.alias("google_maps_url"))
    return listings.backfill_place_ids(own.unionByName(twin))


@query("remaining_demand", "O7", """
WITH RECURSIVE x AS (SELECT o_custkey % 25 AS campaign_id, o_orderkey // 200 AS query_no, o_orderkey % 200 AS position, o_orderkey % 3 = 0 AS is_new FROM {orders}),
q AS MATERIALIZED (SELECT campaign_id, query_no, row_number() OVER (PARTITION BY campaign_id ORDER BY query_no) AS n,
  list(position ORDER BY position) FILTER (WHERE is_new) AS fresh FROM x WHERE position < 150 GROUP BY 1, 2),
f(campaign_id, n, query_no, taken, accepted) AS (
  SELECT DISTINCT campaign_id, 0::bigint, NULL::bigint, []::bigint[], 0::bigint FROM q
  UNION ALL
  SELECT campaign_id, n, query_no, t, accepted + len(t)
  FROM (SELECT f.campaign_id, q.n, q.query_no, f.accepted, (SELECT coalesce(list(p ORDER BY p), []) FROM (SELECT unnest(q.fresh) AS p ORDER BY p) u
      WHERE p < least(100 - f.accepted + f.campaign_id % 4, 150))[1:100 - f.accepted] AS t
    FROM f JOIN q ON q.campaign_id = f.campaign_id AND q.n = f.n + 1 WHERE f.accepted < 100) s)
SELECT campaign_id, query_no, unnest(taken) AS position FROM f WHERE n > 0""")
def remaining_demand(v):
    key = F.col("o_orderkey")
    results = v.orders.select((F.col("o_custkey") % 25).alias("campaign_id"), F.floor(key / 200).alias("query_no"),
                              (key % 200).alias("position"), (key % 3 == 0).alias("is_new"))
    known = v.nation.select(F.col("n_nationkey").cast("long").alias("campaign_id"), (F.col("n_nationkey") % 4).alias("known"))
    return listings.remaining_demand(results, known, 100, 150).select("campaign_id", "query_no", "position")


@query("search_queries", "U1 X34", """
SELECT cast(n_nationkey AS bigint) AS campaign_id, t.no AS term_no, p.no AS place_no,
 t.term || ' in ' || CASE WHEN contains(lower(p.place), lower(n_name)) THEN p.place ELSE p.place || ', ' || n_name END AS query
FROM {nation}, (VALUES (0, 'dental clinic'), (1, 'spa')) t(no, term),
 LATERAL (SELECT * FROM (VALUES (0, CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE 'Lahore' END), (1, 'Old ' || lower(n_name))) q(no, place) WHERE n_nationkey % 3 <> 0 OR no = 0) p""")
def search_queries(v):
    no_places = F.col("n_nationkey") % 3 == 0
    campaigns = v.nation.select(
        F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit(" "), "n_name").alias("target_country"),
        text.parse_list(F.lit("dental clinic, , spa,")).alias("search_terms"),
        F.when(~no_places, F.array(F.lit("Lahore "), F.concat(F.lit("Old "), F.lower("n_name")))).alias("target_locations"))
    return source.search_queries(campaigns)


@query("name_keys", "X2 X13", """
SELECT p_partkey AS id, lower(p_name) || ' obriens ' || p_size AS key, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') || 'obriens' || p_size AS token FROM {part}""")
def name_keys(v):
    name = F.concat(F.upper("p_name"), F.lit(" O'Brien’s_"), F.col("p_size").cast("string"), F.lit(" &"))
    return v.part.select(F.col("p_partkey").alias("id"), text.normalize_name_key(name).alias("key"), text.ascii_token(name).alias("token"))


@query("websites", "X3 X4", """
SELECT id, CASE k WHEN 0 THEN 'https://b' || id || '.org' WHEN 1 THEN 'http://b' || id || '.org:8080/a' WHEN 2 THEN 'https://b' || id || '.org/x?y=1' WHEN 3 THEN NULL ELSE 'https://b' || id || '.org' END AS website,
 CASE WHEN k <> 3 THEN 'b' || id || '.org' END AS domain, CASE k WHEN 3 THEN NULL ELSE 'b' || id || '.org' END AS host
FROM (SELECT c_custkey AS id, c_custkey % 5 AS k FROM {customer}) x""")
def websites(v):
    kind, key = F.col("c_custkey") % 5, F.col("c_custkey").cast("string")
    site = (F.when(kind == 0, F.concat(F.lit(" WWW.B"), key, F.lit(".org/ "))).when(kind == 1, F.concat(F.lit("HTTP://b"), key, F.lit(".org:8080/a/")))
            .when(kind == 2, F.concat(F.lit("https://www.b"), key, F.lit(".org:443/x?y=1#z"))).when(kind == 3, F.lit("ftp://gmail.com"))
            .otherwise(F.concat(F.lit("//b"), key, F.lit(".org."))))
    rows = v.customer.select(F.col("c_custkey").alias("id"), site.alias("site"))
    host = F.rtrim(urls.host_of(F.col("site")), F.lit("."))
    return rows.select("id", urls.normalize_website(F.col("site")).alias("website"), urls.normalize_domain(F.col("site")).alias("domain"), host.alias("host"))
