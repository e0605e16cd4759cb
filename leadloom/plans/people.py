"""Decision-maker queries; people and texts are made from the customer rows."""

import uuid

from pyspark.sql import functions as F

from leadloom.functions import names, places
from leadloom.operators import people
from leadloom.plans.registry import query
from leadloom.scale import dealt_out, not_broadcast
from leadloom.session import ensure_checkpoint_dir
from leadloom.sources import people as provider

FIRST = ("Ann", "Omar", "Élise", "Syed", "Mary")
LAST = ("Lee", "Khan", "Müller", "Noor-Shah", "Stone")
_FIRST, _LAST = "['Ann', 'Omar', 'Élise', 'Syed', 'Mary']", "['Lee', 'Khan', 'Müller', 'Noor-Shah', 'Stone']"
_WHO = f"SELECT c_custkey AS id, {_FIRST}[c_custkey % 5 + 1] AS f, {_LAST}[(c_custkey // 5) % 5 + 1] AS l FROM {{customer}}"


def _who(v):
    key = F.col("c_custkey")
    pick = lambda values, at: F.get(F.array(*[F.lit(x) for x in values]), at.cast("int"))
    return v.customer.select(key.alias("id"), pick(FIRST, key % 5).alias("f"), pick(LAST, F.floor(key / 5) % 5).alias("l"))


# A person for every document: its first two plain words, in the ways that names are written.
_WORDED = f"""SELECT doc_id + {1_000_000_000} AS id, upper(w[1][1]) || w[1][2:] AS f, upper(w[2][1]) || w[2][2:] AS l FROM (
 SELECT doc_id, list_filter(string_split(text, ' '), lambda x: regexp_full_match(x, '[a-z]{{7,12}}')) AS w FROM {{documents}}) d WHERE len(w) > 1 AND w[1] <> w[2]"""


def _worded(v):
    """(id, f, l, text) of the documents with two plain words."""
    words = F.filter(F.split("text", " "), lambda x: x.rlike(r"\A[a-z]{7,12}\z"))
    rows = v.documents.select((F.col("doc_id") + 1_000_000_000).alias("id"), words.alias("w"), "text").where((F.size("w") > 1) & (F.get("w", 0) != F.get("w", 1)))
    return rows.select("id", F.initcap(F.get("w", 0)).alias("f"), F.initcap(F.get("w", 1)).alias("l"), "text")


@query("cleaned_names", "X14", f"""
SELECT id, f || ' ' || l AS name, f AS first_name, l AS last_name, lower(f) || '|' || lower(l) AS person_key FROM ({_WORDED}) d
UNION ALL SELECT id, CASE k WHEN 3 THEN NULL WHEN 6 THEN NULL ELSE f || ' ' || l END AS name, CASE WHEN k IN (3, 6) THEN NULL ELSE f END AS first_name,
 CASE WHEN k IN (3, 6) THEN NULL ELSE l END AS last_name,
 CASE WHEN k IN (3, 6) THEN NULL ELSE lower(strip_accents(f)) || '|' || replace(lower(strip_accents(l)), '-', '') END AS person_key
FROM (SELECT *, id % 7 AS k FROM ({_WHO}) w) x""")
def cleaned_names(v):
    kind, whole = F.col("id") % 7, F.concat_ws(" ", "f", "l")
    raw = (F.when(kind == 0, F.concat(F.lit("Dr. M. "), whole, F.lit(", DDS"))).when(kind == 1, F.concat(F.lit("  meet "), whole, F.lit(" MD PhD ")))
           .when(kind == 2, F.concat(whole, F.lit("'s"))).when(kind == 3, F.concat("f", F.lit("'s Smile "), "l")).when(kind == 4, F.concat(F.lit("Mr. J K "), whole))
           .when(kind == 5, F.concat("f", F.lit(",  "), "l")).otherwise(F.concat(F.lit("The "), "f", F.lit(" Dental "), "l")))
    written = (F.when(kind == 0, F.concat(F.lit("Prof. "), whole, F.lit(", MD"))).when(kind == 1, F.concat(F.lit(" "), whole, F.lit("'s"))).when(kind == 2, F.concat(F.lit("Mrs. K "), whole))
               .when(kind == 3, F.concat("f", F.lit(",   "), "l")).when(kind == 4, F.concat(F.lit("Dr "), whole, F.lit(" PhD, FCPS"))).otherwise(F.concat(F.lit("  "), "f", F.lit(" \t"), "l")))
    found = _who(v).select("id", names.clean_name(raw).alias("n")).unionByName(_worded(v).select("id", names.clean_name(written).alias("n")))
    return found.select("id", "n.*")


TITLES = ("Co-Founder & CEO", "Associate Dentist", "Front Office Manager", "Senior Orthodontist", "Director of Operations", "Cook", "Dentist/Owner", "Nurse Administrator")


@query("classified_titles", "J9", """
SELECT p_partkey AS id, CASE k WHEN 0 THEN 'target' WHEN 1 THEN 'excluded' WHEN 2 THEN 'target' WHEN 3 THEN 'fallback' WHEN 4 THEN 'target' WHEN 6 THEN 'target' WHEN 7 THEN 'target' END AS kind,
 CASE k WHEN 0 THEN 0 WHEN 1 THEN 99 WHEN 2 THEN 3 WHEN 3 THEN 50 WHEN 4 THEN 4 WHEN 6 THEN 0 WHEN 7 THEN 3 END AS rank,
 CASE k WHEN 0 THEN 'Practice Owner' WHEN 2 THEN 'Office Manager' WHEN 3 THEN 'Dentist' WHEN 4 THEN 'Operations Manager' WHEN 6 THEN 'Practice Owner' WHEN 7 THEN 'Office Manager' END AS role_name
FROM (SELECT p_partkey, p_partkey % 8 AS k FROM {part}) x""")
def classified_titles(v):
    title = F.get(F.array(*[F.lit(t) for t in TITLES]), (F.col("p_partkey") % 8).cast("int"))
    rows = v.part.select(F.col("p_partkey").alias("id"), provider.classify_title(F.concat(title, F.lit(" "), F.lower("p_name"))).alias("r"))
    return rows.select("id", "r.kind", "r.rank", "r.role_name")


@query("titles_by_own_roles", "S9 J9", """
SELECT c_custkey AS id, CASE n_regionkey WHEN 0 THEN 'target' WHEN 1 THEN 'target' WHEN 2 THEN 'fallback' WHEN 3 THEN 'excluded' END AS kind,
 CASE WHEN n_regionkey < 2 THEN (SELECT count(*) FROM {nation} m WHERE m.n_regionkey < 2 AND m.n_nationkey < n.n_nationkey) WHEN n_regionkey = 2 THEN 50 WHEN n_regionkey = 3 THEN 99 END AS rank,
 CASE WHEN n_regionkey < 3 THEN n_name END AS role_name
FROM {customer} JOIN {nation} n ON n_nationkey = c_nationkey""")
def titles_by_own_roles(v):
    """A roles file made of the nations, written and loaded, against titles that name a nation."""
    def listed(test):
        role = F.struct(F.col("n_name").alias("name"), F.lit("seller").alias("role_type"), F.array(F.concat(F.lower("n_name"), F.lit("/desk"))).alias("keywords"))
        return F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("n_nationkey", role.alias("r"))))), lambda x: x["r"])

    region = F.col("n_regionkey")
    folder = f"{ensure_checkpoint_dir(v.nation.sparkSession)}/roles-{uuid.uuid4().hex}"
    v.nation.agg(listed(region < 2).alias("target_roles"), listed(region == 2).alias("fallback_roles"),
                 F.collect_list(F.when(region == 3, F.concat(F.lower("n_name"), F.lit(" desk")))).alias("exclude_keywords")).coalesce(1).write.json(folder)
    roles = provider.load_roles(v.nation.sparkSession, folder)
    rows = v.customer.join(v.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("Head, "), F.col("n_name"), F.lit("-Desk ")).alias("title"))
    return provider.classify_by_roles(rows, "title", roles).select("id", "role.kind", "role.rank", "role.role_name")


@query("extracted_people", "X15 X18", f"""
WITH w AS (SELECT *, f || ' ' || l AS whole FROM ({_WHO}) x)
SELECT id AS business_id, 0 AS shape, whole AS name, 'Practice Owner' AS job_title, 0 AS rank, 'Dr. ' || whole || ', DDS , Practice Owner since 2001' AS evidence FROM w WHERE f <> 'Élise' AND l <> 'Müller'
UNION ALL SELECT id, 1, 'Omar Khan', 'Office manager', 3, 'Our office manager is Omar Khan, the receptionist is Sara Noor.' FROM w
UNION ALL SELECT id, 2, 'Lena Brook', 'Founder', 0, 'The clinic was founded by Lena Brook and Tom Reed' FROM w
UNION ALL SELECT id, 2, 'Tom Reed', 'Founder', 0, 'The clinic was founded by Lena Brook and Tom Reed' FROM w
UNION ALL SELECT id, 5, 'Paul Hill', 'Clinic manager', 2, 'Paul Hill - Clinic manager' FROM w""")
def extracted_people(v):
    whole = F.concat_ws(" ", "f", "l")
    text = F.concat(F.lit("# **Dr. "), whole, F.lit(", DDS**, Practice Owner since 2001\nOur office manager is Omar Khan, the receptionist is Sara Noor.\n"
                                                     "The clinic was founded by Lena Brook and Tom Reed\n\nPaul Hill\nClinic manager\n"))
    texts = dealt_out(_who(v)).select(F.col("id").alias("business_id"), text.alias("text"), F.lit("Smile Dental").alias("business_name"))
    return people.extract_people(texts, ["business_id"]).select("business_id", "shape", "name", "job_title", "rank", "evidence")


@query("extracted_from_documents", "X15")
def extracted_from_documents(v):
    """Names of two capitalised words of each document, in the shapes a website has them, before its own text."""
    words = F.filter(F.regexp_extract_all("text", F.lit(r"\b([A-Z][a-z]{3,9})\b")), lambda w: w != "")
    name = F.concat(F.try_element_at(words, F.lit(1)), F.lit(" "), F.try_element_at(words, F.lit(-1)))
    said = F.concat(name, F.lit(", CEO and founder\n\nDr. "), name, F.lit(", BDS\nPrincipal Dentist\n"), F.col("text"))
    texts = v.documents.select("doc_id", F.coalesce(said, F.col("text")).alias("text"), F.lit("Smile Dental").alias("business_name"))
    return people.extract_people(texts, ["doc_id"]).select("doc_id", "shape", "name", "job_title")


def _mentions(v):
    """Mentions from orders: a business is a customer, several people each, under longer and shorter names."""
    key = F.col("o_orderkey")
    pick = lambda values, at: F.get(F.array(*[F.lit(x) for x in values]), at.cast("int"))
    first, last = pick(("Ann", "Omar", "Lena"), key % 3), pick(("Lee", "Khan"), F.floor(key / 3) % 2)
    middle = F.when(key % 4 == 0, "Rose ").otherwise("")
    kind = pick(("target", "fallback"), key % 2)
    return v.orders.select(
        F.col("o_custkey").alias("business_id"), key.alias("pos"), F.concat(F.lit("https://s.org/"), (key % 5).cast("string")).alias("url"),
        pick(("website", "search_snippet"), F.floor(key / 2) % 2).alias("source"), F.concat(first, F.lit(" "), middle, last).alias("name"),
        first.alias("first_name"), last.alias("last_name"), F.lower(F.concat(first, F.lit("|"), last)).alias("person_key"),
        F.when(kind == "target", "Owner").otherwise("Dentist").alias("job_title"), kind.alias("kind"), F.when(kind == "target", 0).otherwise(50).alias("rank"),
        F.when(kind == "target", "Practice Owner").otherwise("Dentist").alias("role_name"), F.lit("owner").alias("role_type"), F.lit(False).alias("weak"),
        F.concat(F.lit("e"), key.cast("string")).alias("evidence"))


@query("merged_people", "A15", """
WITH m AS (SELECT o_custkey AS business_id, o_orderkey AS pos, 'https://s.org/' || (o_orderkey % 5) AS url, CASE (o_orderkey // 2) % 2 WHEN 0 THEN 0.80 ELSE 0.50 END AS base,
  ['Ann', 'Omar', 'Lena'][o_orderkey % 3 + 1] AS f, ['Lee', 'Khan'][(o_orderkey // 3) % 2 + 1] AS l, o_orderkey % 4 = 0 AS longer, o_orderkey % 2 = 0 AS target FROM {orders})
SELECT business_id, lower(f || '|' || l) AS person_key, min(pos) AS arrival, CASE WHEN bool_or(longer) THEN f || ' Rose ' || l ELSE f || ' ' || l END AS name,
 CASE WHEN bool_or(target) THEN 'Owner' ELSE 'Dentist' END AS job_title, CASE WHEN bool_or(target) THEN 'target' ELSE 'fallback' END AS kind,
 any_value(n_sources) AS n_sources, any_value(best) AS base, any_value(source_urls) AS source_urls, any_value(evidences) AS evidences
FROM m JOIN (SELECT business_id, f, l, count(*) AS n_sources, cast(max(base) AS decimal(3, 2)) AS best, string_agg(url, ' ' ORDER BY first_at) AS source_urls
  FROM (SELECT business_id, f, l, url, min(pos) AS first_at, arg_min(base, pos) AS base FROM m GROUP BY 1, 2, 3, 4) u GROUP BY 1, 2, 3) s USING (business_id, f, l)
JOIN (SELECT business_id, f, l, string_agg('e' || pos, ' | ' ORDER BY pos) AS evidences FROM (SELECT *, row_number() OVER (PARTITION BY business_id, f, l ORDER BY pos) AS n FROM m) e
  WHERE n <= 3 GROUP BY 1, 2, 3) t USING (business_id, f, l) GROUP BY business_id, f, l""")
def merged_people(v):
    return people.merge_people(_mentions(v)).select("business_id", "person_key", "arrival", "name", "job_title", "kind", "n_sources", "base",
                                                    F.array_join("source_urls", " ").alias("source_urls"), F.array_join("evidences", " | ").alias("evidences"))


@query("merged_emails", "A16", """
WITH f AS (SELECT o_custkey AS business_id, o_orderkey AS pos, 'a' || (o_orderkey % 2) || '@b.org' AS address, CASE WHEN o_orderkey % 3 = 0 THEN 'search' ELSE 'website' END AS source,
  'https://s.org/' || (o_orderkey % 4) AS url FROM {orders} WHERE o_orderkey % 5 <> 0),
u AS (SELECT business_id, address, url, min(pos) AS url_pos FROM f GROUP BY 1, 2, 3), s AS (SELECT business_id, address, arg_min(source, pos) AS source, min(pos) AS first_pos FROM f GROUP BY 1, 2)
SELECT u.business_id, u.address, s.source, s.first_pos, u.url, u.url_pos FROM u JOIN s USING (business_id, address)""")
def merged_emails(v):
    key = F.col("o_orderkey")
    address = F.when(key % 5 == 0, "not an address").otherwise(F.concat(F.lit(" A"), (key % 2).cast("string"), F.lit("@B.org ")))
    found = v.orders.select(F.col("o_custkey").alias("business_id"), key.alias("pos"), address.alias("address"), F.when(key % 3 == 0, "search").otherwise("website").alias("source"),
                            F.concat(F.lit("https://s.org/"), (key % 4).cast("string")).alias("url"))
    return people.merge_found_emails(found)


_PATTERN_VALUES = ", ".join(f"({i}, '{label}', '{shape}', {base}, {'true' if '{last}' in shape or '{l}' in shape else 'false'})".replace("{", "<").replace("}", ">")
                            for i, (label, shape, base) in enumerate(names.EMAIL_PATTERNS))


@query("candidate_address_ranking", "J10 W5", f"""
WITH p AS (SELECT c_custkey AS id, c_custkey % 4 AS k FROM {{customer}}),
g AS (SELECT id, v.* FROM p JOIN (VALUES (0, 0, 'ann', 1.0::double), (1, 0, 'cher', 1.0), (2, 0, 'shoaib', 1.0), (2, 1, 'muhammad', 0.3), (3, 0, 'mary', 1.0), (3, 1, 'jane', 0.6)) v(k, gi, first, gw) ON v.k = p.k),
l AS (SELECT id, v.* FROM p JOIN (VALUES (0, 0, 'lee', 1.0::double), (1, 0, '', 1.0), (2, 0, 'ahmed', 1.0), (3, 0, 'noorshah', 1.0), (3, 1, 'noor', 0.6), (3, 2, 'shah', 0.6)) v(k, li, last, lw) ON v.k = p.k),
c AS (SELECT g.id, x.no, x.label, x.base::double AS base, CASE WHEN x.needs THEN gw * lw ELSE gw END AS weight, x.no * 1000000 + gi * 1000 + li AS seen,
  replace(replace(replace(replace(x.shape, '<first>', first), '<last>', last), '<f>', left(first, 1)), '<l>', left(last, 1)) AS local
  FROM g JOIN l USING (id) CROSS JOIN (VALUES {_PATTERN_VALUES}) x(no, label, shape, base, needs) WHERE CASE WHEN x.needs THEN last <> '' AND last <> first ELSE li = 0 END),
b AS (SELECT id, local, arg_max(label, (weight, -seen)) AS label, arg_max(no, (weight, -seen)) AS no, arg_max(base, (weight, -seen)) AS base, max(weight) AS weight, min(seen) AS seen FROM c GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, CASE WHEN id % 3 = 0 AND label = 'flast' THEN 0 ELSE 1 END, -base * weight, no, seen) - 1 AS position FROM b CROSS JOIN range(0, 2) t(d))
SELECT id AS person_id, position, local || CASE d WHEN 0 THEN '@main.org' ELSE '@other.org' END AS email, label AS pattern,
 cast(floor(CASE WHEN id % 3 = 0 AND label = 'flast' THEN 0.7 ELSE base END * weight * CASE d WHEN 0 THEN 1 ELSE 0.5 END * 200) AS int) AS score FROM r""")
def candidate_address_ranking(v):
    kind = F.col("c_custkey") % 4
    name = F.when(kind == 0, "Dr. Ann Lee").when(kind == 1, "Cher").when(kind == 2, "Muhammad Shoaib Ahmed").otherwise("Mary Jane Noor-Shah")
    crowd = v.customer.select(F.col("c_custkey").alias("person_id"), (F.col("c_custkey") % 25).alias("business_id"), name.alias("name"),
                              F.when(F.col("c_custkey") % 3 == 0, "flast").alias("observed"))
    site = F.posexplode(F.array(F.lit("main.org"), F.lit("other.org"))).alias("domain_no", "domain")
    domains = v.nation.select(F.col("n_nationkey").cast("long").alias("business_id"), site)
    ranked = people.candidate_emails(crowd, domains)
    # the confidence in steps of 0.005, clear of rounding
    label, weighted = F.col("pattern"), people.generated_addresses(crowd).select("person_id", "local", "base", "weight")
    rows = ranked.withColumn("local", F.substring_index("email", "@", 1)).join(not_broadcast(weighted), ["person_id", "local"])
    base = F.when((F.col("person_id") % 3 == 0) & (label == "flast"), 0.7).otherwise(F.col("base"))
    score = F.floor(base * F.col("weight") * F.when(F.col("email").endswith("@main.org"), 1.0).otherwise(0.5) * 200).cast("int")
    return rows.select("person_id", "position", "email", "pattern", score.alias("score"))


_TEAM = """SELECT o_custkey AS business_id, o_orderkey AS arrival, CASE WHEN o_custkey % 4 = 0 OR o_orderkey % 3 = 0 THEN 'fallback' ELSE 'target' END AS kind, o_orderkey % 5 AS r,
 concat('P', cast(o_orderkey AS string)) AS name, o_orderkey % 2 AS s, o_orderkey % 7 = 0 AS weak FROM {orders}"""


@query("ranked_contacts", "W1 A17", f"""
WITH t AS (SELECT *, CASE WHEN kind = 'target' THEN r ELSE 50 END AS rank FROM ({_TEAM}) x),
f AS (SELECT *, row_number() OVER (PARTITION BY business_id, kind ORDER BY arrival) AS n, bool_or(kind = 'target') OVER (PARTITION BY business_id) AS has_target FROM t),
c AS (SELECT *, least(least((CASE s WHEN 0 THEN 0.8::double ELSE 0.5 END + CASE s WHEN 0 THEN 0.1 ELSE 0 END + CASE WHEN kind = 'target' AND rank = 0 THEN 0.05 ELSE 0 END)
   * CASE kind WHEN 'fallback' THEN 0.7 ELSE 1 END * CASE WHEN weak THEN 0.85 ELSE 1 END, 0.95)) AS conf FROM f WHERE kind = 'target' OR (NOT has_target AND n <= 2)),
p AS (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY rank, conf DESC, arrival) AS place FROM c)
SELECT business_id, place, name, cast(floor(conf * 200) AS int) AS score, place = 1 AS is_primary FROM p WHERE place <= 4""")
def ranked_contacts(v):
    rank = F.when(F.col("kind") == "target", F.col("r")).otherwise(50)
    team = v.sql(_TEAM).withColumns({
        "rank": rank, "base": F.when(F.col("s") == 0, "0.80").otherwise("0.50").cast("decimal(3,2)"), "n_sources": F.when(F.col("s") == 0, 2).otherwise(1),
        "job_title": F.lit("Owner"), "role_name": F.lit("Practice Owner"), "role_type": F.lit("owner"), "first_name": F.col("name"), "last_name": F.lit(None).cast("string"),
        "email": F.lit(None).cast("string"), "email_source": F.lit(None).cast("string")})
    scored = people.chosen_people(team).withColumn("raw_confidence", people.person_confidence(F.lit(False)))
    ranked = people.rank_contacts(scored)
    raw = scored.select("business_id", "name", "raw_confidence")
    return ranked.join(raw, ["business_id", "name"]).select("business_id", "place", "name", F.floor(F.col("raw_confidence") * 200).cast("int").alias("score"), "is_primary")


@query("built_contacts", "W1 W5 J14 J15 A15 A17")
def built_contacts(v):
    merged = people.merge_people(_mentions(v))
    key = F.col("c_custkey").cast("string")
    domains = v.customer.select(F.col("c_custkey").alias("business_id"), F.posexplode(F.array(F.concat(F.lit("b"), key, F.lit(".org")))).alias("domain_no", "domain"))
    found = v.customer.select(F.col("c_custkey").alias("business_id"), F.lit(0).cast("long").alias("pos"), F.concat(F.lit("alee@mail.b"), key, F.lit(".org")).alias("address"),
                              F.lit("website").alias("source"), F.lit("https://s.org/x").alias("url"))
    links = v.customer.select(F.col("c_custkey").alias("business_id"), F.lit(0).cast("long").alias("pos"), F.lit("https://linkedin.com/in/omar-khan-77/").alias("url"))
    return people.build_contacts(merged, people.merge_found_emails(found), links, domains).select(
        "business_id", "place", "name", "email", "email_source", "confidence", "is_primary")


# More people, named by their customer's number, and what their orders' numbers make of those names.
_FAR = 1_000_000_000
_F3, _L3 = "['Ann', 'Omar', 'Mary']", "['Lee', 'Khan', 'Stone']"
_CROWD = f"""SELECT c_custkey + {_FAR} AS id, {_F3}[c_custkey % 3 + 1] AS f, {_L3}[(c_custkey // 3) % 3 + 1] AS l FROM {{customer}}"""
_SAID = f"""SELECT o_custkey + {_FAR} AS business_id, o_orderkey AS pos, o_orderkey % 8 AS k, o_orderkey % 3 AS h, 'b' || o_custkey || '.org' AS site,
 lower({_F3}[(CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey ELSE o_custkey END) % 3 + 1]) AS f,
 lower({_L3}[((CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey ELSE o_custkey END) // 3) % 3 + 1]) AS l FROM {{orders}}"""


def _crowd(v):
    key = F.col("c_custkey")
    one = lambda values, at: F.get(F.array(*[F.lit(x) for x in values]), at.cast("int"))
    return v.customer.select((key + _FAR).alias("person_id"), (key + _FAR).alias("business_id"), one(("Ann", "Omar", "Mary"), key % 3).alias("first_name"),
                             one(("Lee", "Khan", "Stone"), F.floor(key / 3) % 3).alias("last_name"))


def _said(v):
    key = F.col("o_orderkey")
    of = F.when(key % 5 == 0, key).otherwise(F.col("o_custkey"))
    one = lambda values, at: F.get(F.array(*[F.lit(x) for x in values]), at.cast("int"))
    return v.orders.select((F.col("o_custkey") + _FAR).alias("business_id"), key.alias("pos"), (key % 8).alias("k"), (key % 3).alias("h"),
                           F.concat(F.lit("b"), F.col("o_custkey").cast("string"), F.lit(".org")).alias("site"),
                           one(("ann", "omar", "mary"), of % 3).alias("f"), one(("lee", "khan", "stone"), F.floor(of / 3) % 3).alias("l"))


@query("own_emails", "J14", f"""
WITH c AS ({_CROWD}), s AS ({_SAID}),
found AS (SELECT business_id, pos, CASE k WHEN 0 THEN f || '.' || l WHEN 1 THEN f || l WHEN 2 THEN left(f, 1) || l WHEN 3 THEN 'info' WHEN 4 THEN f WHEN 5 THEN l || f WHEN 6 THEN 'zoe' ELSE f || '_' || l END AS local,
  CASE h WHEN 0 THEN site WHEN 1 THEN 'mail.' || site ELSE 'other.org' END AS host FROM s),
g AS (SELECT c.id, x.label, x.no, x.base::double AS base, replace(replace(replace(replace(x.shape, '<first>', lower(f)), '<last>', lower(l)), '<f>', left(lower(f), 1)), '<l>', left(lower(l), 1)) AS local
  FROM c CROSS JOIN (VALUES {_PATTERN_VALUES}) x(no, label, shape, base, needs)),
b AS (SELECT id, local, arg_min(label, no) AS label FROM g GROUP BY 1, 2),
hits AS (SELECT b.id AS person_id, local || '@' || host AS email, label AS pattern, row_number() OVER (PARTITION BY b.id ORDER BY pos) AS n
  FROM b JOIN found USING (local) WHERE found.business_id = b.id AND local <> 'info' AND host <> 'other.org')
SELECT person_id, email, pattern FROM hits WHERE n = 1
UNION ALL SELECT c_custkey AS person_id, CASE c_custkey % 3 WHEN 0 THEN 'alee@b' WHEN 1 THEN 'ann.lee@mail.b' END || c_custkey || '.org' AS email, CASE c_custkey % 3 WHEN 0 THEN 'flast' ELSE 'first.last' END AS pattern
FROM {{customer}} WHERE c_custkey % 3 < 2""")
def own_emails(v):
    key, kind = F.col("c_custkey").cast("string"), F.col("c_custkey") % 3
    crowd = v.customer.select(F.col("c_custkey").alias("person_id"), F.col("c_custkey").alias("business_id"), F.lit("Ann Lee").alias("name"))
    listed = F.array(F.concat(F.lit("info@b"), key, F.lit(".org")), F.lit("ann@gmail.com"),
                     F.concat(F.when(kind == 0, "alee@b").when(kind == 1, "ann.lee@mail.b").otherwise("ann@notb"), key, F.lit(".org")), F.concat(F.lit("zoe@b"), key, F.lit(".org")))
    found = v.customer.select(F.col("c_custkey").alias("business_id"), F.posexplode(listed).alias("first_pos", "address"), F.lit("website").alias("source"))
    domains = v.customer.select(F.col("c_custkey").alias("business_id"), F.concat(F.lit("b"), key, F.lit(".org")).alias("domain"))
    more, said, k = _crowd(v), _said(v), F.col("k")
    local = (F.when(k == 0, F.concat("f", F.lit("."), "l")).when(k == 1, F.concat("f", "l")).when(k == 2, F.concat(F.left("f", F.lit(1)), "l")).when(k == 3, "info").when(k == 4, F.col("f"))
             .when(k == 5, F.concat("l", "f")).when(k == 6, "zoe").otherwise(F.concat("f", F.lit("_"), "l")))
    host = F.when(F.col("h") == 0, F.col("site")).when(F.col("h") == 1, F.concat(F.lit("mail."), "site")).otherwise("other.org")
    crowd = crowd.unionByName(more.select("person_id", "business_id", F.concat_ws(" ", "first_name", "last_name").alias("name")))
    found = found.unionByName(said.select("business_id", F.col("pos").alias("first_pos"), F.concat(local, F.lit("@"), host).alias("address"), F.lit("website").alias("source")))
    domains = domains.unionByName(domains.select((F.col("business_id") + _FAR).alias("business_id"), "domain"))
    return people.own_emails(crowd, found, domains).drop("source")


@query("profile_links", "J15", f"""
WITH c AS ({_CROWD}), s AS ({_SAID}),
links AS (SELECT business_id, pos, CASE k WHEN 0 THEN f || '-' || l WHEN 1 THEN l || f WHEN 2 THEN l WHEN 3 THEN 'dr-' || f || '-' || l || '-' || pos WHEN 4 THEN f ELSE 'team-' || pos END AS slug FROM s WHERE h < 2),
hits AS (SELECT c.id AS person_id, 'https://www.linkedin.com/in/' || slug AS profile, row_number() OVER (PARTITION BY c.id ORDER BY pos) AS n
  FROM c JOIN links ON links.business_id = c.id WHERE contains(replace(slug, '-', ''), lower(f)) AND contains(replace(slug, '-', ''), lower(l)))
SELECT person_id, profile FROM hits WHERE n = 1
UNION ALL SELECT c_custkey AS person_id, 'https://www.linkedin.com/in/' || CASE c_custkey % 2 WHEN 0 THEN 'dr-ann-lee' ELSE 'leeann' END || c_custkey AS profile FROM {{customer}} WHERE c_custkey % 5 <> 0""")
def profile_links(v):
    key = F.col("c_custkey")
    crowd = v.customer.select(key.alias("person_id"), key.alias("business_id"), F.lit("Ann").alias("first_name"), F.when(key % 5 != 0, "Lee").alias("last_name"))
    slug = F.when(key % 2 == 0, "dr-ann-lee").otherwise("leeann")
    links = F.array(F.lit("https://www.linkedin.com/in/ann-smith"), F.concat(F.lit("https://pk.linkedin.com/in/"), slug, key.cast("string"), F.lit("?x=1")),
                    F.lit("https://www.linkedin.com/in/ann-lee-late"), F.lit("https://x.org/ann-lee"))
    given = v.customer.select(key.alias("business_id"), F.posexplode(links).alias("pos", "url"))
    said, k = _said(v), F.col("k")
    slug = (F.when(k == 0, F.concat("f", F.lit("-"), "l")).when(k == 1, F.concat("l", "f")).when(k == 2, F.col("l")).when(k == 3, F.concat(F.lit("dr-"), "f", F.lit("-"), "l", F.lit("-"), F.col("pos").cast("string")))
            .when(k == 4, F.col("f")).otherwise(F.concat(F.lit("team-"), F.col("pos").cast("string"))))
    more = said.select("business_id", "pos", F.concat(F.when(F.col("h") < 2, "https://www.linkedin.com/in/").otherwise("https://x.org/in/"), slug).alias("url"))
    crowd = crowd.unionByName(_crowd(v).select(crowd.columns))
    return people.profile_links(crowd, given.unionByName(more))


_STAFF = f"""SELECT o_custkey + {_FAR} AS business_id, o_orderkey AS pos, 'p' || o_orderkey || '@b.org' AS email, o_orderkey % 11 = 0 AS generic,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE ['Owner', 'Office Manager', 'Receptionist', NULL, NULL, 'Dentist', NULL][o_orderkey % 7 + 1] END AS position,
 ['executive', 'senior', 'junior'][(o_orderkey // 7) % 3 + 1] AS seniority, cast((o_custkey * 7 + o_orderkey) % 1000 / 1000 AS decimal(4, 3)) AS confidence FROM {{orders}} WHERE o_orderkey % 13 < 5"""


@query("ranked_domain_people", "W2 A20 S4", f"""
WITH p AS ({_STAFF}),
r AS (SELECT *, CASE position WHEN 'Owner' THEN 0 WHEN 'Office Manager' THEN 3 WHEN 'Dentist' THEN 50 ELSE CASE WHEN generic THEN 200 ELSE 100 + CASE seniority WHEN 'executive' THEN 0 WHEN 'senior' THEN 1 ELSE 2 END END END AS rank
  FROM p WHERE position IS DISTINCT FROM 'Receptionist'),
u AS (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY rank, confidence DESC, pos) AS place FROM r
  WHERE NOT generic OR business_id NOT IN (SELECT business_id FROM r WHERE NOT generic))
SELECT business_id, place, email, coalesce(position, CASE WHEN generic THEN 'General address' END) AS job_title, place = 1 AS is_primary FROM u WHERE place <= 4
UNION ALL SELECT c_custkey AS business_id, v.place, v.local || '@b' || c_custkey || '.org' AS email, v.title AS job_title, v.place = 1 AS is_primary
FROM {{customer}} JOIN (VALUES (0, 1, 'own', 'Owner'), (0, 2, 'mgr', 'Office Manager'), (0, 3, 'exec', NULL), (0, 4, 'sen', NULL), (1, 1, 'info', 'General address')) v(k, place, local, title) ON v.k = c_custkey % 2""")
def ranked_domain_people(v):
    key, some = F.col("c_custkey").cast("string"), F.col("c_custkey") % 2 == 0
    one = lambda local, first, position, seniority, confidence: F.struct(
        F.concat(F.lit(local + "@b"), key, F.lit(".org")).alias("email"), F.lit(first).cast("string").alias("name"), F.lit(position).cast("string").alias("position"),
        F.lit(seniority).cast("string").alias("seniority"), F.lit(first is None).alias("generic"), F.lit(confidence).cast("decimal(4,3)").alias("confidence"))
    everyone = F.array(one("info", None, None, None, 0.99), one("rec", "Rec", "Receptionist", None, 0.9), one("jun", "Jun", None, "junior", 0.9), one("sen", "Sen", None, "senior", 0.5),
                       one("exec", "Exe", None, "executive", 0.1), one("mgr", "Mgr", "Office Manager", None, 0.2), one("own", "Own", "Owner", None, 0.1))
    nobody = F.array(one("info", None, None, None, 0.99), one("rec", "Rec", "Receptionist", None, 0.9))
    rows = v.customer.select(F.col("c_custkey").alias("business_id"), F.posexplode(F.when(some, everyone).otherwise(nobody)).alias("pos", "p")).select("business_id", "pos", "p.*")
    key = F.col("o_orderkey")
    title = F.when(key % 11 != 0, F.get(F.array(*[F.lit(x).cast("string") for x in ("Owner", "Office Manager", "Receptionist", None, None, "Dentist", None)]), (key % 7).cast("int")))
    staff = v.orders.where(key % 13 < 5).select(
        (F.col("o_custkey") + _FAR).alias("business_id"), key.cast("int").alias("pos"), F.concat(F.lit("p"), key.cast("string"), F.lit("@b.org")).alias("email"),
        F.lit(None).cast("string").alias("name"), title.alias("position"), F.get(F.array(F.lit("executive"), F.lit("senior"), F.lit("junior")), (F.floor(key / 7) % 3).cast("int")).alias("seniority"),
        (key % 11 == 0).alias("generic"), ((F.col("o_custkey") * 7 + key) % 1000 / 1000).cast("decimal(4,3)").alias("confidence"))
    return people.rank_domain_people(rows.unionByName(staff)).select("business_id", "place", "email", "job_title", "is_primary")


@query("business_domains", "X4 J10", """
SELECT c_custkey AS business_id, d.no AS domain_no, d.name AS domain FROM {customer}, LATERAL (SELECT * FROM (VALUES
 (0, CASE c_custkey % 3 WHEN 0 THEN 'b' || c_custkey || '.org' WHEN 1 THEN 'site' || c_custkey || '.org' ELSE 'shop.b' || c_custkey || '.org' END),
 (1, CASE c_custkey % 3 WHEN 0 THEN 'site' || c_custkey || '.org' WHEN 1 THEN 'shop.b' || c_custkey || '.org' END)) v(no, name)) d WHERE d.name IS NOT NULL""")
def business_domains(v):
    kind, key = F.col("c_custkey") % 3, F.col("c_custkey").cast("string")
    businesses = v.customer.select(
        F.col("c_custkey").alias("id"), F.when(kind == 0, F.concat(F.lit("www.B"), key, F.lit(".org"))).when(kind == 1, "gmail.com").alias("domain"),
        F.when(kind < 2, F.concat(F.lit("https://site"), key, F.lit(".org/x"))).alias("website_url"),
        F.array(F.concat(F.lit("https://shop.b"), key, F.lit(".org/a")), F.concat(F.lit("http://www.shop.b"), key, F.lit(".org/b"))).alias("scraped_urls"))
    return people.business_domains(businesses)


@query("evidence_waterfall", "U2", """
WITH e AS (SELECT o_custkey AS business_id, o_orderkey AS id, o_orderkey % 3 AS tier, CASE WHEN o_orderkey % 5 = 0 THEN 'target' ELSE 'fallback' END AS kind FROM {orders}),
s AS (SELECT business_id, min(tier) AS stop FROM e WHERE kind = 'target' GROUP BY 1)
SELECT e.* FROM e LEFT JOIN s USING (business_id) WHERE stop IS NULL OR tier <= stop""")
def evidence_waterfall(v):
    key = F.col("o_orderkey")
    return people.waterfall(v.orders.select(F.col("o_custkey").alias("business_id"), key.alias("id"), (key % 3).alias("tier"),
                                            F.when(key % 5 == 0, "target").otherwise("fallback").alias("kind")))


@query("business_mentions", "J13 X13 X20", f"""
WITH x AS ({_WORDED}), d AS (SELECT x.*, text, n.f AS nf, n.l AS nl, (x.id + 1) % 3 AS k FROM x JOIN {{documents}} ON doc_id = x.id - 1000000000 LEFT JOIN x AS n ON n.id = x.id + 1),
t AS (SELECT id, CASE k WHEN 0 THEN f ELSE coalesce(nf, f) END AS a, CASE k WHEN 2 THEN coalesce(nl, l) ELSE l END AS b, lower(regexp_replace(strip_accents(text), '[^A-Za-z0-9]', '', 'g')) AS hay,
  regexp_replace(text, '[^0-9]', '', 'g') AS digits, right('92300' || lpad(cast(id AS varchar), 12, '0'), 9) AS phone FROM d)
SELECT id, contains(digits, phone) OR CASE WHEN lower(a) = lower(b) THEN contains(hay, lower(a)) ELSE contains(hay, lower(a)) AND contains(hay, lower(b)) END AS mentioned FROM t
UNION ALL SELECT id, CASE k WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN true ELSE false END AS mentioned FROM (SELECT c_custkey AS id, c_custkey % 5 AS k FROM {{customer}}) x""")
def business_mentions(v):
    kind, key = F.col("c_custkey") % 5, F.col("c_custkey").cast("string")
    rows = v.customer.select(
        F.col("c_custkey").alias("id"), F.when(kind < 2, F.concat(F.lit("Alvi Bright"), key, F.lit(" Dental Clinic"))).otherwise("Smile Dental").alias("name"),
        F.when(kind == 0, F.concat(F.lit("visit alvi BRIGHT"), key, F.lit(" today"))).when(kind == 1, "visit alvi today").when(kind == 2, "Smile  Dental in LAHORE")
        .when(kind == 3, F.concat(F.lit("call 0300-"), F.lpad(key, 7, "0"))).otherwise("Smile Dental of Karachi").alias("text"),
        F.concat(F.lit("+92300"), F.lpad(key, 7, "0")).alias("phone"))
    context = places.context_tokens(F.lit("Lahore"), F.array(F.lit("smile-dental.pk")))
    # every document against a business of its own first words, or of the next document's
    worded = _worded(v)
    following = worded.select((F.col("id") - 1).alias("id"), F.col("f").alias("nf"), F.col("l").alias("nl"))
    kind = (F.col("id") + 1) % 3
    a, b = F.when(kind == 0, F.col("f")).otherwise(F.coalesce("nf", "f")), F.when(kind == 2, F.coalesce("nl", "l")).otherwise(F.col("l"))
    more = worded.join(following, "id", "left").select("id", F.concat(a, F.lit(" "), b, F.lit(" Clinic")).alias("name"), "text", F.concat(F.lit("+92300"), F.lpad(F.col("id").cast("string"), 12, "0")).alias("phone"))
    rows = rows.select("id", "name", "text", "phone").unionByName(more)
    return rows.select("id", places.mentions_business(F.col("text"), F.col("name"), context, places.phone_key(F.col("phone"))).alias("mentioned"))
