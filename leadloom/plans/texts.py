"""Page, document and research-answer queries."""

from pyspark.sql import functions as F

from leadloom.functions import templates, text, urls
from leadloom.plans.registry import query
from leadloom.scale import dealt_out
from leadloom.schemas import user_fields_schema
from leadloom.sources import pages

_HOST = "regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), '^www\\.', '')"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_QUERY = """coalesce(array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'),
  lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_'))), '&'), '')"""
_NORMAL = f"""regexp_extract(url, '^([a-z]+)://', 1) || '://' || {_HOST} || CASE WHEN {_PATH} IN ('', '/') THEN '/' ELSE rtrim({_PATH}, '/') END
 || CASE WHEN {_QUERY} <> '' THEN '?' || {_QUERY} ELSE '' END"""


@query("normalized_urls", "X5 X6 X7", f"""
SELECT page_id, {_NORMAL} AS normalized, {_HOST} AS host, concat_ws(' ', {_HOST}, CASE WHEN {_PATH} IN ('', '/') THEN '/' ELSE rtrim({_PATH}, '/') END, {_QUERY}) AS identity,
 {_HOST} = 'example.com' OR {_HOST} LIKE '%.example.com' AS same_site, true AS public FROM {{pages}}""")
def normalized_urls(v):
    rows = v.pages.select("page_id", "url", urls.normalize_url_idna(F.col("url")).alias("normalized"))
    return rows.select("page_id", "normalized", urls.hostname(F.col("normalized")).alias("host"), urls.url_identity(F.col("normalized")).alias("identity"),
                       urls.is_same_site(F.col("normalized"), F.lit("example.com")).alias("same_site"), urls.is_public_url(F.col("url")).alias("public"))


_LINK = f"""SELECT page_id, url, i - 1 AS pos, regexp_extract(url, '^([a-z]+)://', 1) || '://' || {_HOST} || CASE WHEN hrefs[i] = '/' THEN '/' ELSE rtrim(hrefs[i], '/') END AS link
 FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="(/[^"]*)"', 1) AS hrefs FROM {{pages}}) x"""
_LINKS = f"{_LINK}, range(1, 101) r(i) WHERE i <= len(hrefs)"  # a page's first hundred, as research remembers them


@query("page_links", "X17 J19 O5", f"""
SELECT page_id, min(pos) AS pos, link AS url FROM ({_LINK}, unnest(range(1, len(hrefs) + 1)) r(i)) l GROUP BY page_id, link""")
def page_links(v):
    return pages.extract_pages(v.pages).select("page_id", F.explode("links").alias("l")).select("page_id", "l.url", "l.pos")


@query("unvisited_links", "J19 U5", f"""
WITH f AS (SELECT page_id % 20 AS business_id, page_id * 100 + pos AS pos, link AS url FROM ({_LINKS}) l),
d AS (SELECT business_id, regexp_replace(url, '^[a-z]+://', '') AS identity, arg_min(url, pos) AS url, min(pos) AS pos FROM f GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY pos) AS r FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY pos) AS offered_rank FROM k WHERE r <= 200 AND NOT EXISTS (
   SELECT 1 FROM f WHERE f.business_id = k.business_id AND regexp_replace(f.url, '^[a-z]+://', '') = k.identity AND f.pos % 100 = 0))
SELECT business_id, url, pos, offered_rank FROM o WHERE offered_rank <= 50""")
def unvisited_links(v):
    links = pages.extract_pages(v.pages, most_links=pages.MAX_PAGE_LINKS).select("page_id", F.explode("links").alias("l")).select(
        (F.col("page_id") % 20).alias("business_id"), (F.col("page_id") * 100 + F.col("l.pos")).alias("pos"), "l.url")
    return pages.unvisited_links(links, links.where(F.col("pos") % 100 == 0).select("business_id", "url"))


@query("page_emails", "X16 X17 U4", r"""
SELECT page_id, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace(html, '<head>.*</head>', '', 's'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g')),
  '\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b'))), ','), '') AS emails FROM {pages}""")
def page_emails(v):
    return pages.extract_pages(v.pages).select("page_id", F.array_join("emails", ",").alias("emails"))


@query("page_content", "X17")
def page_content(v):
    return pages.extract_pages(v.pages).select("page_id", "page_url", "content", F.size("links").alias("links"))


@query("document_emails", "X16", r"""
SELECT doc_id, email FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b'))) AS email FROM {documents}) x""")
def document_emails(v):
    return v.documents.select("doc_id", F.explode(urls.extract_emails(F.col("text"))).alias("email"))


@query("document_email_kinds", "X19 X16", r"""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Info@' WHEN 1 THEN 'front-desk@' WHEN 2 THEN split_part(email, '@', 1) || '@' ELSE 'no.reply@' END || split_part(email, '@', 2) AS email,
 doc_id % 4 <> 2 AS role_based
FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b'))) AS email FROM {documents}) x""")
def document_email_kinds(v):
    """Addresses of the documents, three in four moved to a role of their domain."""
    found = v.documents.select("doc_id", F.explode(urls.extract_emails(F.col("text"))).alias("email"))
    kind, domain = F.col("doc_id") % 4, F.substring_index("email", "@", -1)
    address = F.when(kind == 2, F.col("email")).otherwise(F.concat(F.when(kind == 0, "Info@").when(kind == 1, "front-desk@").otherwise("no.reply@"), domain))
    return found.select("doc_id", address.alias("email")).withColumn("role_based", urls.is_role_based(F.col("email")))


@query("normalized_texts", "X1", r"""
SELECT doc_id, nullif(trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')), '') AS text FROM {documents}""")
def normalized_texts(v):
    return v.documents.select("doc_id", text.normalize_text(F.col("text")).alias("text"))


@query("ascii_texts", "X13", """
SELECT doc_id, regexp_replace(lower(strip_accents(text)), '[^a-z0-9]', '', 'g') AS token FROM {documents}""")
def ascii_texts(v):
    return v.documents.select("doc_id", text.ascii_token(F.col("text")).alias("token"))


@query("cleaned_markdown", "X18", r"""
SELECT doc_id, 'see the site ' || doc_id || ', here' || chr(10) || 'Bold title' || chr(10) || 'x y' || chr(10) ||
 array_to_string(list_transform(string_split_regex(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(text, '!\[[^\]]*\]\([^)]*\)', ' ', 'g'),
  '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), 'https?://[^\s]+', ' ', 'g'), '|', ', '), '[#*_`>]+', ' ', 'g'), '\r\n|[\n\r]'),
  lambda line: trim(regexp_replace(line, '\s+', ' ', 'g'))), chr(10)) AS text FROM {documents}""")
def cleaned_markdown(v):
    key = F.col("doc_id").cast("string")
    raw = F.concat(F.lit("![logo](a.png) see [the site "), key, F.lit("](https://x.org/a)|here https://y.org/z?q=1 \n## **Bold**   title\n> `x`  y \n"), F.col("text"))
    return v.documents.select("doc_id", text.clean_markdown(raw).alias("text"))


@query("public_urls", "F27", r"""
WITH o AS (SELECT o_orderkey + 1000000000 AS id, CASE o_orderstatus WHEN 'F' THEN 'http' WHEN 'O' THEN 'https' ELSE 'ftp' END AS scheme, [0, 10, 100, 127, 169, 172, 192, 198, 203, 224, 8, 255, 300][o_orderkey % 13 + 1] AS a,
  o_custkey % 260 AS b, (o_orderkey // 13) % 260 AS c, o_orderkey * 7 % 260 AS d FROM {orders})
SELECT id, scheme <> 'ftp' AND greatest(a, b, c, d) <= 255 AND NOT (a IN (0, 10, 127) OR a >= 224 OR a = 100 AND b BETWEEN 64 AND 127 OR a = 169 AND b = 254 OR a = 172 AND b BETWEEN 16 AND 31
  OR a = 192 AND (b = 168 OR b = 0 AND c IN (0, 2)) OR a = 198 AND (b IN (18, 19) OR b = 51 AND c = 100) OR a = 203 AND b = 0 AND c = 113) AS public FROM o
UNION ALL SELECT page_id + 2000000000, starts_with(url, 'http') AND NOT regexp_matches(url, '^[a-z]+://(localhost|[^/]*\.local)([:/]|$)') FROM {pages}
UNION ALL SELECT c_custkey AS id, CASE c_custkey % 9 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN false WHEN 4 THEN true WHEN 5 THEN false WHEN 6 THEN false WHEN 7 THEN false ELSE true END AS public FROM {customer}""")
def public_urls(v):
    kind, key = F.col("c_custkey") % 9, F.col("c_custkey").cast("string")
    url = (F.when(kind == 0, F.concat(F.lit("https://b"), key, F.lit(".org/x"))).when(kind == 1, "http://localhost:8000/").when(kind == 2, "http://db.local/x")
           .when(kind == 3, "http://192.168.1.7/").when(kind == 4, "http://93.184.216.34/").when(kind == 5, F.concat(F.lit("ftp://b"), key, F.lit(".org")))
           .when(kind == 6, "http://[::1]/").when(kind == 7, "http://169.254.169.254/latest").otherwise("http://172.15.0.1/"))
    order = F.col("o_orderkey")
    first = F.get(F.array(*[F.lit(x) for x in (0, 10, 100, 127, 169, 172, 192, 198, 203, 224, 8, 255, 300)]), (order % 13).cast("int"))
    scheme = F.when(F.col("o_orderstatus") == "F", "http").when(F.col("o_orderstatus") == "O", "https").otherwise("ftp")
    host = F.concat_ws(".", first, F.col("o_custkey") % 260, F.floor(order / 13) % 260, order * 7 % 260)
    given = v.customer.select(F.col("c_custkey").alias("id"), url.alias("url")).unionByName(
        v.orders.select((order + 1_000_000_000).alias("id"), F.concat(scheme, F.lit("://"), host, F.lit("/x")).alias("url"))).unionByName(
        v.pages.select((F.col("page_id") + 2_000_000_000).alias("id"), "url"))
    return given.select("id", urls.is_public_url(F.col("url")).alias("public"))


@query("website_findings", "F24 W16 X31", r"""
WITH RECURSIVE s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM {documents}),
t AS (SELECT doc_id, i, nullif(trim(regexp_replace(parts[i], '[\s\p{Z}\x0B\x1C-\x1F\x{85}]+', ' ', 'g')), '') AS text FROM s, unnest(range(1, len(parts) + 1)) u(i)),
w AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, text, words FROM (
 SELECT *, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS words FROM t
 WHERE text IS NOT NULL AND NOT regexp_matches(text, '@|\+?\d[\d\s().-]{7,}\d') AND NOT regexp_matches(text, '(?i)current page|this page|blank|unvisited|same-site|five-page|page limit|cleaned|scrap|likely|next page|remaining|usable|no visible|no links|did not provide|evidence|qualif|navigation')) x
 WHERE len(words) > 0),
f AS (
  SELECT doc_id, 0::bigint AS n, []::varchar[] AS kept, []::varchar[][] AS known FROM {documents}
  UNION ALL
  SELECT doc_id, n, CASE WHEN repeats THEN kept ELSE list_append(kept, text[1:300]) END, CASE WHEN repeats THEN known ELSE list_append(known, words) END
  FROM (SELECT f.doc_id, w.n, f.kept, f.known, w.text, w.words,
     coalesce(list_bool_or(list_transform(f.known, lambda k: len(list_intersect(k, w.words)) >= 0.8 * least(len(k), len(w.words)))), false) AS repeats
   FROM f JOIN w ON w.doc_id = f.doc_id AND w.n = f.n + 1 WHERE len(f.kept) < 12) y)
SELECT doc_id, array_to_string(arg_max(kept, n), '|') AS findings FROM f GROUP BY doc_id""")
def website_findings(v):
    sentences = F.split("text", r"(?<=[.!?])\s+")
    return v.documents.select("doc_id", F.array_join(pages.website_findings(sentences), "|").alias("findings"))


def _profiles(v):
    """Stored research: each conversation's turns as the pages of one business."""
    action = F.when(F.col("turn") % 4 == 0, "SCRAPE").when(F.col("turn") % 4 == 1, None).otherwise("SCORE")
    page = F.struct(
        "turn", F.concat(F.lit("https://b"), F.col("conv_id").cast("string"), F.lit(".org/p"), F.col("turn").cast("string")).alias("url"), F.col("text").alias("content"),
        F.array(F.struct(F.concat(F.lit("https://b.org/"), F.col("turn").cast("string")).alias("url"), F.col("role").alias("text"), F.lit(True).alias("same_site"))).alias("links"),
        F.array(F.concat("role", F.lit("@b.org"))).alias("emails"), F.col("role").alias("summary"), F.array("role", F.lit("fact")).alias("relevant_findings"),
        action.alias("agent_action"), F.when(F.col("turn") % 4 == 0, "https://b.org/next").alias("requested_next_url"))
    ordered = F.array_sort(F.collect_list(page))
    return v.conversations.groupBy(F.col("conv_id").alias("business_id")).agg(ordered.alias("scraped_pages")).withColumn(
        "status", F.when(F.col("business_id") % 3 == 0, "completed").otherwise("running"))


@query("stored_findings", "S8", """
SELECT business_id, page_no, i AS pos, CASE i WHEN 0 THEN role ELSE 'fact' END AS item FROM (
 SELECT conv_id AS business_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS page_no FROM {conversations}) x, range(0, 2) r(i)""")
def stored_findings(v):
    return pages.explode_pages(_profiles(v), "relevant_findings").drop("page_url")


@query("resume_research", "M15", """
SELECT conv_id AS business_id, count(*) AS pages, CASE max(turn) % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'decide' ELSE 'restart' END AS next,
 CASE max(turn) % 4 WHEN 0 THEN 'https://b.org/next' END AS next_url FROM {conversations} WHERE conv_id % 3 <> 0 GROUP BY conv_id""")
def resume_research(v):
    return pages.resume_research(_profiles(v))


@query("validated_decisions", "F26", """
SELECT page_id, CASE page_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 'SCORE requires score, reasons, and reasoning; set url and reason to null.' WHEN 2 THEN NULL
 WHEN 3 THEN 'EXIT requires reason and null URL/scoring fields.' WHEN 4 THEN NULL WHEN 5 THEN 'This URL has already been scraped. Choose another URL or produce SCORE/EXIT.'
 WHEN 6 THEN 'Choose an unvisited same-site URL from available_links or return SCORE/EXIT.' WHEN 7 THEN 'SCRAPE requires a valid URL from the current website.'
 ELSE 'The five-page limit is reached; return SCORE now.' END AS problem FROM {pages}""")
def validated_decisions(v):
    kind, nothing = F.col("page_id") % 9, F.lit(None).cast("string")
    links = F.array(*[F.struct(urls.normalize_url(F.lit(p), F.col("page_url")).alias("url"), F.lit(s).alias("same_site")) for p, s in (("/a?utm_x=1", True), ("/b", False), ("/c", True))])
    log = v.pages.select("page_id", urls.normalize_url_idna(F.col("url")).alias("page_url")).select(
        "page_id", "page_url", F.when(kind < 2, "SCORE").when(kind < 4, "EXIT").otherwise("SCRAPE").alias("action"),
        F.when(kind.isin(4, 8), "/a#top").when(kind == 5, "/c/").when(kind == 6, "/b").when(kind == 7, "mailto:x@y.org").otherwise(nothing).alias("url"),
        F.when(kind == 0, 70).alias("score"), F.when(kind < 2, F.array(F.lit("fits"))).alias("reasons"), F.when(kind < 2, "ok").alias("reasoning"),
        F.when(kind == 2, "no site").when(kind == 3, "  ").alias("reason"), links.alias("links"),
        F.array(urls.url_identity(urls.normalize_url(F.lit("/c"), F.col("page_url")))).alias("visited"))
    return pages.validate_decisions(log, kind == 8).select("page_id", "problem")


FIELDS = [{"name": "team_size", "type": "integer", "description": "Staff"}, {"name": "languages", "type": "text list", "description": "Languages"},
          {"name": "tool", "type": "text", "description": "Tool"}, {"name": "open", "type": "yes/no", "description": "Open"},
          {"name": "codes", "type": "integer list", "description": "Codes"}]


@query("extracted_fields", "X30 U7", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 END AS team_size, CASE WHEN o_orderkey % 3 <> 0 THEN 'English,Urdu ' || (o_orderkey % 7) END AS languages,
 CASE WHEN o_orderkey % 4 <> 0 THEN 'Acme Tool' END AS tool, CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END AS open, '3, 1' AS codes FROM {orders}""")
def extracted_fields(v):
    key = F.col("o_orderkey")
    answer = F.to_json(F.struct(
        F.when(key % 5 == 0, -1).otherwise(key % 5).alias("team_size"),
        F.when(key % 3 == 0, F.array(F.lit(" "), F.lit(""))).otherwise(F.array(F.lit(" English"), F.lit("ENGLISH "), F.lit(""), F.concat(F.lit("Urdu   "), (key % 7).cast("string")))).alias("languages"),
        F.when(key % 4 == 0, "  ").otherwise(" Acme \n Tool").alias("tool"), (key % 2 == 0).alias("open"), F.array(F.lit(3), F.lit(1), F.lit(3)).alias("codes")))
    rows = v.orders.select(key.alias("id"), F.from_json(answer, user_fields_schema(FIELDS)).alias("x"))
    clean = {f["name"]: templates.extracted_value(F.col(f"x.{f['name']}"), f["type"]) for f in FIELDS}
    rows = rows.select("id", F.struct(*[c.alias(n) for n, c in clean.items()]).alias("x"))
    size, languages = pages.known_columns("x")
    return rows.select("id", size, F.array_join(languages, ",").alias("languages"), F.col("x.tool").alias("tool"),
                       templates.shown(F.col("x.open"), "yes/no").alias("open"), templates.shown(F.col("x.codes"), "integer list").alias("codes"))


@query("site_page_targets", "J21 W15 S8", """
WITH l AS (SELECT id AS business_id, 'https://biz' || id || '.example.org' AS o FROM {v_businesses} WHERE coalesce(website_url, '') <> ''),
t AS (SELECT business_id, o, p.path, p.tier FROM l, (VALUES ('/', -1), ('/meet-the-team', 0), ('/our-doctors', 1), ('/About-Us', 7), ('/about', 100), ('/team', 102), ('/our-team', 103),
  ('/meet-the-doctors', 104), ('/meet-our-team', 105), ('/doctors', 107), ('/leadership', 108), ('/staff', 109), ('/contact', 110), ('/contact-us', 111)) p(path, tier)
  WHERE NOT (business_id % 2 = 0 AND p.path = '/meet-the-team'))
SELECT business_id, o || path AS url, rank FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY tier) AS rank FROM t) x WHERE rank <= 6""")
def site_page_targets(v):
    sites = dealt_out(v.v_businesses.select(F.col("id").alias("business_id"), "website_url"), "business_id")
    link = F.array(*[F.concat("website_url", F.lit(p)) for p in ("/blog", "/About-Us", "/our-doctors", "/meet-the-team")], F.lit("https://other.org/team"))
    links = sites.where(F.coalesce("website_url", F.lit("")) != "").select("business_id", F.posexplode(link).alias("pos", "url")).withColumn("pos", F.col("pos").cast("long"))
    read = links.where((F.col("pos") == 3) & (F.col("business_id") % 2 == 0)).select("business_id", "url", F.lit(400).alias("chars"))
    return pages.site_page_targets(sites, links, read, 6).select("business_id", "url", "rank")
