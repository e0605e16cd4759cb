"""Web pages: links, text and e-mail addresses from HTML, and stored page arrays as rows."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.functions import urls
from leadloom.functions.text import fields, let, squeeze
from leadloom.scale import dealt_out, not_broadcast, top_k
from leadloom.session import small_batches

# Parts of a page that are not its content, and texts nobody sees.
CHROME = ("script", "style", "noscript", "svg", "nav", "header", "footer", "aside", "form")
UNSEEN = ("script", "style", "template", "head")
MAX_PAGE_LINKS, MAX_KNOWN_LINKS, MAX_OFFERED_LINKS, MAX_PAGES = 100, 200, 50, 5
_TEXT = T.StringType()
PARSED = T.StructType([
    T.StructField("links", T.ArrayType(T.StructType([T.StructField("href", _TEXT), T.StructField("text", _TEXT)]))),
    T.StructField("seen", _TEXT), T.StructField("content", _TEXT)])


class _Page(HTMLParser):
    """Collects anchors, the visible text and the text outside navigation and other chrome."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links, self.seen, self.content, self.inside = [], [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in CHROME or tag in UNSEEN:
            self.inside.append(tag)
        elif tag == "a":
            href = dict(attrs).get("href")
            if href is not None:
                self.links.append({"href": href, "text": []})
                self.inside.append("a")

    def handle_endtag(self, tag):
        if tag in self.inside:
            while self.inside.pop() != tag:
                pass

    def handle_data(self, data):
        data = data.strip()
        if not data or any(tag in UNSEEN for tag in self.inside):
            return
        self.seen.append(data)
        if "a" in self.inside and self.links:
            self.links[-1]["text"].append(data)
        if not any(tag in CHROME for tag in self.inside):
            self.content.append(data)


@F.pandas_udf(PARSED)
def _parse(pages: pd.Series) -> pd.DataFrame:
    rows = []
    for html in pages:
        page = _Page()
        if html:
            page.feed(html)
            page.close()
        links = [{"href": link["href"], "text": " ".join(link["text"])} for link in page.links]
        rows.append((links, " ".join(page.seen), "\n".join(page.content)))
    return pd.DataFrame(rows, columns=["links", "seen", "content"])


def extract_pages(pages: DataFrame, keep_chars: int | None = None, most_links: int | None = None) -> DataFrame:
    """Pages (page_id, url, html) with their links (absolute, each once, with the anchor's position), e-mail
    addresses and main text.

    The whole page is read; ``keep_chars`` cuts the stored text to a limit, as a page store may want, and ``most_links``
    its links to the first so many.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(*[c for c in pages.columns if c != "html"], urls.normalize_url_idna(F.col("url")).alias("page_url"),
                        _parse("html").alias("p"))
    rows = rows.select("*", urls.url_parts(F.col("page_url")).alias("base"), F.regexp_replace(urls.hostname(F.col("page_url")), r"^www\.", "").alias("home"))

    def link(a: Column, i: Column) -> Column:
        return let(urls.normalized(a["href"], F.col("base")), lambda n: fields(
            url=n["url"], text=F.coalesce(squeeze(a["text"]), F.lit("")), identity=n["identity"], pos=i,
            same_site=(F.col("home") != "") & F.endswith(F.concat(F.lit("."), n["host"]), F.concat(F.lit("."), F.col("home")))))

    def distinct(found: Column) -> Column:
        """The first of each identity: sorted by identity and place, as a page may have any number of links."""
        places = F.array_sort(F.transform(found, lambda a, i: fields(identity=a["identity"], i=i)))
        firsts = let(places, lambda s: F.filter(s, lambda x, j: x["identity"].isNotNull() & ((j == 0) | (F.get(s, j - 1)["identity"].isNull())
                                                                                             | (F.get(s, j - 1)["identity"] != x["identity"]))))
        return F.transform(F.array_sort(F.transform(firsts, lambda x: x["i"])), lambda i: F.get(found, i))

    usable = F.filter(F.transform("p.links", link), lambda a: a["url"].isNotNull())
    first = let(usable, distinct)
    links = first if most_links is None else F.slice(first, 1, most_links)
    mailto = F.filter(F.transform("p.links", lambda a: urls.mailto_address(a["href"])), lambda x: x.isNotNull())
    emails = F.array_sort(F.array_distinct(F.concat(urls.extract_emails(F.col("p.seen")), F.flatten(F.transform(mailto, lambda m: urls.extract_emails(m))),
                                                     urls.extract_emails(F.col("p.content")))))
    content = F.col("p.content") if keep_chars is None else F.left("p.content", F.lit(keep_chars))
    return rows.select(*[c for c in pages.columns if c != "html"], "page_url", content.alias("content"),
                       F.transform(links, lambda a: a.dropFields("identity")).alias("links"), emails.alias("emails"))


def explode_pages(profiles: DataFrame, part: str) -> DataFrame:
    """One row per stored page, or per link, finding or e-mail address of a page (part: page, links,
    relevant_findings, emails)."""
    pages = profiles.select("business_id", F.posexplode("scraped_pages").alias("page_no", "page"))
    if part == "page":
        return pages.select("business_id", "page_no", "page.url", "page.content", "page.summary")
    return pages.select("business_id", "page_no", F.col("page.url").alias("page_url"), F.posexplode(F.col(f"page.{part}")).alias("pos", "item"))


def unvisited_links(links: DataFrame, visited: DataFrame, known: int = MAX_KNOWN_LINKS, offered: int = MAX_OFFERED_LINKS) -> DataFrame:
    """Same-site links found (business_id, pos, url) in order of discovery, each once, minus pages
    already visited (business_id, url): the first ``known`` are remembered, ``offered`` of them offered."""
    keyed = links.withColumn("identity", urls.url_identity(F.col("url")))
    first = keyed.groupBy("business_id", "identity").agg(F.min("pos").alias("pos"), F.min_by("url", "pos").alias("url"))
    remembered = top_k(first, ["business_id"], [F.col("pos")], known, "known_rank")
    seen = visited.select("business_id", urls.url_identity(F.col("url")).alias("identity"))
    left = remembered.join(seen, ["business_id", "identity"], "left_anti")
    return top_k(left, ["business_id"], [F.col("pos")], offered, "offered_rank").select("business_id", "url", "pos", "offered_rank")


# Page keywords in priority order, and paths worth trying on any site.
SITE_PAGE_KEYWORDS = ("team", "doctor", "dentist", "staff", "meet", "leadership", "people", "about", "who-we-are",
                      "our-story", "clinic", "contact")
COMMON_SITE_PATHS = ("/about", "/about-us", "/team", "/our-team", "/meet-the-doctors", "/meet-our-team", "/our-doctors",
                     "/doctors", "/leadership", "/staff", "/contact", "/contact-us")


def keyword_rank(url: Column) -> Column:
    """Position of the first keyword the path names (as a word, plural allowed); 12 when none."""
    path = F.lower(urls.path_of(url))
    return F.coalesce(*[F.when(path.rlike(f"(?<![a-z]){word}s?(?![a-z])"), i) for i, word in enumerate(SITE_PAGE_KEYWORDS)],
                      F.lit(len(SITE_PAGE_KEYWORDS)))


def site_page_targets(sites: DataFrame, links: DataFrame, read: DataFrame, n: int) -> DataFrame:
    """Up to n pages to read per business: home, its links by keyword, then common paths; pages read
    with real content are left out. sites: business_id, website_url; links: business_id, pos, url;
    read: business_id, url, chars.
    """
    site = F.when(F.contains(F.trim("website_url"), F.lit("//")), F.trim("website_url")).otherwise(F.concat(F.lit("http://"), F.trim("website_url")))
    base = sites.where(F.trim(F.coalesce("website_url", F.lit(""))) != "").select("business_id", site.alias("site")).select(
        "business_id", F.concat(urls.scheme_of(F.col("site")), F.lit("://"), urls.netloc_of(F.col("site"))).alias("origin"),
        F.regexp_replace(urls.hostname(F.col("site")), r"^www\.", "").alias("host")).where(F.col("host") != "")
    base = dealt_out(base, "business_id")
    fixed = F.array(F.struct(F.lit(-1).alias("tier"), F.lit("/").alias("path")),
                    *[F.struct(F.lit(100 + i).alias("tier"), F.lit(p).alias("path")) for i, p in enumerate(COMMON_SITE_PATHS)])
    common = base.select("business_id", "origin", F.explode(fixed).alias("f")).select(
        "business_id", F.col("f.tier").alias("tier"), F.lit(0).cast("long").alias("pos"), F.concat("origin", "f.path").alias("url"))
    # of several links to one page the last spelling is kept, at the place of the first
    own = links.join(not_broadcast(base), "business_id").where(F.col("url").startswith("http") & urls.is_same_site(F.col("url"), F.col("host")))
    own = own.groupBy("business_id", urls.page_identity(F.col("url")).alias("identity")).agg(F.min("pos").alias("pos"), F.max_by("url", "pos").alias("url"))
    own = own.select("business_id", keyword_rank(F.col("url")).alias("tier"), "pos", "url").where(F.col("tier") < len(SITE_PAGE_KEYWORDS))
    # a page is here twice at most, so nothing is lost by grouping after the shuffle, where no task sorts a whole file's sites
    options = dealt_out(common.unionByName(own).withColumn("identity", urls.page_identity(F.col("url"))), "business_id", "identity")
    best = options.groupBy("business_id", "identity").agg(F.min(F.struct("tier", "pos", "url")).alias("b"))
    done = read.where(F.col("chars") > 300).select("business_id", urls.page_identity(F.col("url")).alias("identity"))
    best = best.join(done, ["business_id", "identity"], "left_anti").select("business_id", "b.*")
    return top_k(best, ["business_id"], [F.col("tier"), F.col("pos"), F.col("url")], n)


# ---------------------------------------------------------------- research answers

# What marks a finding as a contact detail or as a note on the browsing itself.
CONTACT_DETAIL = r"@|\+?\d[\d\s().-]{7,}\d"
RESEARCH_NOTE = (r"(?i)current page|this page|blank|unvisited|same-site|five-page|page limit|cleaned|scrap|likely|next page"
                 r"|remaining|usable|no visible|no links|did not provide|evidence|qualif|navigation")


def website_findings(findings: Column, limit: int = 12) -> Column:
    """Facts noted on a site (array of texts in page order): collapsed, without contact details and
    notes on the browsing itself, a fact worded twice kept once (80% of the smaller word set shared). A fact is
    compared with the ``limit`` kept ones at most."""
    texts = F.filter(F.transform(findings, lambda t: squeeze(t)), lambda t: t.isNotNull() & ~t.rlike(CONTACT_DETAIL) & ~t.rlike(RESEARCH_NOTE))
    worded = F.filter(F.transform(texts, lambda t: fields(
        text=t, words=F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("([a-z0-9]+)"))))), lambda w: F.size(w["words"]) > 0)
    empty = F.array().cast("array<struct<text:string,words:array<string>>>")

    def add(kept: Column, new: Column) -> Column:
        repeats = F.exists(kept, lambda old: F.size(F.array_intersect(new["words"], old["words"]))
                           >= F.lit(0.8) * F.least(F.size(new["words"]), F.size(old["words"])))
        return F.when((F.size(kept) >= limit) | repeats, kept).otherwise(F.concat(kept, F.array(new)))

    return F.transform(F.aggregate(worded, empty, add), lambda w: F.left(w["text"], F.lit(300)))


def validate_decisions(log: DataFrame, must_score: Column) -> DataFrame:
    """The problem of each research decision, or NULL when it holds.

    ``log``: action, url, score, reasons, reasoning, reason, page_url, links (array of url and
    same_site) offered, visited (array of identities).
    """
    url = F.when(F.col("url").isNotNull(), urls.normalize_url(F.col("url"), F.col("page_url")))
    rows = log.withColumn("__identity", urls.url_identity(url))
    offered = F.transform(F.filter(F.slice("links", 1, MAX_OFFERED_LINKS), lambda x: x["same_site"]), lambda x: urls.url_identity(x["url"]))
    scored = (F.col("score").isNotNull() & F.col("reasons").isNotNull() & F.col("reasoning").isNotNull() & F.col("url").isNull() & F.col("reason").isNull())
    leaves = ((F.trim(F.coalesce("reason", F.lit(""))) != "") & F.col("url").isNull() & F.col("score").isNull() & F.col("reasons").isNull()
              & F.col("reasoning").isNull())
    action = F.col("action")
    problem = (
        F.when(action == "SCORE", F.when(~scored, "SCORE requires score, reasons, and reasoning; set url and reason to null."))
        .when(must_score, "The five-page limit is reached; return SCORE now.")
        .when(action == "EXIT", F.when(~leaves, "EXIT requires reason and null URL/scoring fields."))
        .when(action == "SCRAPE", F.when(F.col("__identity").isNull(), "SCRAPE requires a valid URL from the current website.")
              .when(F.array_contains("visited", F.col("__identity")), "This URL has already been scraped. Choose another URL or produce SCORE/EXIT.")
              .when(~F.array_contains(offered, F.col("__identity")), "Choose an unvisited same-site URL from available_links or return SCORE/EXIT."))
        .otherwise("Choose SCORE, SCRAPE, or EXIT."))
    return rows.withColumn("problem", problem).drop("__identity")


def resume_research(profiles: DataFrame) -> DataFrame:
    """How an interrupted research continues: read the page asked for, or decide on the last page."""
    last = F.element_at("scraped_pages", -1)
    rows = profiles.where(F.col("status").isin("pending", "running") & (F.size("scraped_pages") > 0)).withColumn("__last", last)
    reads = (F.col("__last.agent_action") == "SCRAPE") & (F.coalesce("__last.requested_next_url", F.lit("")) != "")
    return rows.select("business_id", F.size("scraped_pages").alias("pages"),
                       F.when(reads, "read").when(F.col("__last.agent_action").isNull(), "decide").otherwise("restart").alias("next"),
                       F.when(reads, F.col("__last.requested_next_url")).alias("next_url"))


def known_columns(extracted: str, team_size: str = "team_size", languages: str = "languages") -> list[Column]:
    """Team size and languages of the extracted fields as their own columns: a positive integer, a list of texts."""
    size, spoken = F.col(f"{extracted}.{team_size}"), F.col(f"{extracted}.{languages}")
    return [F.when(size > 0, size).cast("int").alias("team_size"), F.when(~F.exists(spoken, lambda x: x.isNull()), spoken).alias("languages")]
