"""What the plans of all registered queries must not contain: pairs, and windows over a whole hot key."""

import re

from leadloom.operators import people
from leadloom.plans import load

FOLDER = "/root/testdata/sf0.001"
SPEC = re.compile(r"windowspecdefinition\((.*?)(?: ASC| DESC|, specifiedwindowframe)")  # the partition keys come first
# a block of a key, the lines of one order (seven numbers at most), the guesses for one person's name, a summary row per block
BOUNDED = ("__block", "__part", "__level", "l_orderkey", "person_id", "__carry", "__before")


def plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def unbounded_windows(lines):
    for at, line in enumerate(lines):
        if " Window [" not in line:
            continue
        found = SPEC.search(line)
        keys = found.group(1) if found else ""
        limited = any("WindowGroupLimit" in below for below in lines[at + 1:at + 4])
        summary = "__total_" in line or "sum(__n" in line or "__first" in line
        if not limited and not summary and not any(name in keys for name in BOUNDED):
            yield keys[:120]


def test_no_pairs_and_no_window_over_a_whole_key(spark):
    spark.conf.set("spark.sql.maxPlanStringLength", str(10_000_000))
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    problems = []
    for name, query in load().items():
        lines = plan(query(spark, FOLDER))
        problems += [(name, kind) for kind in ("CartesianProduct", "BroadcastNestedLoopJoin") if any(kind in line for line in lines)]
        problems += [(name, line) for line in unbounded_windows(lines)]
    assert sorted(set(problems)) == []


def test_filters_and_columns_reach_the_scan(spark):
    text = "\n".join(plan(load()["usage_by_day_range"](spark, FOLDER)))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in text
    text = "\n".join(plan(load()["document_emails"](spark, FOLDER)))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def broadcasts(df) -> int:
    return sum("BroadcastExchange" in line for line in plan(df))


def test_guesses_are_not_broadcast(spark):
    """Spark's estimate leaves out what an explode makes, so these joins were broadcasts that no driver held at size."""
    assert broadcasts(load()["candidate_address_ranking"](spark, FOLDER)) == 1  # the few domains of the nations


def test_links_and_addresses_are_not_broadcast(spark):
    """The pieces of links were broadcast, about 25 rows for each link."""
    ids = spark.range(100)
    crowd = ids.selectExpr("id AS person_id", "id AS business_id", "'Ann' AS first_name", "'Lee' AS last_name", "'Ann Lee' AS name")
    links = ids.selectExpr("id AS business_id", "0 AS pos", "'https://linkedin.com/in/ann-lee/' AS url")
    found = ids.selectExpr("id AS business_id", "'ann.lee@b.org' AS address", "'website' AS source", "0 AS first_pos")
    domains = ids.selectExpr("id AS business_id", "'b.org' AS domain")
    for hits in (people.profile_links(crowd, links), people.own_emails(crowd, found, domains)):
        assert broadcasts(hits) == 0 and hits.count() == 100


def test_people_are_extracted_in_many_tasks(spark):
    """One file of customers was one task; and no name is cleaned twice, once for a condition and once for its value."""
    lines = plan(load()["extracted_people"](spark, FOLDER))
    assert any("REPARTITION_BY_NUM" in line for line in lines)
    assert sum("ArrowEvalPython" in line for line in lines[[i for i, line in enumerate(lines) if "Initial Plan" in line][-1] if any("Initial Plan" in line for line in lines) else 0:]) <= 4


def test_tree_of_words_finds_the_longest():
    words = {"co founder", "co", "coo", "owner", "owner and dentist", "owner dentist", "ow"}
    listed = re.compile("(?i:" + "|".join(w.replace(" ", r"[\s\-/]+") for w in sorted(words, key=lambda w: (-len(w), w))) + ")")
    tree = re.compile("(?i:" + people._tree(words) + ")")
    for text in ("Co-Founder and COO", "owner and  dentist, owner, ow", "Owner / dentist", "cowner co", "none"):
        assert [m.span() for m in tree.finditer(text)] == [m.span() for m in listed.finditer(text)]


def test_python_workers_get_small_batches(spark):
    """Ten thousand pages at once, as Spark hands them out by itself, made a worker's memory grow with its partition."""
    import pandas as pd
    from pyspark.sql import functions as F
    for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{name}")
    load()["page_links"](spark, FOLDER)
    rows = F.pandas_udf(lambda html: pd.Series([len(html)] * len(html)), "long")
    pages = spark.range(0, 5000, 1, 1)
    assert pages.select(rows(F.concat(F.lit("x"), F.col("id").cast("string"))).alias("n")).agg(F.max("n")).first()[0] <= 1000
    assert pages.select(rows(F.repeat(F.lit("x" * 100), 1000)).alias("n")).agg(F.max("n")).first()[0] <= 100


def test_sites_are_dealt_out_before_they_become_pages(spark):
    """The pages of all sites of a file were sorted in the task that read the file."""
    lines = plan(load()["site_page_targets"](spark, FOLDER))
    lines = lines[[i for i, line in enumerate(lines) if line.strip() == "+- == Initial Plan =="][-1] + 1 if any("Initial Plan" in line for line in lines) else 0:]
    explodes = [i for i, line in enumerate(lines) if "Generate explode" in line]
    assert explodes and all("REPARTITION_BY_NUM" in next(line for line in lines[i:] if "Exchange" in line or "FileScan" in line) for i in explodes)


def test_every_email_waits_for_its_own_mailbox(spark):
    """A few mailboxes hold all emails; dealing them to many senders made every chain short."""
    from leadloom.plans.views import Views
    own = Views(spark, FOLDER).v_emails.where("status = 'approved'").selectExpr("id AS email_id", "cast(mailbox_id AS bigint) AS own")
    made = load()["schedule_single_mailbox"](spark, FOLDER).join(own, "email_id", "right")
    assert made.where("mailbox_id IS NULL OR mailbox_id <> own").count() == 0 and made.count() > 0


def test_emails_are_made_once_for_a_schedule(spark, monkeypatch):
    """What is due, what was sent before and what is held each read and numbered all lines again, several times over."""
    from leadloom.operators import schedule
    given, whole = [], schedule.schedule
    monkeypatch.setattr(schedule, "schedule", lambda *frames: given.append(frames[:3]) or whole(*frames))
    load()["schedule_pool"](spark, FOLDER)
    for rows in given[0]:
        assert not any("l_linenumber" in line for line in plan(rows))


def test_names_are_worked_out_once_and_meet_addresses_ungrouped(spark):
    """A condition on a name's variants went below the exchange that deals names out, so few tasks worked them all out beforehand; and all guesses were grouped
    and joined to people again before any met an address."""
    lines = plan(load()["own_emails"](spark, FOLDER))
    assert sum("ArrowEvalPython" in line for line in lines) == 1
    assert not any("Aggregate" in line and "max_by" in line for line in lines)
    crowd = spark.createDataFrame([(1, 1, "Ann Lee"), (2, 2, "Ann Lee"), (3, 3, "Ann Lee"), (4, 4, "Ann Lee"), (5, 5, "Info Desk"), (6, 6, "Ann Lee")], "person_id long, business_id long, name string")
    found = spark.createDataFrame([(1, "ann@mail.b.org", 5), (1, "alee@b.org", 7), (1, "lee@notb.org", 1), (2, "ann.lee@x.net", 2), (2, "ann.lee@x.net", 2), (3, "ann@b.org.", 1), (4, "ann@org", 1),
                                   (5, "info@b.org", 1), (6, "ann@any.org", None)], "business_id long, address string, first_pos long").selectExpr("*", "'website' AS source")
    domains = spark.createDataFrame([(1, "b.org"), (1, "b.org"), (3, "b.org"), (4, None), (5, "b.org")], "business_id long, domain string")
    got = {r.person_id: (r.email, r.pattern) for r in people.own_emails(crowd, found, domains).collect()}
    assert got == {1: ("ann@mail.b.org", "first"), 2: ("ann.lee@x.net", "first.last"), 6: (None, None)}


def test_all_links_of_a_page_count(spark, tmp_path):
    """Links beyond a page's first hundred were dropped, in page_links and in the number that page_content gives; unvisited_links, whose SQL says so, still remembers a hundred."""
    from compare import difference
    from leadloom.plans.views import TABLES
    for name in TABLES:
        if name != "pages":
            (tmp_path / f"{name}.parquet").symlink_to(f"{FOLDER}/{name}.parquet")
    html = "<html><body>" + "".join(f'<a href="/p{i % 270}">n</a>' for i in range(300)) + "</body></html>"
    rows = [(1, "https://a.org/x", html), (2, "https://b.org/", '<a href="/p">n</a>'), (3, "https://c.org/", "<p>none</p>"), (4, "https://d.org/", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    links = load()["page_links"](spark, str(tmp_path))
    assert difference(links, load()["page_links"].oracle, str(tmp_path)) is None and links.count() == 271
    assert {r.page_id: r.links for r in load()["page_content"](spark, str(tmp_path)).collect()} == {1: 270, 2: 1, 3: 0, 4: 0}
    assert difference(load()["unvisited_links"](spark, str(tmp_path)), load()["unvisited_links"].oracle, str(tmp_path)) is None


def test_links_are_told_apart_without_comparing_all(spark):
    """Pages have any number of links: 30,000 of them must not be compared with each other."""
    from leadloom.sources import pages
    html = "".join(f'<a href="/p{i % 29_990}">n{i}</a>' for i in range(30_000))
    rows = spark.createDataFrame([(1, "https://a.org/x", html)], "page_id long, url string, html string")
    links = pages.extract_pages(rows).first().links
    assert [x.pos for x in links] == list(range(29_990)) and links[7].url == "https://a.org/p7" and links[7].text == "n7"
    assert [x.pos for x in pages.extract_pages(rows, most_links=3).first().links] == [0, 1, 2]
