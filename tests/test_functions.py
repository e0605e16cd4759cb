"""Column functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from leadloom.functions import names, places, templates, text, urls
from leadloom.operators.verify import excluded_pattern, reserved_domain
from leadloom.schemas import TABLE_DDL, schema, user_fields_schema
from leadloom.sources.pages import website_findings


def apply(spark, values, function, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.select("i", function(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_text(spark):
    assert apply(spark, ["  Ａ​ b  c ", "", None, ""], text.normalize_text) == ["A b c", None, None, None]
    assert apply(spark, ["O'Brien’s_Café Zoë", "ＳＭＩＬＥ", "—"], text.normalize_name_key) == ["obriens cafe zoe", "smile", None]
    assert apply(spark, ["Müller-Straße ﬁ", "A b"], text.ascii_token) == ["mullerstraefi", "ab"]
    assert apply(spark, ["Alvi Dental Hospital of the City", "Smile Solutions"], text.distinctive_tokens) == [["alvi"], []]
    assert apply(spark, [" a, ,b ", None], text.parse_list) == [["a", "b"], []]


@pytest.mark.parametrize("url, expected", [
    ("HTTP://WWW.Example.com:80//a//b/?b=2&utm_source=x&a=1&FBCLID=q#top", "http://example.com/a/b?a=1&b=2"),
    ("https://example.com", "https://example.com/"), ("https://example.com:8443/x/", "https://example.com:8443/x"),
    ("https://user:pw@example.com/", None), ("ftp://example.com/", None), ("mailto:a@b.org", None), ("https://exa..mple.com/", None),
    ("https://bücher.example/x", "https://xn--bcher-kva.example/x"), ("https://e.com/?q=a b&r=ä&s", "https://e.com/?q=a+b&r=%C3%A4&s="),
    ("http://[::1]:81/", "http://[::1]:81/"), ("https://e.com:99999/", None), ("//e.com/x", None),
])
def test_normalize_url(spark, url, expected):
    assert apply(spark, [url], urls.normalize_url_idna) == [expected]


def test_relative_links(spark):
    base = "https://e.com/a/b/c.html?x=1"
    cases = {"d": "https://e.com/a/b/d", "../d/./e": "https://e.com/a/d/e", "/z": "https://e.com/z", "//o.org/k": "https://o.org/k", "?y=2": "https://e.com/a/b/c.html?y=2",
             "#f": "https://e.com/a/b/c.html?x=1", "": "https://e.com/a/b/c.html?x=1", "http://q.org": "http://q.org/", "javascript:x()": None, "../../../../r": "https://e.com/r"}
    assert apply(spark, list(cases), lambda c: urls.normalize_url(c, F.lit(base))) == list(cases.values())


def test_sites(spark):
    assert apply(spark, ["https://a.b.org", "https://b.org", "https://xb.org", "/x"], lambda c: urls.is_same_site(c, F.lit("b.org"))) == [True, True, False, False]
    assert apply(spark, ["smile.pk", "https://WWW.Smile.pk/x", "gmail.com", "localhost", None], urls.host_of) == ["smile.pk", "smile.pk", None, None, None]
    assert apply(spark, ["www.Smile.pk", "http://x.org:8080/a/", "ftp://x", "https://x.org/?q#f"], urls.normalize_website) == [
        "https://smile.pk", "http://x.org:8080/a", None, "https://x.org?q"]
    assert apply(spark, ["https://maps.x/!4m7!3m6!19sChIJt1Zu96w4sz4R2EwodF7D35U?authuser=0", "x"], urls.place_id_from_url) == ["ChIJt1Zu96w4sz4R2EwodF7D35U", None]
    assert apply(spark, ["Mail A.B@x.org, a.b@X.ORG and c+d@y.co.uk."], urls.extract_emails) == [["a.b@x.org", "c+d@y.co.uk"]]


ADDRESSES = {
    "Building, Room # 10-14, Block 3 Gulshan-e-Iqbal, Karachi, 75300, Pakistan": ("Karachi", None, "75300"),
    "Shop 2, Main Blvd, Gulberg III, Lahore, Punjab 54000, Pakistan": ("Lahore", "Punjab", "54000"),
    "100 Congress Ave, Austin, TX 78701, United States": ("Austin", "TX", "78701"),
    "10 Downing St, London SW1A 2AA, UK": ("London", None, "SW1A 2AA"),
    "Plot 5, F-7 Markaz, Islamabad, Pakistan": ("Islamabad", None, None),
    "B-256 karachi": (None, None, None), "": (None, None, None),
}


def test_places(spark):
    got = apply(spark, list(ADDRESSES), lambda a: places.parse_address(a, F.lit("Pakistan")))
    assert [tuple(r) for r in got] == list(ADDRESSES.values())
    assert apply(spark, ["4.7\n(275)", "4.2(1,234)", "1,275 reviews", "4.7", None], places.parse_review_count) == [275, 1234, 1275, None, None]
    assert apply(spark, ["+92 (300) 123-4567", "0300-1234567", "abc"], lambda p: places.normalize_phone(p, F.lit("Pakistan"))) == ["+923001234567", "+923001234567", None]
    assert apply(spark, ["923001234567", "03001234567", "12"], lambda p: places.normalize_listed_phone(p, F.lit("Pakistan"))) == ["+923001234567", "+923001234567", "12"]
    assert apply(spark, ["+92 300 1234567", "123"], places.phone_key) == ["001234567", None]


def test_search_name(spark):
    cases = {"Alvi Dental Hospital — SMCHS": "Alvi Dental Hospital", "Smile Studio | DHA": "Smile Studio", "City Dental (Gulberg)": "City Dental",
             "Smile - North": "Smile", "Smile - a b c d": "Smile - a b c d", "Co-Op  Dental": "Co-Op Dental", " — X": "— X"}
    assert apply(spark, list(cases), templates.search_name) == list(cases.values())


def test_names(spark):
    cases = {"Dr. M. Shoaib Ahmed, BDS": ("Shoaib Ahmed", "Shoaib", "Ahmed"), "Muhammad Shoaib Ahmed": ("Muhammad Shoaib Ahmed", "Shoaib", "Ahmed"), "Dr. Kashif": ("Kashif", "Kashif", None),
             "Jane": None, "Sonal Shah's Smile Solutions": None, "Meet Jane Doe": ("Jane Doe", "Jane", "Doe"), "Jane Dental": None, "J. K. Rowling": ("K. Rowling", "K.", "Rowling"), "": None}
    got = apply(spark, list(cases), names.clean_name)
    assert [r and tuple(r)[:3] for r in got] == list(cases.values())
    variants = apply(spark, ["Muhammad Shoaib Ahmed", "Mary Jane Noor-Shah", "Cher", "Muhammad Ali", ""], names.name_variants)
    shown = [([tuple(g) for g in v.givens], [tuple(x) for x in v.lasts]) for v in variants]
    assert shown == [([("shoaib", 1.0), ("muhammad", 0.3)], [("ahmed", 1.0)]),
                     ([("mary", 1.0), ("jane", 0.6)], [("noorshah", 1.0), ("noor", 0.6), ("shah", 0.6)]),
                     ([("cher", 1.0)], []), ([("ali", 1.0), ("muhammad", 0.3)], [("ali", 1.0)]), ([], [])]


def test_globs_and_reserved_names(spark):
    patterns = ["Info@*", "*@gmail.com", "business@*", "[ab]x?@*"]
    assert apply(spark, [" INFO@x.org", "ann@Gmail.com", "xinfo@x.org", "bx1@y", "cx1@y", None], lambda a: excluded_pattern(a, patterns)) == [
        "info@*", "*@gmail.com", None, "[ab]x?@*", None, None]
    assert apply(spark, ["mail.example.com.", "a.test", "localhost", "example.pk"], reserved_domain) == [True, True, True, False]


def test_templates(spark):
    row = spark.createDataFrame([("Dr. Ann Lee", "Owner (practice named after them)", "Alvi — DHA", "Dentist", None, None, 4.0, 12, {"tool": None, "open": "yes"})],
                                "contact_name string, job_title string, business_name string, category string, city string, website_url string, google_rating double, "
                                "google_review_count int, extracted map<string,string>")
    row = row.withColumn("google_rating", F.col("google_rating").cast("decimal(2,1)"))
    values = row.select(templates.variables(sender_name="Us", sender_company="Co", extracted="extracted").alias("values"))
    draft = values.select(templates.render("{{business_short_name}}: {{ first_name }} {{google_rating}}", "{{greeting}} {{open}} {{city|there}}\n{{google_review_count}}", "values").alias("d")).first().d
    assert (draft.subject, draft.body, draft.missing) == ("Alvi: Ann 4", "Hi Ann, yes there\n12", [])
    held = values.select(templates.render("{{previous_subject}}", "{{tool}} {{job_title}} {{tool}}", "values").alias("d")).first().d
    assert (held.subject, held.body, held.missing) == (None, None, ["previous_subject", "tool"])
    body = "A & B\n\n<c>\nd"
    html = apply(spark, [body], lambda b: templates.render_html(b, "Foot"))[0]
    assert "<p>A &amp; B</p>\n<p>&lt;c&gt;<br>d</p>" in html and '<p style="font-size:12px;color:#666;">Foot</p>' in html
    assert apply(spark, [body], lambda b: templates.editable_body(templates.render_text(b, "Foot"))) == [body]


def test_findings(spark):
    notes = ["Address: 1 Main St", "Clinic address: 1 Main St, Pakistan", "Call +92 300 1234567", "The contact page was blank", "Open on Sundays", "open ON sundays!", "", "Uses  paper   forms"]
    assert apply(spark, [notes], website_findings, "array<string>") == [["Address: 1 Main St", "Open on Sundays", "Uses paper forms"]]


def test_schemas():
    for table in TABLE_DDL:
        assert schema(table).fields
    assert user_fields_schema([{"name": "team_size", "type": "integer"}]).simpleString() == "struct<team_size:bigint>"
    with pytest.raises(ValueError):
        user_fields_schema([{"name": "score", "type": "integer"}])
