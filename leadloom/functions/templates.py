"""Email templates: ``{{name}}`` and ``{{name|fallback}}`` filled from a map of values per row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import let

# Variable syntax, footer separator, honorifics skipped in a greeting, length limits.
VARIABLE = r"\{\{\s*([a-z][a-z0-9_]*)\s*(?:\|([^{}]*))?\}\}"
FOOTER_SEPARATOR = "\n\n--\n"
GREETING_TITLES = ("dr", "mr", "mrs", "ms", "prof", "engr")
MAX_SUBJECT, MAX_BODY = 200, 5000
TOKEN_PATTERN = "^[A-Za-z0-9_-]{32,128}$"


def squeeze(text: Column) -> Column:
    """Whitespace runs to one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def search_name(name: Column) -> Column:
    """The name without a branch or place after a dash, bar or bracket (a hyphen only when <= 3 words follow)."""
    def without_branch(whole: Column) -> Column:
        head = whole
        for mark in (" — ", " – ", " | ", " ("):
            head = F.substring_index(head, mark, 1)
        return F.coalesce(_blank_to_null(F.trim(let(head, without_place))), whole)

    def without_place(head: Column) -> Column:
        tail = F.substring_index(head, " - ", -1)
        before = F.left(head, F.length(head) - F.length(tail) - 3)
        words = F.size(F.filter(F.split(strip(tail), r"(?U)\s+"), lambda w: w != ""))
        return F.when(F.contains(head, F.lit(" - ")) & (F.length(before) > 0) & (words <= 3), before).otherwise(head)

    return let(squeeze(F.coalesce(name, F.lit(""))), without_branch)


def clean_job_title(title: Column) -> Column:
    return _blank_to_null(strip(F.regexp_replace(title, r"(?U)\s*\([^)]*\)", "")))


def first_name(given: Column, full: Column) -> Column:
    words = F.filter(F.split(strip(F.replace(F.coalesce(full, F.lit("")), F.lit("."), F.lit(". "))), r"(?U)\s+"),
                     lambda w: (w != "") & ~F.lower(F.rtrim(w, F.lit("."))).isin(*GREETING_TITLES))
    picked = F.when(F.coalesce(given, F.lit("")) != "", strip(given)).otherwise(F.get(words, 0))
    return let(picked, lambda p: F.when(~F.contains(p, F.lit("@")), p))


def rating(value: Column) -> Column:
    """As people write it: 4.8, but 5 rather than 5.0."""
    return F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def variables(*, sender_name: str, sender_company: str, extracted: str | None = None, present: set[str] | None = None) -> Column:
    """The map of values a row offers: 17 named ones, and research fields from a map column.

    Expects the wide prospect row; columns it may lack (first_name, last_name, country,
    campaign_name, previous_subject) count as NULL unless named in ``present``.
    """
    present = present or set()

    def maybe(name: str) -> Column:
        return F.col(name) if name in present else F.lit(None).cast("string")

    called = first_name(maybe("first_name"), F.col("contact_name"))
    named = {
        "greeting": F.when(called.isNull() | (called == ""), "Hi").otherwise(F.concat(F.lit("Hi "), called, F.lit(","))),
        "first_name": called, "last_name": maybe("last_name"), "full_name": F.col("contact_name"),
        "job_title": clean_job_title(F.col("job_title")), "business_name": F.col("business_name"),
        "business_short_name": F.when(F.coalesce("business_name", F.lit("")) != "", search_name(F.col("business_name"))),
        "category": F.col("category"), "city": F.col("city"), "country": maybe("country"), "website": F.col("website_url"),
        "google_rating": rating(F.col("google_rating")), "google_review_count": F.col("google_review_count").cast("string"),
        "campaign_name": maybe("campaign_name"), "sender_name": F.lit(sender_name), "sender_company": F.lit(sender_company),
        "previous_subject": maybe("previous_subject"),
    }
    pairs = [part for name, value in named.items() for part in (F.lit(name), _blank_to_null(squeeze(value)))]
    values = F.create_map(*pairs)
    if extracted is None:
        return values
    own = F.map_filter(F.coalesce(F.col(extracted), F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*named))
    return F.map_concat(values, F.transform_values(own, lambda _, x: _blank_to_null(squeeze(x))))


def shown(value: Column, kind: str) -> Column:
    """An extracted value as text: lists joined, booleans yes/no."""
    if kind == "yes/no":
        return F.when(value, "yes").when(~value, "no")
    if kind in ("text list", "integer list"):
        items = F.filter(F.transform(value, lambda x: x.cast("string")), lambda x: x.isNotNull() & (x != ""))
        return _blank_to_null(F.array_join(items, ", "))
    return _blank_to_null(squeeze(value.cast("string")))


def _parts(template: str) -> list[tuple[str, str | None, str | None]]:
    """The template cut once, when the plan is made: (literal, variable, fallback)."""
    parts, at = [], 0
    for match in re.finditer(VARIABLE, template or ""):
        parts += [(template[at:match.start()], None, None), ("", match.group(1), match.group(2))]
        at = match.end()
    return [*parts, ((template or "")[at:], None, None)]


def fill(template: str, values: str) -> tuple[Column, Column]:
    """(text, missing): the filled text and the variables with neither value nor fallback, in order."""
    pieces, missing = [], []
    for literal, name, fallback in _parts(template):
        if name is None:
            pieces.append(F.lit(literal))
            continue
        value = F.get(F.array(F.col(values)[name]), 0)
        pieces.append(F.coalesce(value, F.lit((fallback or "").strip())))
        if fallback is None:
            missing.append(F.when(value.isNull(), F.lit(name)))
    gaps = F.array_distinct(F.array_compact(F.array(*missing))) if missing else F.array().cast("array<string>")
    return F.concat(*pieces), gaps


def tokenised(text: Column) -> Column:
    """A template text as struct(literals, variables): one literal more than variables, which have a name and maybe a fallback."""
    text = F.coalesce(text, F.lit(""))
    whole, names, fallbacks = (F.regexp_extract_all(text, F.lit(VARIABLE), F.lit(i)) for i in range(3))
    found = F.arrays_zip(whole.alias("whole"), names.alias("name"), fallbacks.alias("fallback"))
    variables = F.transform(found, lambda v: F.struct(
        v["name"].alias("name"), F.when(F.contains(v["whole"], F.lit("|")), strip(v["fallback"])).alias("fallback")))
    return F.struct(F.split(text, VARIABLE, -1).alias("literals"), variables.alias("variables"))


def fill_tokens(tokens: Column, values: Column) -> tuple[Column, Column]:
    """What ``fill`` does, with a tokenised template that may differ from row to row."""
    def value(v: Column) -> Column:
        return F.try_element_at(values, v["name"])

    filled = F.transform(tokens["variables"], lambda v: F.coalesce(value(v), v["fallback"], F.lit("")))
    text = F.array_join(F.zip_with(tokens["literals"], filled, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    gaps = F.filter(tokens["variables"], lambda v: value(v).isNull() & v["fallback"].isNull())
    return text, F.array_distinct(F.transform(gaps, lambda v: v["name"]))


def render_rows(rows: DataFrame, templates: DataFrame, values: str, template_id: str = "template_id", out: str = "draft") -> DataFrame:
    """Rows with the draft of their own template (templates: id, subject, body), as ``render`` gives it.

    Templates are cut once each, not once a row. A row whose template is NULL or unknown gets a NULL draft.
    """
    cut = templates.select(F.col("id").alias("__template"), tokenised(F.col("subject")).alias("__subject"), tokenised(F.col("body")).alias("__body"))
    joined = rows.join(cut, F.col(template_id) == F.col("__template"), "left")
    subject, body = fill_tokens(F.col("__subject"), F.col(values)), fill_tokens(F.col("__body"), F.col(values))
    draft = F.when(F.col("__template").isNotNull(), _draft(*subject, *body))
    return joined.withColumn(out, draft).drop("__template", "__subject", "__body")


def render(subject: str, body: str, values: str) -> Column:
    """struct(subject, body, missing); the texts are NULL (the email is held) when anything is missing."""
    return _draft(*fill(subject, values), *fill(body, values))


def _draft(subject_text: Column, subject_gaps: Column, body_text: Column, body_gaps: Column) -> Column:
    subject_text, body_text = squeeze(subject_text), strip(body_text)
    gaps = F.array_union(subject_gaps, body_gaps)
    empty = F.when(subject_text == "", F.array(F.lit("subject"))).when(body_text == "", F.array(F.lit("body")))
    gaps = F.when(F.size(gaps) > 0, gaps).otherwise(F.coalesce(empty, F.array().cast("array<string>")))
    complete = F.size(gaps) == 0
    return F.struct(F.when(complete, F.left(subject_text, F.lit(MAX_SUBJECT))).alias("subject"),
                    F.when(complete, F.left(body_text, F.lit(MAX_BODY))).alias("body"), gaps.alias("missing"))


def used_variables(*texts: str) -> Column:
    found = [F.regexp_extract_all(F.coalesce(F.col(t), F.lit("")), F.lit(VARIABLE), F.lit(1)) for t in texts]
    return F.array_distinct(F.concat(*found))


def problems(text: str, known: list[str], follow_up: bool = True) -> Column:
    """What is wrong with a template text: unknown variables, misplaced ones, broken braces."""
    content = F.coalesce(F.col(text), F.lit(""))
    used = F.regexp_extract_all(content, F.lit(VARIABLE), F.lit(1))
    allowed = F.array(*[F.lit(k) for k in known])
    found = F.transform(used, lambda n: F.when(~F.array_contains(allowed, n), F.concat(F.lit("unknown variable "), n)).when(
        (n == "previous_subject") & F.lit(not follow_up), F.lit("previous_subject only exists in follow-ups")))
    rest = F.regexp_replace(content, VARIABLE, "")
    broken = F.left(F.regexp_extract(rest, r"\{\{[^}]*\}?\}?", 0), F.lit(40))
    last = F.when(F.contains(rest, F.lit("{{")), F.concat(F.lit("broken variable "), broken))
    return F.array_distinct(F.array_compact(F.concat(found, F.array(last))))


# ---------------------------------------------------------------- rendering


def _escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def _paragraphs(text: Column, opening: str = "<p>") -> Column:
    parts = F.filter(F.transform(F.split(strip(text), r"\n\s*\n"), strip), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(
        F.lit(opening), F.replace(_escape(p), F.lit("\n"), F.lit("<br>")), F.lit("</p>"))), "\n")


def render_text(body: Column, footer: str) -> Column:
    return F.concat(strip(body), F.lit(FOOTER_SEPARATOR + footer))


def render_html(body: Column, footer: str, image: Column | None = None) -> Column:
    """Escaped paragraphs, then the footer (with the image tag given, when open tracking is on)."""
    small = '<p style="font-size:12px;color:#666;">'
    return F.concat(F.lit("<!doctype html>\n<html><body>\n"), _paragraphs(body), F.lit('\n<div class="footer">\n'),
                    image if image is not None else F.lit(""), _paragraphs(F.lit(footer), small), F.lit("\n</div>\n</body></html>"))


def editable_body(body_text: Column) -> Column:
    """What a person wrote: everything before the last footer separator."""
    text = F.coalesce(body_text, F.lit(""))
    tail = F.substring_index(text, FOOTER_SEPARATOR, -1)
    return F.when(F.contains(text, F.lit(FOOTER_SEPARATOR)),
                  F.left(text, F.length(text) - F.length(tail) - len(FOOTER_SEPARATOR))).otherwise(text)


def tracking_token(row_id: Column, salt: str) -> Column:
    """43 URL-safe characters; a keyed hash instead of a random number, so a retried task gives the same."""
    digest = F.unhex(F.sha2(F.concat(row_id.cast("string"), F.lit(salt)), 256))
    return F.rtrim(F.translate(F.base64(digest), "+/", "-_"), F.lit("="))


def tracking_url(base: Column, token: Column) -> Column:
    return F.concat(base, F.lit("/"), token)


def extracted_value(value: Column, kind: str) -> Column:
    """A user-defined output field as stored: trimmed text, lists without blanks or repeats, no negative integers."""
    if kind == "text":
        return _blank_to_null(F.left(squeeze(value), F.lit(1000)))
    if kind in ("text list", "integer list"):
        return clean_list(value, text=kind == "text list")
    if kind == "integer":
        return F.when(value >= 0, value)
    return value


def clean_list(items: Column, text: bool = True, keep: int = 50) -> Column:
    """Blanks and repeats (ignoring case) dropped, the first spelling kept, at most ``keep``; NULL when empty."""
    if text:
        items = F.transform(items, lambda x: F.left(squeeze(x), F.lit(200)))
        items = F.filter(items, lambda x: x.isNotNull() & (x != ""))
        folded = F.transform(items, lambda x: F.lower(x))
    else:
        items = F.filter(items, lambda x: x.isNotNull())
        folded = items
    # the position of an item's first equal is its own position
    first = F.filter(F.arrays_zip(items.alias("item"), folded.alias("mark"), F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1))).alias("at")),
                     lambda z: z["item"].isNotNull() & (F.array_position(folded, z["mark"]) == z["at"]))
    kept = F.slice(F.transform(first, lambda z: z["item"]), 1, keep)
    return F.when(F.size(kept) > 0, kept)
