"""Phones, postal addresses, review counts and the words that place a business."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.text import ascii_token, distinctive_tokens, fields, fold_ascii, let, lookup, normalize_text, token


@dataclass(frozen=True)
class Country:
    """Names a country goes by (lower case), its dial code, trunk prefix and national number lengths."""

    names: tuple[str, ...]
    code: str
    trunk: str = "0"
    shortest: int = 7
    longest: int = 11


# The countries known by default; pass your own list for others.
COUNTRIES = (
    Country(("pakistan", "pk", "pak"), "92", shortest=8, longest=12), Country(("india", "in", "ind"), "91", longest=13),
    Country(("united states", "united states of america", "us", "usa", "u.s.a."), "1", "1", 10, 10),
    Country(("canada", "ca", "can"), "1", "1", 10, 10),
    Country(("united kingdom", "uk", "gb", "gbr"), "44", shortest=9, longest=10),
    Country(("germany", "de", "deu"), "49", shortest=6, longest=15), Country(("france", "fr", "fra"), "33", shortest=9, longest=9),
    Country(("spain", "es", "esp"), "34", "", 9, 9), Country(("italy", "it", "ita"), "39", "", 6, 12),
    Country(("netherlands", "nl", "nld"), "31", shortest=9, longest=11), Country(("ireland", "ie", "irl"), "353"),
    Country(("australia", "au", "aus"), "61", longest=15), Country(("new zealand", "nz", "nzl"), "64"),
    Country(("united arab emirates", "ae", "are"), "971", longest=12), Country(("saudi arabia", "sa", "sau"), "966", longest=10),
    Country(("bangladesh", "bd", "bgd"), "880"), Country(("turkey", "türkiye", "tr", "tur"), "90", longest=13),
    Country(("south africa", "za", "zaf"), "27"), Country(("brazil", "br", "bra"), "55"), Country(("mexico", "mx", "mex"), "52", ""),
    Country(("poland", "pl", "pol"), "48", ""), Country(("sweden", "se", "swe"), "46"), Country(("switzerland", "ch", "che"), "41"),
    Country(("austria", "at", "aut"), "43"), Country(("belgium", "be", "bel"), "32"), Country(("portugal", "pt", "prt"), "351", ""),
)

UK_POSTCODE = r"[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}"
NUMERIC_POSTAL = r"\d[\d -]{2,9}"


def _codes(countries) -> dict[str, str]:
    return {name: c.code for c in countries for name in c.names}


def _rule(code: Column, countries) -> Column:
    """The dial rule of a country code: struct(trunk, shortest, longest), NULLs when unknown."""
    return fields(trunk=lookup(code, {c.code: c.trunk for c in countries}), shortest=lookup(code, {c.code: c.shortest for c in countries}),
                  longest=lookup(code, {c.code: c.longest for c in countries}))


def is_country(name: Column, countries=COUNTRIES) -> Column:
    return F.coalesce(lookup(F.lower(F.trim(name)), _codes(countries)).isNotNull(), F.lit(False))


def normalize_phone(value: Column, country: Column | None = None, countries=COUNTRIES) -> Column:
    """+country code and number where the country's rules allow it, else the bare digits.

    The dial rules are the trunk prefix and number lengths in ``countries``, not a full numbering plan.
    """
    return let(normalize_text(value), lambda text: _phone(text, country, countries))


def _phone(text: Column, country: Column | None, countries) -> Column:
    code = F.lit(None).cast("string") if country is None else lookup(F.lower(F.trim(country)), _codes(countries))

    def chosen(p: Column) -> Column:
        digits, rule = p["digits"], p["rule"]
        trunked = (rule["trunk"] != "") & F.startswith(digits, rule["trunk"])
        national = F.when(trunked, F.substring(digits, 2, 30)).otherwise(digits)
        fits = F.length(national).between(rule["shortest"], rule["longest"]) & ~digits.startswith("00")
        local = F.when(F.coalesce(fits, F.lit(False)), F.concat(F.lit("+"), p["code"], national)).otherwise(digits)
        return F.nullif(F.when(text.startswith("+") & (digits != ""), F.concat(F.lit("+"), digits)).otherwise(local), F.lit(""))

    return let(fields(digits=F.regexp_replace(text, "[^0-9]", ""), code=code, rule=_rule(code, countries)), chosen)


def normalize_listed_phone(value: Column, country: Column | None = None, countries=COUNTRIES) -> Column:
    """As listings give it: bare digits starting with a country code are international already."""
    def listed(text: Column) -> Column:
        def with_code(length: int) -> Column:
            rest = F.substring(text, length + 1, 30)
            return let(_rule(F.left(text, F.lit(length)), countries), lambda rule: F.coalesce(
                F.length(rest).between(F.greatest(rule["shortest"], F.lit(8)), rule["longest"])
                & ~((rule["trunk"] != "") & F.startswith(rest, rule["trunk"])), F.lit(False)))

        whole = with_code(1) | with_code(2) | with_code(3)
        return F.when(text.rlike("^[1-9][0-9]*$") & whole, F.concat(F.lit("+"), text)).otherwise(_phone(text, country, countries))

    return let(normalize_text(value), listed)


def phone_key(phone: Column) -> Column:
    """The last 9 digits, enough to match a number across formats."""
    digits = F.regexp_replace(F.coalesce(phone, F.lit("")), r"(?U)\D", "")
    return F.when(F.length(digits) >= 9, F.right(digits, F.lit(9)))


def parse_address(address: Column, country: Column | None = None, countries=COUNTRIES) -> Column:
    """struct(city, state, postal_code) read from the right end of a comma-separated address."""
    combined = rf"(?iU)^([^\d,]*[^\d\s,])\s+({NUMERIC_POSTAL}|{UK_POSTCODE})$"
    british = f"^(?i:{UK_POSTCODE})$"

    def last(parts: Column) -> Column:
        return F.get(parts, F.size(parts) - 1)

    def shorter(parts: Column) -> Column:
        return F.slice(parts, 1, F.size(parts) - 1)

    def without_country(parts: Column) -> Column:
        named = is_country(last(parts), countries)
        if country is not None:
            named = named | F.coalesce(F.lower(last(parts)) == F.lower(F.trim(country)), F.lit(False))
        return F.when(F.size(parts) < 2, F.array().cast("array<string>")).when(named, shorter(parts)).otherwise(parts)

    def read(p: Column) -> Column:
        parts, end, more = p["parts"], p["end"], F.size(p["parts"]) > 1
        alone = end.rlike(f"^(?:{NUMERIC_POSTAL}|(?i:{UK_POSTCODE}))$")
        both = ~alone & end.rlike(combined)
        name, code = F.trim(F.regexp_extract(end, combined, 1)), F.trim(F.regexp_extract(end, combined, 2))
        town_first = both & code.rlike(british)
        left = (F.when(more & (alone | (both & ~town_first)), shorter(parts))
                .when(more & town_first, F.concat(shorter(parts), F.array(name))).otherwise(parts))
        return fields(left=left, state=F.when(more & both & ~town_first, name),
                      postal_code=F.when(more & alone, end).when(more & both, code))

    def placed(r: Column) -> Column:
        end = last(r["left"])
        city = F.when((F.size(r["left"]) > 1) & end.rlike(r"\p{L}") & ~end.rlike(r"(?U)\d"), F.left(end, F.lit(120)))
        return fields(city=city, state=r["state"], postal_code=r["postal_code"])

    parts = F.filter(F.transform(F.split(F.coalesce(normalize_text(address), F.lit("")), ","), lambda x: F.trim(x)), lambda p: p != "")
    rest = let(parts, without_country)
    return let(let(let(rest, lambda p: fields(parts=p, end=last(p))), read), placed)


def parse_review_count(*texts: Column) -> Column:
    """"4.7(1,275)" or "1,275 reviews" -> 1275; the first text that has one decides."""
    found = []
    for text in texts:
        bracket = F.regexp_extract(text, r"\(([\d,.\s]+)\)", 1)
        worded = F.regexp_extract(text, r"(?i)([\d,.]+)\s+reviews?\b", 1)
        digits = F.regexp_replace(F.when(bracket != "", bracket).otherwise(worded), r"\D", "")
        found.append(F.nullif(digits, F.lit("")).cast("int"))
    return F.coalesce(*found)


def business_location(city: Column, address: Column, country: Column) -> Column:
    """City, else the last address part without digits that is not the country."""
    parts = F.filter(F.transform(F.split(F.coalesce(address, F.lit("")), ","), lambda x: F.trim(x)),
                     lambda p: (p != "") & (F.lower(p) != F.lower(F.coalesce(country, F.lit("")))) & ~p.rlike(r"(?U)\d"))
    return F.coalesce(F.nullif(city, F.lit("")), F.get(parts, F.size(parts) - 1))


def context_tokens(location: Column, domains: Column) -> Column:
    """Tokens that tie a text to a business: its location and full domains, longer than three characters."""
    found = F.concat(F.array(ascii_token(F.coalesce(location, F.lit("")))), F.transform(domains, lambda d: token(F.lower(d))))
    return F.filter(F.array_distinct(found), lambda t: F.length(t) > 3)


def mentions_business(text: Column, name: Column, context: Column, phone: Column) -> Column:
    """Whether a text is about this business: its phone, its distinctive words, or (for a generic
    name) the whole name together with its place or domain."""
    folded = fields(haystack=token(fold_ascii(text)), name=ascii_token(name), own=distinctive_tokens(name),
                    digits=F.regexp_replace(text, r"(?U)\D", ""), context=context, phone=phone)

    def test(t: Column) -> Column:
        hits = F.size(F.filter(t["own"], lambda w: F.contains(t["haystack"], w)))
        generic = F.contains(t["haystack"], t["name"]) & F.exists(t["context"], lambda w: F.contains(t["haystack"], w))
        named = F.when(F.size(t["own"]) == 0, generic).otherwise(hits >= F.least(F.lit(2), F.size(t["own"])))
        return F.coalesce(F.contains(t["digits"], t["phone"]), F.lit(False)) | F.coalesce(named, F.lit(False))

    return let(folded, test)
