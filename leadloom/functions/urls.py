"""Web addresses: normal forms, identities, hosts, and e-mail addresses in text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.functions.text import FOREIGN, fields, let, normalize_text

# E-mail pattern, tracking parameters, free mail hosts, local parts that name a role.
EMAIL = r"(?i)\b([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})\b"
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid")
FREE_EMAIL_DOMAINS = ("gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "icloud.com")
ROLE_LOCAL_PARTS = (
    "info", "contact", "admin", "office", "hello", "hi", "support", "sales", "appointments", "appointment",
    "reception", "frontdesk", "booking", "bookings", "enquiries", "enquiry", "inquiries", "inquiry",
    "mail", "team", "billing", "hr", "careers", "service", "services", "care", "help", "dr", "doctor",
    "clinic", "dental", "webmaster", "marketing", "accounts", "noreply", "no-reply", "feedback",
)
PLACE_ID = r"(ChIJ[A-Za-z0-9_-]{10,})"

_SCHEME = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?"
_HOST = r"//(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:@\[\]]*)"
_ALL = (r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?:(//)([^/?#]*@)?(\[[^\]]*\]|[^/?#:@\[\]]*)(?::([^/?#]*))?(?=[/?#]|$))?"
        r"([^?#]*)(?:\?([^#]*))?(?:#.*)?$")
_FIELDS = ("scheme", "slashes", "user", "host", "port", "path", "query")


def url_parts(url: Column) -> Column:
    """The parts of a URL in one pass: struct(scheme, slashes, user, host, port, path, query), '' where absent."""
    joined = F.regexp_replace(url, _ALL, "\u0001".join(f"${i + 1}" for i in range(len(_FIELDS))))
    return let(F.split(joined, "\u0001"), lambda p: fields(**{n: F.get(p, i) for i, n in enumerate(_FIELDS)}))


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def netloc_of(url: Column) -> Column:
    return F.regexp_extract(url, _SCHEME + "//([^/?#]*)", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _SCHEME + "(?://[^/?#]*)?([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)


def hostname(url: Column) -> Column:
    """Lower-case host without user info, port and brackets; '' when there is none."""
    return F.lower(F.translate(F.regexp_extract(url, _SCHEME + _HOST, 1), "[]", ""))


def port_of(url: Column) -> Column:
    """The explicit port as text; '' when none."""
    return F.regexp_extract(url, _SCHEME + _HOST + ":([^/?#]*)", 2)


def _port_ok(port: Column) -> Column:
    return (port == "") | (F.when(port.rlike(r"^\d{1,5}$"), port.cast("int")).otherwise(99999) <= 65535)


def _without_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def _default_port(scheme: Column, port: Column) -> Column:
    number = F.when(port.rlike(r"^\d{1,5}$"), port.cast("int"))
    return (port == "") | (number == 0) | ((scheme == "http") & (number == 80)) | ((scheme == "https") & (number == 443))


def _number(port: Column) -> Column:
    return F.when(port.rlike(r"^\d{1,5}$"), port.cast("int").cast("string"))


def _shown_port(scheme: Column, port: Column) -> Column:
    return F.when(_default_port(scheme, port), "").otherwise(F.concat(F.lit(":"), _number(port)))


def _with_query(query: Column) -> Column:
    return F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")


def normalize_website(value: Column) -> Column:
    """Scheme added, host lower-case without www and default port, no trailing slash or fragment; NULL when unusable."""
    def with_scheme(text: Column) -> Column:
        return (F.when(text.startswith("//"), F.concat(F.lit("https:"), text))
                .when(~text.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"), F.concat(F.lit("https://"), text)).otherwise(text))

    def rebuilt(url: Column) -> Column:
        scheme, port, host = scheme_of(url), port_of(url), F.rtrim(hostname(url), F.lit("."))
        good = (host != "") & scheme.isin("http", "https") & _port_ok(port)
        return F.when(good, F.concat(scheme, F.lit("://"), _without_www(host), _shown_port(scheme, port),
                                     F.rtrim(path_of(url), F.lit("/")), _with_query(query_of(url))))

    return let(let(normalize_text(value), with_scheme), rebuilt)


def normalize_domain(value: Column) -> Column:
    return F.nullif(_without_www(hostname(normalize_website(value))), F.lit(""))


def host_of(value: Column) -> Column:
    """The host of a URL or bare domain; NULL for free mail hosts and names without a dot."""
    text = F.trim(value)
    host = _without_www(hostname(F.when(F.contains(text, F.lit("//")), text).otherwise(F.concat(F.lit("//"), text))))
    return let(host, lambda h: F.when(F.contains(h, F.lit(".")) & ~h.isin(*FREE_EMAIL_DOMAINS), h))


@F.pandas_udf(T.StringType())
def _idna(hosts: pd.Series) -> pd.Series:
    def encode(host):
        try:
            return host.encode("idna").decode("ascii")
        except UnicodeError:
            return ""

    return hosts.map(encode, na_action="ignore")


def _resolve_dots(path: Column) -> Column:
    """Dot segments of an absolute path resolved."""
    empty = F.array().cast("array<string>")

    def keep(acc: Column, s: Column) -> Column:
        return (F.when(s == ".", acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                .otherwise(F.concat(acc, F.array(s))))

    def resolved(segments: Column) -> Column:
        ends = F.element_at(segments, -1).isin(".", "..")
        return let(F.aggregate(segments, empty, keep), lambda kept: F.concat(
            F.lit("/"), F.array_join(kept, "/"), F.when(ends & (F.size(kept) > 0), "/").otherwise("")))

    dotted = F.contains(path, F.lit("/.")) & path.rlike(r"/\.{1,2}(/|$)")
    return F.when(dotted, let(F.split(F.substring(path, 2, 1 << 30), "/"), resolved)).otherwise(path)


def _against(base: Column, link: Column) -> Column:
    """The parts of a link made absolute against the parts of its page's URL."""
    bare = link["slashes"] == ""
    folder = F.when(base["path"] == "", "/").otherwise(F.regexp_extract(base["path"], "(?s)^(.*/)", 1))
    joined = F.when(link["path"].startswith("/"), link["path"]).otherwise(F.concat(folder, link["path"]))
    path = F.when(link["path"] != "", let(joined, _resolve_dots)).otherwise(base["path"])
    query = F.when((link["path"] == "") & (link["query"] == ""), base["query"]).otherwise(link["query"])
    relative = fields(scheme=base["scheme"], slashes=base["slashes"], user=base["user"], host=base["host"], port=base["port"], path=path, query=query)
    same_scheme = fields(scheme=base["scheme"], **{n: link[n] for n in _FIELDS[1:]})
    return F.when(link["scheme"] != "", link).when(~bare, same_scheme).otherwise(relative)


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _encoded(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalized(value: Column, base_parts: Column | None = None) -> Column:
    """struct(url, host, identity) of a web address, absolute against its page; NULL fields when unusable.

    The URL has no www, default port, user info, doubled slashes, fragment or tracking parameters
    and its query is sorted; the identity is its equality key. ``value`` may be an array element.
    Only ASCII hosts are accepted here; normalize_url_idna converts international ones.
    """
    own = url_parts(F.trim(value))
    if base_parts is None:
        return let(own, _rebuild)
    return let(let(fields(b=base_parts, v=own), lambda p: _against(p["b"], p["v"])), _rebuild)


def normalize_url(value: Column, base: Column | None = None) -> Column:
    return normalized(value, None if base is None else url_parts(base))["url"]


def normalize_url_idna(value: Column) -> Column:
    """normalize_url of a plain column, with international host names in their ASCII form."""
    url = F.trim(value)
    converted = _idna(F.when(url.rlike(FOREIGN) & hostname(url).rlike(FOREIGN), hostname(url)))
    return let(fields(url=url, host=converted), lambda p: normalize_url(F.when(p["host"].isNull(), p["url"]).otherwise(
        F.replace(p["url"], F.regexp_extract(p["url"], _SCHEME + _HOST, 1), p["host"]))))


def _own_query(query: Column) -> Column:
    """The query's pairs without tracking parameters, sorted and encoded again."""
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: fields(
        k=_decoded(F.regexp_extract(p, "(?s)^([^=]*)", 1)), v=_decoded(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1))))
    own = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING_KEYS) & ~F.lower(p["k"]).startswith("utm_"))
    return F.array_join(F.transform(F.array_sort(own), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")


def _rebuild(parts: Column) -> Column:
    def shown(p: Column) -> Column:
        scheme, host, port = p["scheme"], p["host"], p["port"]
        # an ASCII name of labels of 1 to 63 characters, or a bracketed address
        named = (host != "") & host.rlike(r"^(?:[^.\x80-\x{10FFFF}]{1,63}\.)*[^.\x80-\x{10FFFF}]{1,63}$")
        good = scheme.isin("http", "https") & named & (p["user"] == "") & _port_ok(port)
        bracketed = F.when(F.contains(host, F.lit(":")), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
        port_text = F.when(port == "", port).otherwise(_shown_port(scheme, port))
        query = _with_query(p["query"])
        same = F.when(port_text.isin(":80", ":443"), "").otherwise(port_text)
        return fields(url=F.when(good, F.concat(scheme, F.lit("://"), bracketed, port_text, p["path"], query)), host=F.when(good, host),
                      identity=F.when(good, F.concat_ws(" ", F.concat(host, same), p["path"], p["query"])))

    host = F.rtrim(F.lower(F.translate(parts["host"], "[]", "")), F.lit("."))
    host = let(host, lambda h: F.when(h.startswith("www."), F.substring(h, 5, 1 << 20)).otherwise(h))
    single = F.when(F.contains(parts["path"], F.lit("//")), F.regexp_replace(parts["path"], "/{2,}", "/")).otherwise(parts["path"])
    path = let(F.rtrim(single, F.lit("/")), lambda x: F.when(x == "", "/").otherwise(x))
    query = F.when(parts["query"] == "", "").otherwise(_own_query(parts["query"]))
    return let(fields(scheme=F.lower(parts["scheme"]), user=parts["user"], host=host, port=parts["port"], path=path, query=query), shown)


def url_identity(normalized: Column) -> Column:
    """Equality key of a normalized URL: authority without www and default ports, path, query."""
    def key(url: Column) -> Column:
        port = port_of(url)
        shown = F.when((port == "") | port.isin("80", "443"), "").otherwise(F.concat(F.lit(":"), port))
        return F.when(url.isNotNull(), F.concat_ws(" ", F.concat(_without_www(hostname(url)), shown), path_of(url), query_of(url)))

    return let(normalized, key)


def page_identity(url: Column) -> Column:
    """Equality key of a page: host without www and lower-case path."""
    path = F.lower(F.rtrim(path_of(url), F.lit("/")))
    return F.concat_ws(" ", _without_www(hostname(url)), F.when(path == "", "/").otherwise(path))


def is_same_site(url: Column, home_host: Column) -> Column:
    """The host equals the home host or is below it."""
    dotted = F.concat(F.lit("."), _without_www(hostname(url)))
    return F.coalesce((home_host != "") & F.endswith(dotted, F.concat(F.lit("."), home_host)), F.lit(False))


def is_public_url(url: Column) -> Column:
    """http(s), no local name, and a literal address only when it is globally routable (no DNS lookup)."""
    return let(fields(scheme=scheme_of(url), host=hostname(url)), lambda u: _is_public(u["scheme"], u["host"]))


def _is_public(scheme: Column, host: Column) -> Column:
    octet = [F.regexp_extract(host, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i).try_cast("int") for i in (1, 2, 3, 4)]
    a, b, c, d = octet
    private = (a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31))
               | ((a == 192) & (b == 168)) | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19))
               | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113)))
    valid = (a <= 255) & (b <= 255) & (c <= 255) & (d <= 255)
    literal4 = a.isNotNull()
    literal6 = F.contains(host, F.lit(":"))
    private6 = host.rlike(r"(?i)^(::1?$|::ffff:|64:ff9b:1:|100::|2001:(0?db8|0{0,3}2:|1[0-9a-f]:)|f[cd]|fe[89ab]|ff)")
    local = (host == "localhost") | host.endswith(".localhost") | host.endswith(".local")
    ok = F.when(literal4, valid & ~private).when(literal6, ~private6).otherwise(F.lit(True))
    return F.coalesce(scheme.isin("http", "https") & (host != "") & ~local & ok, F.lit(False))


def place_id_from_url(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), PLACE_ID, 1), F.lit(""))


def coordinates_from_url(url: Column) -> Column:
    pattern = r"!3d(-?\d+(?:\.\d+)?)!4d(-?\d+(?:\.\d+)?)"
    return F.struct(*[F.regexp_extract(F.coalesce(url, F.lit("")), pattern, i).try_cast("decimal(10,7)").alias(n)
                      for i, n in ((1, "latitude"), (2, "longitude"))])


def extract_emails(text: Column) -> Column:
    """Addresses in a text, lower-case, each once, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(EMAIL)), lambda a: F.lower(a)))


def mailto_address(href: Column) -> Column:
    """The text of a mailto link without its query; NULL for other links."""
    return F.when(F.lower(F.trim(href)).startswith("mailto:"), F.substring_index(F.substring(F.trim(href), 8, 1 << 30), "?", 1))


def is_role_based(address: Column) -> Column:
    """The local part (as it is, or its letters and digits) names a role, not a person."""
    local = F.lower(F.substring_index(address, "@", 1))
    return local.isin(*ROLE_LOCAL_PARTS) | F.regexp_replace(local, "[^a-z0-9]", "").isin(*ROLE_LOCAL_PARTS)


def profile_url(url: Column) -> Column:
    """A personal profile link in its one form, or NULL."""
    slug = F.regexp_extract(F.coalesce(url, F.lit("")), r"linkedin\.com/in/([A-Za-z0-9\-_%.]+)", 1)
    return F.when(slug != "", F.concat(F.lit("https://www.linkedin.com/in/"), slug))
