"""Person names: validation, first names, variants, and the addresses they suggest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.text import BUSINESS_WORDS, NOT_NAME_WORDS, fields, fold_ascii, let, squeeze, token

# Titles before and credentials after a name, and names people rarely go by.
HONORIFICS = ("dr", "mr", "mrs", "ms", "miss", "prof", "sir", "mx", "eng", "engr")
CREDENTIALS = ("jr", "sr", "ii", "iii", "iv", "md", "dds", "dmd", "bds", "mbbs", "phd", "esq", "cpa", "msc", "bsc",
               "ms", "rdh", "fcps", "mds", "mph")
PREFIX_NAMES = ("muhammad", "mohammad", "mohammed", "muhammed", "mohamed", "muhamad", "mohd", "md", "syed", "sayyid",
                "sayed", "hafiz", "qari", "mian", "malik", "raja", "sheikh", "shaikh", "ch", "chaudhry", "chaudhary",
                "choudhry", "khawaja", "mir", "sardar", "sahibzada", "maulana")
ALTERNATE_NAME_WEIGHT, PREFIX_NAME_WEIGHT = 0.6, 0.3
# Fixed values: (label, template, confidence for a pure guess), most to least common.
EMAIL_PATTERNS = (
    ("first", "{first}", 0.30), ("first.last", "{first}.{last}", 0.30), ("flast", "{f}{last}", 0.20), ("firstlast", "{first}{last}", 0.15),
    ("f.last", "{f}.{last}", 0.10), ("first_last", "{first}_{last}", 0.10), ("last", "{last}", 0.05), ("first-last", "{first}-{last}", 0.05),
    ("firstl", "{first}{l}", 0.05), ("dr.last", "dr.{last}", 0.04), ("last.first", "{last}.{first}", 0.04), ("drlast", "dr{last}", 0.03),
    ("dr.first", "dr.{first}", 0.03), ("first.l", "{first}.{l}", 0.03), ("lastfirst", "{last}{first}", 0.03), ("lastf", "{last}{f}", 0.03),
    ("f_last", "{f}_{last}", 0.03), ("f-last", "{f}-{last}", 0.02), ("last_first", "{last}_{first}", 0.02), ("drfirst", "dr{first}", 0.02),
    ("fl", "{f}{l}", 0.01),
)


def _in(value: Column, words) -> Column:
    return value.isin(*words)


def _count_from(items: Column, start: Column, test) -> Column:
    """How many items from ``start`` on pass the test without a break."""
    rest = F.slice(items, start + 1, F.greatest(F.size(items) - start, F.lit(0)))
    stops = F.filter(F.transform(rest, lambda x, i: F.when(~test(x), i)), lambda i: i.isNotNull())
    return F.coalesce(F.get(stops, 0), F.size(rest))


def clean_name(raw: Column) -> Column:
    """struct(name, first_name, last_name, person_key) of a plausible person name, else NULL.

    Titles and other non-name words around it are dropped, and leading initials; a possessive inside,
    or any word that belongs to a business, means it is not a person.
    """
    spaced = squeeze(F.replace(F.replace(raw, F.lit("’"), F.lit("'")), F.lit(","), F.lit(" ")))
    # words and their ASCII tokens, in step (the separator survives folding, no word contains it)
    words = F.split(F.replace(spaced, F.lit(" "), F.lit("\n")), "\n")
    folded = F.split(fold_ascii(F.replace(spaced, F.lit(" "), F.lit("\n"))), "\n")
    pairs = F.transform(F.arrays_zip(words.alias("w"), folded.alias("f")), lambda z: fields(w=z["w"], k=token(z["f"]), low=F.rtrim(F.lower(z["w"]), F.lit("."))))

    def not_name(p: Column) -> Column:
        return _in(p["k"], NOT_NAME_WORDS)

    def trimmed(ps: Column) -> Column:
        last = F.element_at(ps, -1)
        owned = F.lower(last["w"]).endswith("'s")
        inner = F.exists(F.slice(ps, 1, F.size(ps) - 1), lambda p: F.lower(p["w"]).endswith("'s"))
        bare = fields(w=F.left(last["w"], F.length(last["w"]) - 2), k=F.regexp_replace(last["k"], "s$", ""), low=F.regexp_replace(last["low"], "'s$", ""))
        own = F.when(owned, F.concat(F.slice(ps, 1, F.size(ps) - 1), F.array(bare))).otherwise(ps)
        return F.when(~inner, own)

    def without_tail(ps: Column) -> Column:
        tail = _count_from(F.reverse(ps), F.lit(0), lambda p: _in(p["k"], CREDENTIALS + NOT_NAME_WORDS))
        return F.slice(ps, 1, F.size(ps) - tail)

    def without_head(ps: Column) -> Column:
        head = _count_from(ps, F.lit(0), lambda p: _in(p["low"], HONORIFICS) | not_name(p))
        titled = F.exists(F.slice(ps, 1, head), lambda p: _in(p["low"], HONORIFICS))
        return fields(ps=F.slice(ps, head + 1, F.greatest(F.size(ps) - head, F.lit(0))), least=F.when(titled, 1).otherwise(2))

    def without_initials(h: Column) -> Column:
        initials = _count_from(h["ps"], F.lit(0), lambda p: p["w"].rlike(r"^[A-Z]\.?$"))
        drop = F.least(initials, F.greatest(F.size(h["ps"]) - h["least"], F.lit(0)))
        return fields(ps=F.slice(h["ps"], drop + 1, F.size(h["ps"]) - drop), least=h["least"])

    def checked(h: Column) -> Column:
        ps = h["ps"]
        bad = F.exists(ps, lambda p: (p["k"] == "") | not_name(p) | _in(p["k"], BUSINESS_WORDS))
        several = F.size(ps) > 1
        given = F.when((F.size(ps) > 2) & _in(ps[0]["k"], PREFIX_NAMES), F.get(ps, 1)).otherwise(F.get(ps, 0))
        last = F.element_at(ps, -1)
        key = F.concat(given["k"], F.lit("|"), F.when(several, last["k"]).otherwise(""))
        name = fields(name=F.left(F.array_join(F.transform(ps, lambda p: p["w"]), " "), F.lit(255)), first_name=F.left(given["w"], F.lit(120)),
                      last_name=F.when(several, F.left(last["w"], F.lit(120))), person_key=key)
        return F.when((F.size(ps) >= h["least"]) & ~bad, name)

    def non_empty(ps: Column, body) -> Column:
        return F.when(F.size(ps) > 0, let(ps, body))

    return let(let(pairs, trimmed), lambda a: non_empty(a, lambda ps: let(without_tail(ps), lambda b: non_empty(
        b, lambda qs: let(let(without_head(qs), without_initials), lambda h: F.when(F.size(h["ps"]) > 0, checked(h)))))))


def name_variants(name: Column) -> Column:
    """struct(givens, lasts): arrays of (token, weight) a name may appear under in an address."""
    plain = F.replace(F.coalesce(name, F.lit("")), F.lit("’"), F.lit("'"))
    folded = F.split(F.replace(squeeze(fold_ascii(plain)), F.lit(" "), F.lit("\n")), "\n")
    words = F.filter(folded, lambda w: (w != "") & ~_in(F.rtrim(w, F.lit(".")), HONORIFICS) & ~w.rlike(r"^[a-z]\.?$"))
    weight = lambda t, w: fields(token=t, weight=F.lit(w))
    none = F.array().cast("array<struct<token:string,weight:double>>")

    def first_of_each(items: Column) -> Column:
        return let(F.filter(items, lambda x: x["token"] != ""), lambda kept: let(F.transform(kept, lambda x: x["token"]), lambda ts: F.filter(
            kept, lambda x, i: F.array_position(ts, x["token"]) == i + 1)))

    def built(w: Column) -> Column:
        keys, n = F.transform(w, lambda x: token(x)), F.size(w)
        return let(fields(w=w, k=keys, n=n), variants)

    def variants(p: Column) -> Column:
        k, n = p["k"], p["n"]
        prefixed = (n > 1) & _in(F.get(k, 0), PREFIX_NAMES)
        middle = F.slice(k, 2, F.greatest(n - 2, F.lit(0)))
        later = F.slice(k, 3, F.greatest(n - 3, F.lit(0)))
        alternates = F.transform(middle, lambda t: fields(token=t, weight=F.when(_in(t, PREFIX_NAMES), PREFIX_NAME_WEIGHT).otherwise(ALTERNATE_NAME_WEIGHT)))
        after_prefix = F.concat(F.array(weight(F.get(k, 1), 1.0)), F.transform(later, lambda t: weight(t, ALTERNATE_NAME_WEIGHT)),
                                F.array(weight(F.get(k, 0), PREFIX_NAME_WEIGHT)))
        givens = F.when(prefixed, after_prefix).otherwise(F.concat(F.array(weight(F.get(k, 0), 1.0)), alternates))
        surname = F.element_at(p["w"], -1)
        parts = F.transform(F.split(surname, "[-']"), lambda x: token(x))
        lasts = F.concat(F.array(weight(F.element_at(k, -1), 1.0)),
                         F.when(F.size(parts) > 1, F.transform(parts, lambda t: weight(t, ALTERNATE_NAME_WEIGHT))).otherwise(none))
        return fields(givens=F.when(n > 0, first_of_each(givens)).otherwise(none), lasts=F.when(n > 1, first_of_each(lasts)).otherwise(none))

    return let(words, built)


def patterns() -> Column:
    """The address patterns as an array, in order."""
    return F.array(*[F.struct(F.lit(i).alias("no"), F.lit(label).alias("label"), F.lit(shape).alias("shape"), F.lit(base).alias("base"),
                              F.lit("{last}" in shape or "{l}" in shape).alias("needs_last")) for i, (label, shape, base) in enumerate(EMAIL_PATTERNS)])
