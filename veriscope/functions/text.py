"""Column expressions over message texts, urls and names. White space is what Python's str.split() breaks at."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)[\s\x1c-\x1f]+"
NO_SPACE = r"(?U)[^\s\x1c-\x1f]"
#: The characters of SPACES.
SPACE_CHARS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
MAX_CHARS = 5000
#: Query parameters that only track (fixed values).
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sender_hash(sender: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(sender, F.lit("anonymous")), 256), 1, 16)


def text_length(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit("")))


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), ""))


def has_urls(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("http[s]?://[a-z$-_!]")


def has_mentions(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"(?U)[@#]\w")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def content_hash(text: Column) -> Column:
    return F.sha2(collapse(F.coalesce(text, F.lit(""))), 256)


def strip_html(text: Column) -> Column:
    return collapse(F.regexp_replace(text, "<[^>]+>", " "))


def unwrap_list(text: Column) -> Column:
    """The string inside a list literal of one string, its quote unescaped, trimmed; other texts trimmed."""
    t = F.trim(text)
    inner = F.substring(t, F.lit(3), F.length(t) - 4)
    one = F.when(t.startswith("['") & t.endswith("']"), F.replace(inner, F.lit("\\'"), F.lit("'")))
    two = F.when(t.startswith('["') & t.endswith('"]'), F.replace(inner, F.lit('\\"'), F.lit('"')))
    return F.trim(F.coalesce(one, two, t))


def candidate_text(title: Column, snippet: Column) -> Column:
    t, s = F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit(""))
    joined = F.btrim(F.concat(t, F.lit("\n\n"), s), F.lit(SPACE_CHARS))
    return F.substring(F.when(t != "", joined).otherwise(s), 1, MAX_CHARS)


def tokens(text: Column, min_length: int = 4) -> Column:
    """Lower-cased words reduced to letters, digits, @ and #; links go, and short words unless they are tags."""
    clean = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACES), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}@#]", ""))
    return F.filter(clean, lambda w: (w != "") & ~w.startswith("http") & ((F.length(w) >= min_length) | w.rlike("^[@#]")))


_URL = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(F.trim(url), _URL, 2), r":\d*$", ""))


def normalise_url(url: Column) -> Column:
    """Canonical form: scheme in lower case (https if missing), path / if empty, no fragment, no parameters of the last
    segment, no tracking or blank query parameters; repeated keys together in first-seen order, encoded anew."""
    u = F.trim(F.coalesce(url, F.lit("")))
    part = lambda k: F.regexp_extract(u, _URL, k)
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    again = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    pairs = F.filter(
        F.transform(F.split(part(4), "&"), lambda kv: F.struct(plain(F.substring_index(kv, "=", 1)).alias("k"), plain(F.regexp_extract(kv, "^[^=]*=(.*)$", 1)).alias("v"))),
        lambda p: (p["v"] != "") & ~F.lower(p["k"]).isin(*TRACKING),
    )
    grouped = let(pairs, lambda ps: F.flatten(F.transform(F.array_distinct(F.transform(ps, lambda p: p["k"])), lambda k: F.filter(ps, lambda p: p["k"] == k))))
    query = F.array_join(F.transform(grouped, lambda p: F.concat(again(p["k"]), F.lit("="), again(p["v"]))), "&")
    path = F.regexp_replace(part(3), ";[^/]*$", "")
    rooted = F.when(path == "", F.lit("/")).otherwise(path)
    scheme = F.when(part(1) == "", F.lit("https")).otherwise(F.lower(part(1)))
    head = F.when((part(2) == "") & ~rooted.startswith("/"), F.concat(scheme, F.lit(":"), rooted)).otherwise(F.concat(scheme, F.lit("://"), part(2), rooted))
    return F.when(u == "", F.lit("")).otherwise(F.concat(head, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))
