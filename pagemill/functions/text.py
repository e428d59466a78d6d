"""Text scalars as columns: tokens, token estimates, normal forms, urls. All stay inside the JVM."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases and word groups that results depend on.
SEO_PHRASES = (
    "in this article", "in this guide", "we'll explore", "we will explore",
    "let's dive", "lets dive", "whether you're", "whether you are",
    "click here", "learn more about", "read also", "related posts",
    "table of contents", "disclaimer", "advertiser disclosure",
    "sign up for free", "get started free", "subscribe to our",
    "best practices for", "top 10", "top 5", "ultimate guide",
    "everything you need to know", "frequently asked questions",
    "was this page helpful", "share this article", "follow us on",
)
BOILERPLATE_TERMS = (
    "subscribe", "newsletter", "sign up", "share on", "follow us", "all rights reserved",
    "accept all cookies", "advertisement", "sponsored", "related articles",
    "was this page helpful", "was this helpful", "edit this page", "improve this page", "report an issue",
    "skip to main content", "skip to content", "cookie preferences", "privacy policy",
    "terms of use", "terms of service", "minutes to read", "min read",
    "previous post", "next post", "read more", "continue reading",
    "carbon ads", "ads by carbon", "advertisement from carbon", "ads via carbon",
    "carbonads.net", "help improve mdn", "view this page on github",
    "learn how to contribute", "this page was last modified", "mdn contributors",
    "page was last modified", "report a problem with this content",
)
SYNONYMS = (
    ("config", "configuration", "configure", "configured", "configuring"),
    ("auth", "authentication", "authenticate", "authenticated", "authorization", "authorize"),
    ("login", "signin", "sign-in", "logon"),
    ("database", "databases", "db"),
    ("function", "functions", "fn", "func"),
    ("select", "selection", "selector"),
    ("query", "queries", "queried", "querying"),
    ("syntax", "syntactic"),
    ("token", "tokens", "tokenize", "tokenizer"),
    ("async", "asynchronous", "asynchronously"),
)
#: CJK ideographs, kana and hangul, which count as a token each.
WIDE = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{30FF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}"


def contains_any(text: Column, phrases) -> Column:
    """Whether ``text`` holds one of ``phrases``: byte searches, far faster than one pattern of alternatives."""
    return reduce(operator.or_, [text.contains(p) for p in phrases])


def round_even(value: Column, digits: int) -> Column:
    """A double rounded by what it holds in binary, halves to even: 0.575 lies under its half. (``bround`` goes by its decimals.)"""
    return F.rint(value * 10.0**digits) / 10.0**digits


def round_half(value: Column, digits: int) -> Column:
    """As :func:`round_even`, halves away from zero."""
    return F.round(value * 10.0**digits) / 10.0**digits


def length_of(text: Column, chars: str) -> Column:
    """How many characters of a class ``text`` has."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def token_estimate(text: Column) -> Column:
    """Estimated tokens: a quarter for an ASCII character, one for a wide one, a half for each other UTF-16 unit."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)

    # only what is not ASCII is looked at, and only if it has characters of three bytes or more, letter by letter
    def cost(rest: Column) -> Column:
        full = F.when(F.octet_length(rest) > 2 * F.length(rest), length_of(rest, WIDE + r"\x{10000}-\x{10FFFF}")).otherwise(0)
        return F.ceil((n - F.length(rest)) * 0.25 + full + (F.length(rest) - full) * 0.5)

    mixed = F.element_at(F.transform(F.array(F.regexp_replace(text, r"[\x00-\x7F]+", "")), cost), 1)
    return F.when(F.octet_length(text) == n, F.ceil(n * 0.25)).otherwise(mixed).cast("int")


def bytes_estimate(n: Column) -> Column:
    return F.when(n <= 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(n / 4))).cast("int")


def prefix_within(text: Column, tokens: int) -> Column:
    """Characters of the longest prefix whose token estimate is at most ``tokens``."""
    cost = F.transform(
        F.split(text, ""),
        lambda c: F.when(c.rlike(r"^[\x00-\x7F]$"), 0.25).when(c.rlike(f"^[{WIDE}\\x{{10000}}-\\x{{10FFFF}}]$"), 1.0).otherwise(0.5),
    )
    end = F.aggregate(
        cost,
        F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")),
        lambda acc, c: F.struct((acc["sum"] + c).alias("sum"), F.when(acc["sum"] + c <= tokens, acc["n"] + 1).otherwise(acc["n"]).alias("n")),
    )["n"]
    narrow = length_of(text, r"\x00-\x7F") == F.length(text)
    return F.when(F.coalesce(text, F.lit("")) == "", 0).when(narrow, F.least(F.length(text), F.lit(4 * tokens))).otherwise(end)


def word_tokens(text: Column) -> Column:
    """Lower-case runs of three or more letters or digits of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]{3,})"), 1)


def ascii_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]{3,})"), 1)


def technical_tokens(text: Column) -> Column:
    """Words that may hold dots, dashes and underscores inside."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+(?:[._-][\p{L}\p{N}]+)*)"), 1)


def normal_text(text: Column) -> Column:
    """Lower case, letters, digits and ``_ - .`` kept, any other run one space. (Compatibility forms are not folded.)"""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}_.\-]+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(normal_text(text), r"\s+", "-")


def identity(text: Column) -> Column:
    """An anchor as it is compared: trimmed, without its hash signs, percent-decoded, lower case; a plus stays."""
    bare = F.regexp_replace(F.trim(text), "^#+", "")
    decoded = F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))
    return F.lower(F.coalesce(decoded, bare))


def match_form(text: Column) -> Column:
    """Text without link targets, emphasis and code marks, white space collapsed."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[*_`]+", ""), r"\s+", " "))


def soft_equal(a: Column, b: Column) -> Column:
    """Equal, or the shorter (4 or more) starts the longer, or a common start of 5 or more and 70 % of the shorter."""
    least = F.least(F.length(a), F.length(b))
    stem = F.greatest(F.lit(5), F.ceil(least * 0.7)).cast("int")
    return (
        (a == b)
        | ((least >= 4) & (a.substr(F.lit(1), least) == b.substr(F.lit(1), least)))
        | ((least >= stem) & (a.substr(F.lit(1), stem) == b.substr(F.lit(1), stem)))
    )


def expand_terms(terms: list[str]) -> list[list[str]]:
    """Each term with its synonyms."""
    groups = {w: g for g in SYNONYMS for w in g}
    return [[t, *(w for w in groups.get(t, ()) if w != t)] for t in terms]


LINK = r"\[([^\]]+)\]\([^)]+\)"


def link_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(LINK))


def low_value(text: Column) -> Column:
    """A block of search-engine filler: stock phrases, a question that asks to sign up, links, or repeated words."""
    plain = F.trim(F.coalesce(text, F.lit("")))
    lower = F.lower(plain)
    tokens = word_tokens(plain)
    n = F.size(tokens)
    asks = lower.contains("?") & (n <= 14) & contains_any(lower, ("sign up", "subscribe", "cookie"))
    links = link_count(plain)
    return (
        F.when(plain == "", True)
        .when(F.length(plain) < 24, False)
        .when(contains_any(lower, SEO_PHRASES), True)
        .when(asks, True)
        .when(n < 10, False)
        .when((links >= 3) & (links * 4 >= n), True)
        .otherwise((F.size(F.array_distinct(tokens)) / n < 0.38) & (n >= 28))
    )


def drop_boilerplate_lines(text: Column) -> Column:
    keep = F.filter(
        F.split(text, "\n"), lambda line: (F.trim(line) != "") & ~contains_any(F.lower(line), BOILERPLATE_TERMS)
    )
    return F.array_join(keep, "\n")


def link_dense(text: Column) -> Column:
    links = link_count(text)
    return (links >= 2) & (links * 5 >= F.greatest(F.lit(1), F.size(word_tokens(text))))


def list_shares(text: Column) -> Column:
    """(lines, list lines, list lines with a link) of the lines that are not blank."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    listed = F.filter(lines, lambda x: x.rlike(r"^\s*(?:[-*]|[0-9]+[.)]\s)"))
    return F.struct(
        F.size(lines).alias("lines"), F.size(listed).alias("listed"),
        F.size(F.filter(listed, lambda x: x.rlike(LINK))).alias("linked"),
    )


def section_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: x.startswith("## ") | x.startswith("### ")))


def title_of(markdown: Column) -> Column:
    """The first heading line."""
    return F.nullif(F.trim(F.regexp_extract(markdown, r"(?m)^\s*#+[ \t]*(.*)$", 1)), F.lit(""))


# urls


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_path(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def url_fragment(url: Column) -> Column:
    """The decoded fragment, at most 512 characters; null without one."""
    raw = F.nullif(F.regexp_extract(url, "#(.*)$", 1), F.lit(""))
    return F.substring(F.coalesce(F.try_url_decode(raw), raw), 1, 512)


def cache_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment."""
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:]*:([0-9]+)", 1)
    scheme = url_scheme(url)
    usual = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    full = F.concat(scheme, F.lit("://"), url_host(url), F.when(usual, "").otherwise(F.concat(F.lit(":"), port)), url_path(url), query)
    return F.when(scheme == "", F.trim(url)).otherwise(full)


def knowledge_url(url: Column) -> Column:
    """As a cache url, also without query and closing slashes, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(cache_url(url), r"\?.*$", ""), "/+$", ""))


def host_key(url: Column) -> Column:
    return F.regexp_replace(url_host(url), r"^www\.", "")


def matches_host(host: Column, known: Column) -> Column:
    """The host or one of its subdomains."""
    return (host == known) | host.endswith(F.concat(F.lit("."), known))
