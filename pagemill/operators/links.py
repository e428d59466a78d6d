"""Which of a page's links answer a question: ranking over the array of its links, and hubs to look into next."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from .rank import B, K1

# Words that name no subject, weights and penalties.
SUPPORTING = frozenset(
    "event events loop loops task tasks cancel cancellation request requests fetch operation operations synchronization "
    "synchronize sync async asynchronous asynchronously stable network identity version versions history change changes "
    "changed howto how safe safely create creating use using get set run running start stop read write call calling handle "
    "handling manage management config configuration configure guide tutorial overview introduction reference docs "
    "documentation api module library page section what when where which with from into about the and for new old".split()
)
STRONG_HIT = 4.0
VERSION_PATH = r"/\d+\.\d+(\.\d+)?(/|$)"
VERSION_ROOT = r"(?i)^(/(docs?|en|en-us|index\.html?|\d+(\.\d+)*)){0,1}/\d+(\.\d+)*(/(docs?|en|en-us|index\.html?))?/?$"


def decompose(query: str) -> dict[str, list[str]]:
    """What a question names (primary) and what it says about it (supporting); quoted phrases as they are."""
    quoted = [q.strip().lower() for q in re.findall(r"[\"']([^\"']{3,})[\"']", query) if len(q.strip()) >= 3]
    shaped = re.findall(r"[^\W_]+(?:[./][^\W_]+)+", query) + re.findall(r"\b[^\W\d_]\w*_\w+\b|\b[A-Z]\w*[A-Z]\w*\b", query)
    primary = list(dict.fromkeys([*quoted, *(s.lower() for s in shaped if len(s) >= 3)]))
    words = list(dict.fromkeys(re.findall(r"[^\W_]{3,}", query.lower())))
    supporting = []
    for w in words:
        if not any(w in p for p in primary):
            (supporting if w in SUPPORTING else primary).append(w)
    return {"primary": primary, "supporting": supporting, "quoted": quoted, "all": words}


def _soft_in(tokens: Column, term: str) -> Column:
    return F.exists(tokens, lambda t: T.soft_equal(t, F.lit(term)))


def link_scores(links: Column, query: str) -> Column:
    """Array of (total, path, title, phrase, supporting, bm25) of an array of links (url, path, title)."""
    parts = decompose(query)
    primary, lower = parts["primary"], query.strip().lower()
    support = parts["supporting"] if primary else parts["all"]
    asked = list(dict.fromkeys([*primary, *parts["supporting"]])) if primary else parts["all"]
    phrases = parts["quoted"] or ([lower] if 3 <= len(lower) <= 48 else [])

    def fields(x):
        path = F.lower(F.translate(x["path"], "/-_.", "    "))
        title = F.lower(F.coalesce(x["title"], F.lit("")))
        body = F.concat_ws(" ", title, title, path, path)
        return F.struct(
            F.lower(x["path"]).alias("raw"), path.alias("path"), title.alias("title"), body.alias("body"), T.word_tokens(body).alias("t"),
            T.word_tokens(path).alias("tp"), T.word_tokens(title).alias("tt"), F.filter(F.split(F.lower(x["path"]), "/"), lambda s: s != "").alias("seg"),
        )

    def score(rows, mean, idf):
        def one(r):
            path, title, soft, hits = F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0)
            for a in primary:
                own = F.exists(r["seg"], _is_segment(a))
                part = r["path"].contains(a) | F.exists(r["seg"], _has_part(a))
                named = r["title"].contains(a)
                akin = _soft_in(r["tt"], a)
                path = path + F.when(own, 12.0).when(part, 9.0).otherwise(0.0)
                title = title + F.when(named, 8.0).otherwise(0.0)
                soft = soft + F.when(~named & akin, 2.0).otherwise(0.0)
                hits = hits + F.when(own | part | named | akin, 1).otherwise(0)
            phrase = F.lit(0.0)
            for p in phrases:
                got = F.when(r["path"].contains(p) | F.exists(r["seg"], _has_part(p)), 10.0).when(r["title"].contains(p), 6.0).otherwise(0.0)
                phrase = F.greatest(phrase, got)
            in_path, in_title, overlap = F.lit(0), F.lit(0), F.lit(0)
            for t in support:
                in_path = in_path + F.when(r["path"].contains(t) | _soft_in(r["tp"], t), 1).otherwise(0)
                in_title = in_title + F.when(r["title"].contains(t) | _soft_in(r["tt"], t), 1).otherwise(0)
            for t in primary or parts["all"]:
                overlap = overlap + F.when(r["body"].contains(t) | _soft_in(r["t"], t), 1).otherwise(0)
            supporting = F.least(F.lit(2.5), (2.0 * in_path + 1.5 * in_title) / max(1, len(support)))
            bm25, dl = F.lit(0.0), F.greatest(F.lit(1), F.size(r["t"]))
            for k, t in enumerate(asked):
                near = F.size(F.filter(r["t"], _soft_to(t)))
                tf = F.when((near == 0) & r["body"].contains(t), 1).otherwise(near)
                bm25 = bm25 + F.when(tf > 0, idf[k] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))).otherwise(0.0)
            bm25 = bm25 * (0.35 if primary else 1.0)
            missing = F.when(hits == 0, 8.0).otherwise(0.0) if primary else F.lit(0.0)
            noisy = r["raw"].rlike(VERSION_PATH) | T.contains_any(r["title"], ("what's new", "whats new", "changelog", "release notes", "release history"))
            root = r["raw"].rlike(VERSION_ROOT)
            excused = F.lit(bool(re.search(r"\d+(\.\d+)+|changelog|release notes|what'?s new|version history", lower))) | (hits > 0)
            version = F.when((noisy | root) & ~excused, F.when(root, 6.0).otherwise(3.0) + (2.0 if primary else 0.0)).otherwise(0.0)
            total = path + title + soft + phrase + supporting + bm25 + 2.0 * overlap / max(1, len(primary or parts["all"])) - missing - version
            return F.struct(
                total.alias("total"), path.alias("path"), title.alias("title"), phrase.alias("phrase"), supporting.alias("supporting"), bm25.alias("bm25")
            )

        return F.transform(rows, one)

    rows = F.transform(links, fields)

    def bound(r):
        mean = F.aggregate(r, F.lit(0.0), lambda a, x: a + F.greatest(F.lit(1), F.size(x["t"]))) / F.greatest(F.lit(1), F.size(r))
        df = [F.size(_with_term(r, t)) for t in asked]
        idf = F.array(*[F.log(1 + (F.size(r) - d + 0.5) / (d + 0.5)) for d in df]) if asked else F.array().cast("array<double>")
        page = F.array(F.struct(mean.alias("m"), idf.alias("i")))
        return F.element_at(F.transform(page, lambda s: score(r, s["m"], s["i"])), 1)

    return F.element_at(F.transform(F.array(rows), bound), 1)


def _with_term(rows: Column, term: str) -> Column:
    return F.filter(rows, lambda r: F.array_contains(r["t"], term))


def _is_segment(anchor: str):
    return lambda s: (s == anchor) | (F.regexp_replace(s, r"\.[a-z]+$", "") == anchor)


def _has_part(text: str):
    return lambda s: s.contains(text)


def _soft_to(term: str):
    return lambda t: T.soft_equal(t, F.lit(term))


def hub_priority(path: Column) -> Column:
    """How likely a link leads to more links: null for a leaf."""
    p = F.lower(path)
    last = F.element_at(F.split(F.regexp_replace(p, "/+$", ""), "/"), -1)
    root = ~last.contains(".") | last.startswith("index.")
    hub = p.endswith("/") | p.rlike(r"/index\.html?$") | (root & T.contains_any(p, ("/library", "/reference", "/docs", "/api", "/guide")))
    score = (
        F.when(p.contains("/library"), 5).otherwise(0) + F.when(p.contains("/reference"), 4).otherwise(0)
        + F.when(p.contains("/docs"), 3).otherwise(0) + F.when(p.endswith("/") | p.contains("index"), 2).otherwise(0)
    )
    return F.when(hub, score)
