"""Retrieval inside a page: BM25 over its blocks, salience, focus matching, prefix fill under a budget.

A page carries its blocks in one row, so everything here is row-local: document frequencies, lengths and top-k are
taken over an array, and no text is shuffled. Cost is linear in a page's tokens for each query term.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

K1, B = 1.2, 0.75


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def block_scores(blocks: Column, claim: list[str]) -> Column:
    """Array of (score, matched) of the blocks (array of strings) for the distinct terms of a claim.

    A token counts for a term if they are equal or the longer starts with the other of four or more characters; a
    block that holds the term inside a word counts once. Frequencies are of whole tokens.
    """
    # a token akin to a term shares its first three characters, so few tokens of a block need the full test
    starts = sorted({t[:3] for t in claim})

    def part(x):
        low = F.lower(F.coalesce(x, F.lit("")))

        def kept(tokens):
            near = F.filter(tokens, lambda t: F.substring(t, 1, 3).isin(*starts))
            return F.struct(low.alias("low"), F.greatest(F.lit(1), F.size(tokens)).alias("dl"), near.alias("t"))

        return F.element_at(F.transform(F.array(T.ascii_tokens(low)), kept), 1)

    parts = F.transform(blocks, part)
    n = F.size(blocks)

    def rarity(df):
        return F.log(1 + (n - df + 0.5) / (df + 0.5))

    def score(ps, mean_dl, idf):
        def of_block(b):
            total, matched = F.lit(0.0), F.lit(0)
            for k, term in enumerate(claim):
                near = F.size(F.filter(b["t"], _akin(term)))
                tf = F.when((near == 0) & b["low"].contains(term), 1).otherwise(near)
                gain = idf[k] * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * b["dl"] / mean_dl))
                total = total + F.when(tf > 0, gain).otherwise(0.0)
                matched = matched + F.when(tf > 0, 1).otherwise(0)
            return F.struct(total.alias("score"), matched.alias("matched"))

        return F.transform(ps, of_block)

    # bound step by step, so that what belongs to the page is not taken anew for every block
    def with_mean(p):
        mean = _total(F.transform(p, lambda x: x["dl"].cast("double"))) / n
        idf = F.array(*[rarity(F.size(F.filter(p, _holds(t)))) for t in claim])
        bound = F.transform(F.array(F.struct(mean.alias("m"), idf.alias("i"))), lambda s: score(p, s["m"], s["i"]))
        return F.element_at(bound, 1)

    return F.element_at(F.transform(F.array(parts), with_mean), 1)


def _holds(term: str):
    return lambda b: F.array_contains(b["t"], term)


def _akin(term: str):
    def test(t):
        near = (t == term) | ((F.length(t) >= 4) & F.lit(term).startswith(t))
        return near | t.startswith(term) if len(term) >= 4 else near

    return test


def clears_floor(matched: Column, terms: int) -> Column:
    """A match covers 40 % of the claim's terms, one at least."""
    return matched >= max(1, -(-4 * terms // 10))


def salience(scores: Column) -> Column:
    """Each block's score as a share of the best, four digits, halves to even; all 0 if nothing matches."""
    best = F.array_max(F.transform(scores, lambda s: s["score"]))
    return F.transform(scores, lambda s: F.when(best > 0, F.bround(s["score"] / best, 4)).otherwise(0.0))


def top_blocks(scores: Column, k: int) -> Column:
    """The k best (pos, score, matched): score first, then order."""
    ranked = F.array_sort(
        F.transform(scores, lambda s, i: F.struct((-s["score"]).alias("minus"), i.alias("pos"), s["matched"].alias("matched")))
    )
    return F.slice(ranked, 1, max(1, min(10, k)))


def focus_match(text: Column, focus: str) -> Column:
    """(matched, score, tier, hits) of a focus query in a text: phrase, ideal, partial or none."""
    import re

    terms = list(dict.fromkeys(w for w in re.findall(r"[^\W_]{3,}", focus.lower())))
    visible = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), T.LINK, "$1"), r"^#+\s*", ""))
    targets = F.array_join(F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\(([^)]+)\)"), 1), " ")
    blob = F.lower(F.trim(F.concat_ws(" ", visible, F.nullif(targets, F.lit("")))))
    groups = T.expand_terms(terms)
    # terms that are softly equal share their first three letters, so only tokens that start with these are taken out
    starts = sorted({w[:3] for g in groups for w in g if re.fullmatch(r"[^\W_]{3}", w[:3])})
    first = "".join(sorted({x[0] for x in starts}))
    near = rf"(?=[{first}])(?<![\p{{L}}\p{{N}}])((?:{'|'.join(starts)})[\p{{L}}\p{{N}}]*)"
    n = len(terms)
    need = max(2, -(-2 * n // 3))

    # bound step by step, so that no text is formed or searched twice
    def told(s: Column) -> Column:
        blank, phrase, hits = s["blank"], s["phrase"], s["hits"]
        tier = (
            F.when(blank, "none").when(phrase, "phrase").when((hits == n) & F.lit(n > 0), "ideal")
            .when((hits >= need) & F.lit(n >= 3), "partial").otherwise("none")
        )
        score = F.when(blank, 0.0).when(phrase, 1.0).otherwise(hits / max(n, 1))
        return F.struct((tier != "none").alias("matched"), score.alias("score"), tier.alias("tier"), hits.alias("hits"))

    def found(low: Column) -> Column:
        tokens = F.array_distinct(F.regexp_extract_all(low, F.lit(near), 1)) if starts else F.array().cast("array<string>")
        hits = _bound(tokens, lambda few: sum((F.when(F.exists(few, _soft_any(g)), 1).otherwise(0) for g in groups), F.lit(0)))
        phrase = low.contains(focus.strip().lower()) if len(focus.strip()) >= 4 else F.lit(False)
        return _bound(F.struct((visible == "").alias("blank"), phrase.alias("phrase"), hits.alias("hits")), told)

    return _bound(blob, found)


def _bound(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _soft_any(group: list[str]):
    def test(t):
        out = T.soft_equal(t, F.lit(group[0]))
        for word in group[1:]:
            out = out | T.soft_equal(t, F.lit(word))
        return out

    return test


def prefix_fill(costs: Column, budget: Column) -> Column:
    """How many leading items fit: filling stops at the first that does not."""
    return F.aggregate(
        costs,
        F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open")),
        lambda acc, c: F.when(
            acc["open"] & (acc["used"] + c <= budget),
            F.struct((acc["used"] + c).alias("used"), (acc["n"] + 1).alias("n"), F.lit(True).alias("open")),
        ).otherwise(F.struct(acc["used"].alias("used"), acc["n"].alias("n"), F.lit(False).alias("open"))),
    )


def skip_fill(ranked: Column, budget: Column) -> Column:
    """Positions of (pos, cost) items, best first, that fit; an item too large is skipped, later ones may fit."""
    kept = F.aggregate(
        ranked,
        F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("kept")),
        lambda acc, x: F.when(
            acc["used"] + x["cost"] <= budget,
            F.struct((acc["used"] + x["cost"]).alias("used"), F.concat(acc["kept"], F.array(x["pos"])).alias("kept")),
        ).otherwise(acc),
    )
    return F.array_sort(kept["kept"])


def markdown_cap(tokens: Column, structured: Column, receipt: Column) -> Column:
    """(cap, pool, floor): text keeps at least half of the pool, sidecars take what they need of the rest."""
    pool = F.greatest(F.lit(128), tokens - F.when(receipt, 48).otherwise(0))
    floor = F.greatest(F.lit(128), F.floor(pool / 2))
    cap = F.greatest(floor, pool - F.least(structured, pool - floor))
    return F.struct(cap.cast("int").alias("cap"), pool.cast("int").alias("pool"), floor.cast("int").alias("floor"))
