"""Recipes per host, canonical knowledge rows, and their integrity: joins over tables with deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .rank import focus_match, prefix_fill, skip_fill

#: Precedence of recipes.
TIERS = {"local": 4, "user": 3, "community": 2, "seed": 1}


def host_suffixes(host: Column) -> Column:
    """A host and the domains above it: what a suffix match becomes as an equality, so it can be a hash join."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def resolve_recipes(pages: DataFrame, recipes: DataFrame, key: str, url: str) -> DataFrame:
    """key with selector, backend, notes: each field from the best tier that has it; recipes: host, tier, fields."""
    rank = F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv])
    names = pages.select(key, F.explode(host_suffixes(T.host_key(F.col(url)))).alias("host"))
    found = names.join(recipes.withColumn("rank", F.try_element_at(rank, F.col("tier"))), "host")

    def best(field):
        has = F.col(field).isNotNull() & (F.col(field) != "")
        return F.max(F.when(has, F.struct(F.col("rank"), F.length("host").alias("len"), F.col(field).alias("value"))))["value"].alias(field)

    fields = [c for c in recipes.columns if c not in ("host", "tier")]
    return pages.select(key).join(found.groupBy(key).agg(*[best(f) for f in fields]), key, "left")


def match_schema(path: Column, patterns: dict[str, str], default: str | None = None) -> Column:
    """The class of the longest pattern that fits a path: exact, or a prefix that ends in ``*``."""
    out = None
    for pattern, name in sorted(patterns.items(), key=lambda kv: (-len(kv[0]), kv[0])):
        fits = path.startswith(pattern[:-1]) if pattern.endswith("*") else path == pattern
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def merge_maps(site: Column, recipe: Column) -> Column:
    """A site's map under a recipe's, whose keys win."""
    return F.map_concat(F.map_filter(site, lambda k, _: ~F.map_contains_key(recipe, k)), recipe)


def knowledge_id(url: Column, profile: Column, revision: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", T.knowledge_url(url), profile, revision), 256), 1, 16)


def canonical(blocks: DataFrame, page: str, pos: str, text: str, url: str) -> dict[str, DataFrame]:
    """Source, evidence, claim and provenance rows of block rows; ids follow from page and place."""

    def made(kind):
        return F.substring(F.sha2(F.concat_ws(":", F.lit(kind), F.col(page).cast("string"), F.col(pos).cast("string")), 256), 1, 16)

    source = F.substring(F.sha2(F.concat_ws(":", F.lit("source"), F.col(url)), 256), 1, 16)
    rows = blocks.select(
        page, pos, source.alias("source_id"), made("evidence").alias("evidence_id"), made("claim").alias("claim_id"),
        made("provenance").alias("provenance_id"), F.col(text).alias("text"), F.col(url).alias("url"),
    )
    return {
        "source": rows.select("source_id", "url").distinct(),
        "evidence": rows.select("evidence_id", "source_id", page, pos),
        "claim": rows.select("claim_id", "evidence_id", page, pos, "text"),
        "provenance": rows.select("provenance_id", "claim_id", "evidence_id"),
    }


def retain(tables: dict[str, DataFrame], page: str, rank: Column, most: int) -> dict[str, DataFrame]:
    """The ``most`` best claims of each page, and only what they rest on."""
    place = F.row_number().over(Window.partitionBy(page).orderBy(rank, "pos"))
    claims = tables["claim"].withColumn("__place", place).filter(F.col("__place") <= most).drop("__place")
    evidence = tables["evidence"].join(claims.select("evidence_id"), "evidence_id", "left_semi")
    return {
        "claim": claims, "evidence": evidence,
        "provenance": tables["provenance"].join(claims.select("claim_id"), "claim_id", "left_semi"),
        "source": tables["source"].join(evidence.select("source_id"), "source_id", "left_semi"),
    }


def trace(tables: dict[str, DataFrame]) -> DataFrame:
    """Every claim with the first link that is missing on its way to a source, or ``complete``."""
    marked = {
        "evidence": tables["evidence"].select("evidence_id", "source_id", F.lit(True).alias("has_evidence")),
        "source": tables["source"].select("source_id", F.lit(True).alias("has_source")),
        "provenance": tables["provenance"].select("claim_id", F.lit(True).alias("has_provenance")),
    }
    out = (
        tables["claim"].join(marked["evidence"], "evidence_id", "left").join(marked["source"], "source_id", "left")
        .join(marked["provenance"], "claim_id", "left")
    )
    status = (
        F.when(F.col("has_evidence").isNull(), "evidence_missing").when(F.col("has_source").isNull(), "source_missing")
        .when(F.col("has_provenance").isNull(), "provenance_missing").otherwise("complete")
    )
    return out.withColumn("status", status)


# What claims may take of a page's tokens, at least and as a share.
LEAST_CLAIM_TOKENS, CLAIM_SHARE = 8, 4


def focus_share(text: Column, focus: str | None) -> Column:
    """How well a claim answers a focus: 1 if it matches, else the share of the focus's words of three letters it holds."""
    terms = [t for t in (focus or "").replace(",", " ").replace(";", " ").split() if t]
    if not terms:
        return F.lit(0.0)
    low, hits = F.lower(text), F.lit(0)
    for t in terms:
        if len(t) >= 3:
            hits = hits + F.when(low.contains(t.lower()), 1).otherwise(0)
    return F.when(focus_match(text, focus)["matched"], 1.0).otherwise(hits / len(terms))


def retain_within(tables: dict[str, DataFrame], page: str, budget: Column, focus: str | None = None) -> dict[str, DataFrame]:
    """The claims of each page that its share of ``budget`` (a column of the claims) pays for, and what they rest on.

    The best answers come first, then the order of the page. With a focus, a claim too dear is passed over; without one the
    first that is too dear ends it. A null budget keeps everything. All sources stay: they say where a page was read.
    """
    claims = tables["claim"].withColumn("__cap", F.when(budget.isNotNull(), F.greatest(F.lit(LEAST_CLAIM_TOKENS), F.floor(budget / CLAIM_SHARE)).cast("int")))
    cost = F.greatest(F.lit(1), T.token_estimate(F.col("text")))
    ranked = claims.groupBy(page, "__cap").agg(
        F.array_sort(F.collect_list(F.struct((-focus_share(F.col("text"), focus)).alias("less"), F.col("pos").alias("pos"), cost.alias("cost")))).alias("ranked")
    )
    costs = F.transform("ranked", lambda r: r["cost"])
    if (focus or "").strip():
        kept = skip_fill(F.transform("ranked", lambda r: F.struct(r["pos"].alias("pos"), r["cost"].alias("cost"))), F.col("__cap"))
    else:
        kept = F.transform(F.slice("ranked", 1, prefix_fill(costs, F.col("__cap"))["n"]), lambda r: r["pos"])
    every = F.transform("ranked", lambda r: r["pos"])
    places = ranked.select(page, F.explode(F.when(F.col("__cap").isNull(), every).otherwise(kept)).alias("pos"))
    mine = tables["claim"].join(places, [page, "pos"], "left_semi")
    evidence = tables["evidence"].join(mine.select("evidence_id"), "evidence_id", "left_semi")
    return {
        "claim": mine, "evidence": evidence, "source": tables["source"],
        "provenance": tables["provenance"].join(evidence.select("evidence_id"), "evidence_id", "left_semi"),
    }


def integrity_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(finding, id): every claim, evidence or provenance whose reference leads nowhere, and every id that occurs twice.

    References are found missing by anti joins; a null reference leads nowhere too. Empty tables have no findings.
    """
    found = None
    for table, key, ref, other in (
        ("claim", "claim_id", "evidence_id", "evidence"), ("evidence", "evidence_id", "source_id", "source"),
        ("provenance", "provenance_id", "claim_id", "claim"), ("provenance", "provenance_id", "evidence_id", "evidence"),
    ):
        lost = tables[table].join(tables[other].select(ref), ref, "left_anti").select(F.lit(f"{table}_without_{other}").alias("finding"), F.col(key).alias("id"))
        found = lost if found is None else found.unionByName(lost)
    for table in ("source", "evidence", "claim", "provenance"):
        key = f"{table}_id"
        twice = tables[table].groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
        found = found.unionByName(twice.select(F.lit(f"{table}_twice").alias("finding"), F.col(key).alias("id")))
    return found


def retention_report(before: dict[str, DataFrame], after: dict[str, DataFrame], page: str) -> DataFrame:
    """One row a page: claims and terms before and after, the shares kept; a page without claims has none.

    Terms are the different words of a page's claims: they are distinct by page first, so that counting them combines.
    """
    def terms(tables: dict[str, DataFrame], name: str) -> DataFrame:
        words = tables["claim"].select(page, F.explode(F.array_distinct(T.word_tokens(F.col("text")))).alias("term")).distinct()
        sizes = words.groupBy(page).agg(F.count("*").alias(f"terms_{name}"))
        return tables["claim"].groupBy(page).agg(F.count("*").alias(f"claims_{name}")).join(sizes, page, "left")

    both = terms(before, "before").join(terms(after, "after"), page, "left")
    none = F.lit(0).cast("bigint")
    both = both.select(page, *[F.coalesce(F.col(c), none).alias(c) for c in both.columns if c != page])
    share = lambda k: F.round(F.col(f"{k}_after") / F.when(F.col(f"{k}_before") > 0, F.col(f"{k}_before")), 4)
    return both.withColumns({"claims_kept": share("claims"), "terms_kept": share("terms")})
