"""Language identification by fusing evidence the Bayesian way.

For each candidate language the log posterior adds up: the text's likelihood under character trigrams; the likelihood
of the declared language; that of the address suffix; and a prior of the host. Declared languages, suffixes and hosts
get their figures from one grouped count over all rows of (host, declared, suffix, language by text alone). A host's
prior is smoothed towards its domain's, that towards the prior of all rows, so a host with few rows says little.

Only the trigram tables are fitted on a sample: ``SAMPLE_ROWS`` rows a language, about, with a declared language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, read_table, whole_row

LANGUAGES = ("de", "en", "es", "fr")
#: Rows of the training sample for each language, about.
SAMPLE_ROWS = 2000
#: Trigrams of bytes are hashed to as many buckets.
BUCKETS = 1 << 16
#: A text counts as this many independent trigrams at most: neighbours overlap, so more would be overconfident.
EFFECTIVE_TRIGRAMS = 48
#: Rows that a smoothed prior weighs as much as.
HOST_ROWS, DOMAIN_ROWS = 20.0, 100.0
#: Pseudo-rows of a declared language or suffix that was not seen with a language.
PSEUDO_ROWS = 1.0
#: Least posterior of an accepted language.
MIN_POSTERIOR = 0.5
#: A text is in none of the languages if its mean log likelihood of a trigram stands closer to that of random bytes than to
#: that of the language's own sample, by this share of the way.
MIN_LIKENESS = 0.28
#: Shares of a trigram's probability that come from the trigrams of all languages and from any bytes. As they do not
#: depend on the size of the sample, nor do the likelihoods: the floor acts alike whatever was fitted.
OF_ALL, OF_BYTES = 0.05, 0.05
#: Texts are counted in pieces of so many characters, about: they are cut between words, so no trigram is lost.
PIECE = 1 << 20

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def _pieces(text: str | None) -> Iterator[np.ndarray]:
    """Hashed byte trigrams of the letters of a text, words set apart by one space."""
    text = text or ""
    end, tail = 0, b" "
    while end < len(text):
        at, edge = end, _NOT_LETTERS.search(text, end + PIECE)
        end = edge.start() if edge else len(text)
        letters = _NOT_LETTERS.sub(" ", text[at:end].lower()).strip()
        if letters:
            stream = tail + letters.encode("utf-8", "surrogatepass") + b" "
            tail = stream[-2:]
            b = np.frombuffer(stream, dtype=np.uint8).astype(np.uint32)
            code = b[:-2] * np.uint32(65536) + b[1:-1] * np.uint32(256) + b[2:]
            yield (code * np.uint32(2654435761)) >> np.uint32(16)


def _primary(tag: Column) -> Column:
    """The primary subtag of a language tag; null if it has none of two or three letters, so there are few values."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(tag)), "^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit(""))


def fit_trigrams(
    df: DataFrame, text: Column, declared: Column, languages: Sequence[str], seed: int = 3
) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities (language, bucket) from about ``SAMPLE_ROWS`` declared rows a language, and each one's floor.

    The floor is the least mean log likelihood of a text of that language, see ``MIN_LIKENESS``.
    """
    own = df.select(text.alias("text"), _primary(declared).alias("declared")).filter(F.col("declared").isin(*languages))
    n = {r["declared"]: r["n"] for r in own.groupBy("declared").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for language, rows in n.items():
        share = F.when(F.col("declared") == language, min(1.0, SAMPLE_ROWS / rows)).otherwise(share)
    place = {language: k for k, language in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.zeros((len(languages), BUCKETS), dtype=np.int64)
            for text, language in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for grams in _pieces(text.as_py()):
                    table[place[language]] += np.bincount(grams, minlength=BUCKETS)
            language, bucket = np.nonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array(language.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(table[language, bucket])],
                names=["language", "bucket", "n"],
            )

    sums = (
        own.filter(F.rand(seed) < share).mapInArrow(count, "language int, bucket int, n bigint")
        .groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )  # fmt: skip  # at most languages x BUCKETS rows
    table = np.zeros((len(languages), BUCKETS))
    table[sums["language"], sums["bucket"]] = sums["n"]
    any_bytes = np.full(BUCKETS, 1 / BUCKETS)
    every = table.sum(axis=0) / table.sum() if table.any() else any_bytes
    rows = table.sum(axis=1, keepdims=True)
    seen = np.where(rows > 0, table / np.maximum(rows, 1), any_bytes)
    log_p = np.log((1 - OF_ALL - OF_BYTES) * seen + OF_ALL * every + OF_BYTES * any_bytes)
    own = (seen * log_p).sum(axis=1)
    return log_p.astype(np.float32), MIN_LIKENESS * own + (1 - MIN_LIKENESS) * np.log(1 / BUCKETS)


def score_text(df: DataFrame, table: np.ndarray, text_col: str = "__text") -> DataFrame:
    """``df`` without ``text_col`` and with ``__mean`` (log likelihood of a trigram by language) and ``__grams``."""
    shared = df.sparkSession.sparkContext.broadcast(table)
    kept = [c for c in df.columns if c != text_col]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_p = np.ascontiguousarray(shared.value.T)
        for batch in batches:
            means, sizes = [], []
            for text in batch.column(batch.schema.get_field_index(text_col)):
                total, n = np.zeros(log_p.shape[1]), 0
                for grams in _pieces(text.as_py()):
                    total += log_p[grams].sum(axis=0, dtype=np.float64)
                    n += len(grams)
                means.append((total / max(n, 1)).tolist())
                sizes.append(n)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(batch.schema.get_field_index(c)) for c in kept],
                    pa.array(means, pa.list_(pa.float64())), pa.array(sizes, pa.int64()),
                ],
                names=[*kept, "__mean", "__grams"],
            )

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    return df.mapInArrow(score, schema + (", " if kept else "") + "__mean array<double>, __grams bigint")


def _best(values: Column) -> Column:
    """Place of the greatest value, from 0; the first of equals."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def _domain(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def _shares(counts: DataFrame, key: str, languages: Sequence[str]) -> DataFrame:
    """key to the log of P(key | language) for each language, for a key of few values."""
    n = len(languages)
    known = counts.filter(F.col(key).isNotNull())
    of = [F.sum(F.when(F.col("language") == k, F.col("n")).otherwise(0)) for k in range(n)]
    totals = known.agg(F.array(*[F.coalesce(x, F.lit(0)) for x in of]).alias("total"), F.countDistinct(key).alias("kinds"))
    return known.groupBy(key).agg(F.array(*of).alias("own")).crossJoin(F.broadcast(totals)).select(
        key,
        F.zip_with(
            "own", "total", lambda a, t: F.log((a + PSEUDO_ROWS) / (t + PSEUDO_ROWS * (F.col("kinds") + 1)))
        ).alias(f"by_{key}"),
    )


def host_priors(counts: DataFrame, languages: Sequence[str]) -> DataFrame:
    """host to its smoothed prior: host towards domain, domain towards all rows."""
    of = [F.sum(F.when(F.col("language") == k, F.col("n")).otherwise(0)).cast("double") for k in range(len(languages))]
    every = counts.agg(F.array(*[F.coalesce(x, F.lit(0.0)) for x in of]).alias("every"))
    hosts = counts.filter("host is not null").groupBy("host").agg(F.array(*of).alias("own"))
    domains = (
        hosts.groupBy(_domain(F.col("host")).alias("domain"))
        .agg(F.array(*[F.sum(F.col("own")[k]) for k in range(len(languages))]).alias("wide"))
    )

    def total(x):
        return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)

    def smooth(own, towards, rows):
        return F.zip_with(own, towards, lambda a, p: (a + rows * p) / (total(own) + rows))

    return (
        hosts.withColumn("domain", _domain(F.col("host"))).join(domains, "domain").crossJoin(F.broadcast(every))
        .withColumn("prior", F.transform("every", lambda v: (v + 1) / (total(F.col("every")) + len(languages))))
        .withColumn("prior", smooth(F.col("wide"), F.col("prior"), DOMAIN_ROWS))
        .select("host", smooth(F.col("own"), F.col("prior"), HOST_ROWS).alias("prior"))
    )


def fuse(
    df: DataFrame, text: Column, declared: Column, suffix: Column, host: Column,
    languages: Sequence[str] = LANGUAGES, carry: Column | None = None,
) -> DataFrame:
    """``carry`` (default: the whole row) as ``__row`` with language, posterior, text_language and accepted.

    A null or unknown declared language or suffix and a null host are no evidence. A text without letters, null or
    empty, has no language: null, posterior 0, not accepted. Ties go to the first language of ``languages``. Rows are
    judged one by one, repeated ones alike. An empty frame gives an empty one. Texts are read whole.
    """
    n = len(languages)
    table, floors = fit_trigrams(df, text, declared, languages)
    lean = df.select(
        text.alias("__text"), _primary(declared).alias("declared"), _primary(suffix).alias("suffix"), host.alias("host")
    )
    counts = materialize(
        score_text(lean, table).filter("__grams > 0")
        .groupBy("host", "declared", "suffix", _best(F.col("__mean")).alias("language")).agg(F.count("*").alias("n")),
        "evidence",
    )
    evidence = score_text(
        df.select(
            (whole_row(df) if carry is None else carry).alias("__row"), text.alias("__text"), _primary(declared).alias("declared"),
            _primary(suffix).alias("suffix"), host.alias("host"),
        ),
        table,
    )
    none = F.array(*[F.lit(0.0)] * n)
    # primary subtags have at most three letters, so these two tables have under 20,000 rows
    # the priors are written first: Spark broadcasts them while they are few, else it can split a hot host over tasks
    joined = (
        evidence.join(F.broadcast(_shares(counts, "declared", languages)), "declared", "left")
        .join(F.broadcast(_shares(counts, "suffix", languages)), "suffix", "left")
        .join(materialize(host_priors(counts, languages), "priors"), "host", "left")
    )
    flat = F.array(*[F.lit(1.0 / n)] * n)
    weight = F.least(F.col("__grams"), F.lit(EFFECTIVE_TRIGRAMS))
    score = F.transform("__mean", lambda m: m * weight)
    for part in (F.coalesce("by_declared", none), F.coalesce("by_suffix", none), F.transform(F.coalesce("prior", flat), lambda p: F.log(p))):
        score = F.zip_with(score, part, lambda a, b: a + b)
    spoken = F.col("__grams") > 0
    names = F.array(*[F.lit(x) for x in languages])
    out = joined.withColumn("__score", score).withColumn("__place", _best(F.col("__score")))
    posterior = 1 / F.aggregate(
        "__score", F.lit(0.0), lambda a, v: a + F.exp(v - F.array_max(F.col("__score")))
    )
    out = out.withColumns({
        "language": F.when(spoken, F.element_at(names, F.col("__place") + 1)),
        "posterior": F.when(spoken, posterior).otherwise(0.0),
        "text_language": F.when(spoken, F.element_at(names, _best(F.col("__mean")) + 1)),
    })
    floor = F.element_at(F.array(*[F.lit(float(x)) for x in floors]), F.col("__place") + 1)
    likely = F.element_at("__mean", F.col("__place") + 1) >= floor
    accepted = spoken & (F.col("posterior") >= MIN_POSTERIOR) & likely
    return out.select("__row", "language", "posterior", "text_language", accepted.alias("accepted"))


def identify_documents(df: DataFrame, languages: Sequence[str] = LANGUAGES, carry: Column | None = None) -> DataFrame:
    """``fuse`` for documents: ``lang`` is what they declare, ``source`` the host; they have no address."""
    return fuse(df, F.col("text"), F.col("lang"), F.lit(None).cast("string"), F.col("source"), languages, carry)


def keep_identified(df: DataFrame) -> DataFrame:
    """The documents with an accepted language, with all their columns as they were."""
    return identify_documents(df).filter("accepted").select("__row.*")


def op9_evidence_language_id(spark, sf_dir):
    """Every document with its language, posterior and verdict."""
    found = identify_documents(read_table(spark, sf_dir, "documents"), carry=F.col("doc_id"))
    return found.select(
        F.col("__row").alias("doc_id"), "language", F.round("posterior", 6).alias("posterior"), "text_language", "accepted"
    )


def page_languages(spark, sf_dir):
    """Every page: text of its markup, declared ``lang``, language part of its address, host."""
    pages = read_table(spark, sf_dir, "pages")
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), "<[^>]*>", " ")
    declared = F.nullif(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1), F.lit(""))
    host = F.lower(F.regexp_extract(url, "://([^/?#]*)", 1))
    in_path = F.regexp_extract(url, "://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1)
    top = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    suffix = F.coalesce(F.nullif(in_path, F.lit("")), F.nullif(top, F.lit("")))
    lean = pages.select("page_id", text.alias("text"), declared.alias("declared"), suffix.alias("suffix"), F.nullif(host, F.lit("")).alias("host"))
    out = fuse(lean, F.col("text"), F.col("declared"), F.col("suffix"), F.col("host"), carry=F.struct("page_id", "declared", "suffix"))
    return out.select(
        "__row.page_id", "language", F.round("posterior", 6).alias("posterior"), "text_language",
        F.col("__row.declared").alias("declared"), F.col("__row.suffix").alias("suffix"), "accepted",
    )
