"""Analytics over logs of attempts: hosts, jobs, caches, latencies, classes, trends."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify as C
from ..operators import ordered as O
from ..operators import receipts as R
from ..registry import query, table
from .classify import FAILURE_SQL, attempts

_OK = "event_type <> 'error'"
_CLOSED = ", ".join(f"'{c}'" for c in C.CLOSURES)
ATLAS_SQL = FAILURE_SQL + f""",
ax AS (SELECT user_id % 40 AS host, CASE WHEN {_OK} AND user_id % 40 > 2 THEN NULL ELSE failure END AS code FROM f JOIN events USING (event_id)),
ac AS (SELECT host, code, count(*) AS n FROM ax GROUP BY host, code),
asum AS (SELECT host, CAST(sum(n) AS BIGINT) AS attempts, CAST(coalesce(sum(n) FILTER (WHERE code IS NULL), 0) AS BIGINT) AS successes, coalesce(sum(n) FILTER (WHERE code IN ({_CLOSED})), 0) AS closures FROM ac GROUP BY host),
ad AS (SELECT host, code AS dominant FROM (SELECT host, code, row_number() OVER (PARTITION BY host ORDER BY n DESC, code) AS k FROM ac WHERE code IS NOT NULL) WHERE k = 1)
"""


@query("failure_atlas", ATLAS_SQL + f"""
SELECT host, attempts, successes, round_even(closures::DOUBLE / attempts, 4) AS closure_rate, dominant, successes = 0 AND attempts > 0 AND coalesce(dominant IN ({_CLOSED}), false) AS walled FROM asum LEFT JOIN ad USING (host)
""")
def failure_atlas(spark, sf_dir):
    """Per host: attempts, successes, share of closures, most frequent failure, whether it is walled off."""
    return atlas(log(spark, sf_dir), "host", "code")


def log(spark, sf_dir):
    host = F.col("user_id") % 40
    ok = (F.col("event_type") != "error") & (host > 2)
    return attempts(spark, sf_dir).select(host.alias("host"), F.when(~ok, F.col("failure")).alias("code"))


def atlas(df, host: str, code: str):
    """Two aggregations: the first is as small as hosts times codes, so a hot host costs nothing in the second."""
    counts = df.groupBy(host, code).agg(F.count("*").alias("n"))
    failed = F.col(code).isNotNull()
    out = counts.groupBy(host).agg(
        F.sum("n").alias("attempts"), F.sum(F.when(~failed, F.col("n")).otherwise(0)).alias("successes"),
        F.sum(F.when(F.col(code).isin(*C.CLOSURES), F.col("n")).otherwise(0)).alias("closures"),
        F.min(F.when(failed, F.struct((-F.col("n")).alias("minus"), F.col(code).alias("code"))))["code"].alias("dominant"),
    )
    walled = (F.col("successes") == 0) & (F.col("attempts") > 0) & F.coalesce(F.col("dominant").isin(*C.CLOSURES), F.lit(False))
    return out.select(host, "attempts", "successes", T.round_even(F.col("closures") / F.col("attempts"), 4).alias("closure_rate"), "dominant", walled.alias("walled"))


@query("failure_rollup", ATLAS_SQL + "SELECT host, code, CAST(sum(n) AS BIGINT) AS n FROM ac WHERE code IS NOT NULL GROUP BY ROLLUP (host, code)")
def failure_rollup(spark, sf_dir):
    return log(spark, sf_dir).filter("code is not null").rollup("host", "code").agg(F.count("*").alias("n"))


_PCT = "list_sort(list(value))[CAST(least(count(*), floor(count(*) * {p}) + 1) AS INTEGER)]"


#: Events whose values are summed one after the other; the sums of several such parts are added in order.
PART_EVENTS = 1_000_000


@query("run_summary", f"""
SELECT event_type, CAST(floor(user_id / 30) AS BIGINT) AS engine, count(*) AS n, round(avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END), 3) AS ok_rate, {_PCT.format(p=0.5)} AS p50, {_PCT.format(p=0.95)} AS p95, round(avg(value), 1) AS mean
FROM events WHERE value IS NOT NULL GROUP BY 1, 2
""")
def run_summary(spark, sf_dir):
    """Rates and latencies of runs. Percentiles are elements, not interpolations: Spark's histogram of distinct
    values, which combines on the map side, gives the same element. Means are summed in the order of events."""
    df = table(spark, sf_dir, "events").filter("value is not null").withColumn("engine", F.floor(F.col("user_id") / 30))
    keys = ["event_type", "engine"]
    counts = df.groupBy(*keys, "value").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys).orderBy("value")
    total = F.sum("c").over(Window.partitionBy(*keys))
    ranked = counts.withColumns({"upto": F.sum("c").over(w), "total": total})
    at = {p: F.least(F.col("total"), F.floor(F.col("total") * p) + 1) for p in (0.5, 0.95)}
    picked = [F.min(F.when(F.col("upto") >= at[p], F.col("value"))).alias(name) for p, name in ((0.5, "p50"), (0.95, "p95"))]
    out = ranked.groupBy(*keys).agg(*picked)
    rate = T.round_half(F.count_if(F.col("value") > 10) / F.count("*"), 3)
    base = df.groupBy(*keys).agg(F.count("*").alias("n"), rate.alias("ok_rate"))
    parts = df.select(*keys, "event_id", "value", F.floor(F.col("event_id") / PART_EVENTS).alias(O.PART))
    summed = O.sums(parts, keys, ["event_id"], "value", "sum")
    both = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    named = [x.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in x.columns if c not in keys]) for x in (out, summed)]
    for other in named:
        base = base.join(other, both).drop(*[f"__{k}" for k in keys])
    return base.select(*keys, "n", "ok_rate", "p50", "p95", T.round_half(F.col("sum") / F.col("n"), 1).alias("mean"))


@query("engine_latency", f"""
SELECT event_type AS engine, {_PCT.format(p=0.5)} AS p50, {_PCT.format(p=0.95)} AS p95, min(value) AS least, count(*) AS runs FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS run FROM events) WHERE run > 1 AND value > 5 GROUP BY event_type
""")
def engine_latency(spark, sf_dir):
    """Latency of each engine over its successes; every user's first run warms up and does not count.

    Rows are placed by ranges of values, so that no task holds all values of an engine.
    """
    events, keys = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"]
    first = events.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(F.struct("ts", "event_id")).alias("first"))
    same = F.col("user_id").eqNullSafe(F.col("_user_id")) & F.col("event_type").eqNullSafe(F.col("_event_type"))
    df = events.filter("value > 5").join(first, same).filter(F.struct("ts", "event_id") > F.col("first"))
    placed = R.numbered_within(df.select(F.col("event_type").alias("engine"), "value"), "engine", ["value"])
    at = {p: F.least(F.col("__total") - 1, F.floor(F.col("__total") * F.lit(p))) for p in (0.5, 0.95)}
    picked = [F.min(F.when(F.col("__i") == at[p], F.col("value"))).alias(name) for p, name in ((0.5, "p50"), (0.95, "p95"))]
    return placed.groupBy("engine").agg(*picked, F.min("value").alias("least"), F.count("*").alias("runs"))


STRONG = ("verify you are human", "checking your browser", "access denied")
WEAK = ("captcha", "forbidden", "too many requests")


def outcome_class(expect, ok, text, marker):
    """What a reader's answer is worth, given what was to be expected."""
    text = F.coalesce(text, F.lit(""))
    low, n = F.lower(text), F.length(F.trim(text))
    blocked = T.contains_any(low, STRONG) | ((n < 3000) & T.contains_any(low, WEAK))
    thin, seen = n < 200, F.coalesce(low.contains(F.lower(marker)), F.lit(False))
    right, wrong = F.lit("real_success"), F.lit("silent_wrong")
    return (
        F.when(~ok | (n == 0), F.when(expect == "extractable", "miss").otherwise("honest_failure"))
        .when((expect == "extractable") & marker.isNotNull(), F.when(seen & ~blocked, right).otherwise(wrong))
        .when(expect == "notfound", wrong)
        .when(expect == "js_shell", F.when(seen & ~blocked & ~thin, right).otherwise(wrong))
        .otherwise(F.when(blocked | thin, wrong).otherwise(right))
    )


_LOW = "lower(text)"
_BLOCKED = "(" + " OR ".join(f"contains({_LOW}, '{x}')" for x in STRONG) + " OR (length(trim(text)) < 3000 AND (" + " OR ".join(f"contains({_LOW}, '{x}')" for x in WEAK) + ")))"


@query("correctness_classes", f"""
WITH a AS (SELECT doc_id, ['extractable', 'notfound', 'js_shell', 'blocked'][1 + doc_id % 4] AS expect, doc_id % 7 <> 0 AS ok, CASE WHEN doc_id % 3 = 0 THEN 'the' END AS marker, text || CASE WHEN doc_id % 11 = 0 THEN ' Captcha' ELSE '' END AS text FROM documents WHERE text IS NOT NULL),
b AS (SELECT expect, CASE WHEN NOT ok OR length(trim(text)) = 0 THEN CASE WHEN expect = 'extractable' THEN 'miss' ELSE 'honest_failure' END
  WHEN expect = 'extractable' AND marker IS NOT NULL THEN CASE WHEN contains({_LOW}, marker) AND NOT {_BLOCKED} THEN 'real_success' ELSE 'silent_wrong' END WHEN expect = 'notfound' THEN 'silent_wrong'
  WHEN expect = 'js_shell' THEN CASE WHEN coalesce(contains({_LOW}, marker), false) AND NOT {_BLOCKED} AND length(trim(text)) >= 200 THEN 'real_success' ELSE 'silent_wrong' END
  WHEN {_BLOCKED} OR length(trim(text)) < 200 THEN 'silent_wrong' ELSE 'real_success' END AS class FROM a)
SELECT expect, count(*) FILTER (WHERE class = 'real_success') AS real_success, count(*) FILTER (WHERE class = 'silent_wrong') AS silent_wrong, count(*) FILTER (WHERE class IN ('miss', 'honest_failure')) AS failed FROM b GROUP BY expect
""")
def correctness_classes(spark, sf_dir):
    i = F.col("doc_id")
    expect = F.element_at(F.array(*[F.lit(x) for x in ("extractable", "notfound", "js_shell", "blocked")]), (i % 4 + 1).cast("int"))
    text = F.concat("text", F.when(i % 11 == 0, " Captcha").otherwise(""))
    docs = table(spark, sf_dir, "documents").filter("text is not null").withColumn("expect", expect)
    kind = outcome_class(F.col("expect"), i % 7 != 0, text, F.when(i % 3 == 0, "the"))
    return docs.groupBy("expect").agg(
        F.count_if(kind == "real_success").alias("real_success"), F.count_if(kind == "silent_wrong").alias("silent_wrong"), F.count_if(kind.isin("miss", "honest_failure")).alias("failed")
    )


@query("eval_report", "SELECT event_type AS corpus, count(*) AS n, round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END), 4) AS accuracy, round(avg(value), 2) AS latency FROM events GROUP BY ROLLUP (event_type)")
def eval_report(spark, sf_dir):
    """Accuracy and latency of each corpus and of all."""
    df = table(spark, sf_dir, "events").rollup(F.col("event_type").alias("corpus"))
    return df.agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("value") > 20, 1.0).otherwise(0.0)), 4).alias("accuracy"), F.round(F.avg("value"), 2).alias("latency"))


@query("corpus_build", r"""
SELECT page_id, row_number() OVER (ORDER BY page_id) AS place FROM (SELECT page_id FROM pages WHERE page_id > 20 AND NOT regexp_matches(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '(^|[.-])cdn|cdn([.-]|\d|$)|(^|[.-])api\.|(^|[.-])ns\d|dns|ads-|^m\.') ORDER BY page_id LIMIT 100)
""")
def corpus_build(spark, sf_dir):
    """The first hundred ranked pages past the reserved ones that are on no infrastructure host: a top-k report."""
    infra = r"(^|[.-])cdn|cdn([.-]|\d|$)|(^|[.-])api\.|(^|[.-])ns\d|dns|ads-|^m\."
    pages = table(spark, sf_dir, "pages").filter((F.col("page_id") > 20) & ~T.url_host(F.col("url")).rlike(infra))
    best = pages.select("page_id").orderBy("page_id").limit(100)
    return best.withColumn("place", F.row_number().over(Window.orderBy("page_id")).cast("bigint"))


@query("trend_slope", """
SELECT user_id, round(CASE WHEN count(*) < 4 THEN 0 ELSE regr_slope(value, k) END, 6) AS slope FROM (SELECT user_id, value, -row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE value IS NOT NULL) WHERE k >= -12 GROUP BY user_id
""")
def trend_slope(spark, sf_dir):
    """Least-squares slope of each user's last twelve samples; 0 with fewer than four."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    last = table(spark, sf_dir, "events").filter("value is not null").withColumn("k", k).filter("k <= 12")
    slope = F.when(F.count("*") < 4, 0.0).otherwise(F.regr_slope("value", -F.col("k")))
    return last.groupBy("user_id").agg(F.round(slope, 6).alias("slope"))


@query("batch_progress", """
SELECT user_id AS job, count(*) AS total, count(*) FILTER (WHERE event_type = 'purchase') AS done, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type NOT IN ('purchase', 'error')) AS pending FROM events GROUP BY user_id
""")
def batch_progress(spark, sf_dir):
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job")).agg(
        F.count("*").alias("total"), F.count_if(kind == "purchase").alias("done"), F.count_if(kind == "error").alias("failed"), F.count_if(~kind.isin("purchase", "error")).alias("pending")
    )


@query("batch_page", "SELECT user_id AS job, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_id > 500) WHERE k <= 5")
def batch_page(spark, sf_dir):
    """The next five results of every job after a cursor."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf_dir, "events").filter("event_id > 500").withColumn("k", k).filter("k <= 5").select(F.col("user_id").alias("job"), "event_id")


def _with_before(spark, sf_dir):
    """Events with the time of the one before of the same user and type."""
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    keys, order = ["user_id", "event_type"], ["ts", "event_id"]
    return O.with_previous(O.in_parts(df, keys, order), keys, order, "ts", "before")


@query("batch_idempotency", """
WITH a AS (SELECT event_id, user_id, event_type, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events) SELECT event_id, p IS NOT NULL AND ts - p <= INTERVAL 24 HOURS AS repeated FROM a
""")
def batch_idempotency(spark, sf_dir):
    """Submissions that repeat one of the same key within a day."""
    df = _with_before(spark, sf_dir)
    return df.select("event_id", F.coalesce(F.col("ts") - F.col("before") <= F.expr("INTERVAL 24 HOURS"), F.lit(False)).alias("repeated"))


@query("cache_hits", """
WITH a AS (SELECT event_type, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events) SELECT event_type, count(*) AS requests, count(*) FILTER (WHERE p IS NOT NULL AND ts - p <= INTERVAL 6 HOURS) AS hits FROM a GROUP BY event_type
""")
def cache_hits(spark, sf_dir):
    """Requests that a cache of six hours would answer; each request renews its entry."""
    df = _with_before(spark, sf_dir)
    fresh = F.coalesce(F.col("ts") - F.col("before") <= F.expr("INTERVAL 6 HOURS"), F.lit(False))
    return df.groupBy("event_type").agg(F.count("*").alias("requests"), F.count_if(fresh).alias("hits"))
