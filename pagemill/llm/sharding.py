"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix. DataFrame functions only.

1. Each row gets two random keys and its source block (a bounded run of rows of one input partition); written once.
2. The matrix "rows of block b that go to shard s" is drawn exactly: a binary tree over the blocks is walked from the
   root, and at every node the shard sizes are split between the two halves by multivariate hypergeometric draws.
3. Inside each block rows are permuted locally (ranked by the first key) and cut up by the block's matrix row.
4. Rows are exchanged by (shard, bucket), bucket being the leading part of the second key, and permuted again.

No task holds more than a block or a bucket; both are bounded by parameters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialize, whole_row

#: Constants of the ratio-of-uniforms hat: 2 sqrt(2/e) and 3 - 2 sqrt(3/e).
HAT_WIDTH = 2 * math.sqrt(2 / math.e)
HAT_SHIFT = 3 - 2 * math.sqrt(3 / math.e)
#: Draws of fewer rows than this are made one by one from the urn.
URN_DRAWS = 10
#: Tries of the rejection sampler; each succeeds with probability over 0.5.
TRIES = 96


def _uniform(*parts) -> Column:
    """A uniform in (0, 1) that depends only on ``parts``."""
    bits = F.shiftrightunsigned(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), 11)
    return (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)


def _log_factorial(n: Column) -> Column:
    """ln n! of a non-negative whole double: a table of the built-in factorial below 16, else Stirling's series."""
    x = F.greatest(n, F.lit(1.0))
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n < 16, F.log(F.factorial(n.cast("int")).cast("double"))).otherwise(series)


def _urn(good: Column, total: Column, draws: Column, salt: Column) -> Column:
    """Hypergeometric by drawing one at a time."""
    start = F.struct(good.alias("good"), F.lit(0).cast("bigint").alias("got"))

    def step(acc, i):
        hit = _uniform(salt, i, F.lit("urn")) * (total - i + 1) < acc["good"]
        one = F.when(hit, 1).otherwise(0).cast("bigint")
        return F.struct((acc["good"] - one).alias("good"), (acc["got"] + one).alias("got"))

    steps = F.when(draws > 0, F.sequence(F.lit(1).cast("bigint"), draws)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, step)["got"]


def _ratio_of_uniforms(good: Column, total: Column, draws: Column, salt: Column) -> Column:
    """Hypergeometric by rejection under a table-mountain hat (published as HRUA)."""
    fields = F.struct(
        F.least(good, total - good).cast("double").alias("lo"),
        F.greatest(good, total - good).cast("double").alias("hi"),
        F.least(draws, total - draws).cast("double").alias("m"),
        total.cast("double").alias("n"),
    )

    def with_hat(p):
        share = p["lo"] / p["n"]
        spread = F.sqrt((p["n"] - p["m"]) * p["m"] * share * (1 - share) / (p["n"] - 1) + 0.5)
        centre = p["m"] * share + 0.5
        return F.struct(
            p["lo"].alias("lo"),
            p["hi"].alias("hi"),
            p["m"].alias("m"),
            centre.alias("centre"),
            (HAT_WIDTH * spread + HAT_SHIFT).alias("width"),
            F.floor((p["m"] + 1) * (p["lo"] + 1) / (p["n"] + 2)).cast("double").alias("mode"),
            F.least(F.least(p["m"], p["lo"]) + 1, F.floor(centre + 16 * spread).cast("double")).alias("end"),
        )

    def mass(p, k):
        """Minus the log of the probability of k, up to a constant."""
        return (
            _log_factorial(k) + _log_factorial(p["lo"] - k) + _log_factorial(p["m"] - k)
            + _log_factorial(p["hi"] - p["m"] + k)
        )

    def draw(p):
        def attempt(i):
            x, y = _uniform(salt, i, F.lit("x")), _uniform(salt, i, F.lit("y"))

            def judge(c):
                k = F.floor(c["w"]).cast("double")
                inside = (c["w"] >= 0) & (c["w"] < p["end"])
                return F.when(inside & (2 * F.log(c["x"]) <= p["top"] - mass(p, k)), k.cast("bigint")).otherwise(-1)

            return let(F.struct(x.alias("x"), (p["centre"] + p["width"] * (y - 0.5) / x).alias("w")), judge)

        found = F.aggregate(
            F.sequence(F.lit(1), F.lit(TRIES)),
            F.lit(-1).cast("bigint"),
            lambda acc, i: F.when(acc >= 0, acc).otherwise(attempt(i)),
        )
        return F.when(found >= 0, found).otherwise(p["mode"].cast("bigint"))

    def ready(p):
        return let(p.withField("top", mass(p, p["mode"])), draw)

    low = let(fields, lambda p: let(with_hat(p), ready))
    # low counts the rarer kind among the smaller of drawn and left; turn it into the good ones drawn
    rarer_good = good <= total - good
    among = F.when(rarer_good, low).otherwise(F.least(draws, total - draws) - low)
    return F.when(draws <= total - draws, among).otherwise(good - among)


def hypergeometric(good: Column, total: Column, draws: Column, salt: Column) -> Column:
    """How many of ``draws`` rows, taken at random from ``total`` rows of which ``good`` are good, are good."""
    few = F.least(draws, total - draws)
    by_urn = _urn(good, total, few, salt)
    small = F.when(draws <= total - draws, by_urn).otherwise(good - by_urn)
    return (
        F.when((good == 0) | (draws == 0), F.lit(0).cast("bigint"))
        .when(draws == total, good)
        .when(good == total, draws)
        .when(few < URN_DRAWS, small)
        .otherwise(_ratio_of_uniforms(good, total, draws, salt))
    )


def _split_sizes(sizes: Column, draws: Column, salt: Column) -> Column:
    """Multivariate hypergeometric: how many of ``draws`` rows fall to each shard of ``sizes``."""
    start = F.struct(
        F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"),
        draws.alias("draws"),
        F.array().cast("array<bigint>").alias("out"),
    )

    def step(acc, good):
        place = F.size(acc["out"])
        got = hypergeometric(good, acc["total"], acc["draws"], F.xxhash64(salt, place))
        return let(
            got,
            lambda g: F.struct(
                (acc["total"] - good).alias("total"),
                (acc["draws"] - g).alias("draws"),
                F.concat(acc["out"], F.array(g)).alias("out"),
            ),
        )

    return F.aggregate(sizes, start, step)["out"]


def communication_matrix(blocks: DataFrame, n_blocks: int, n_shards: int, seed: int) -> DataFrame:
    """(``__block``, ``__n``) counts to (``__block``, ``__cum``): running sums of each block's rows per shard.

    Starts as one row with one small struct a block, so its size is the number of blocks, not of rows.
    """
    total = F.aggregate("cells", F.lit(0).cast("bigint"), lambda a, c: a + c["__n"])
    shard = F.sequence(F.lit(0).cast("bigint"), F.lit(n_shards - 1).cast("bigint"))
    node = blocks.agg(F.array_sort(F.collect_list(F.struct("__block", "__n"))).alias("cells")).select(
        "cells",
        let(
            total,
            lambda n: F.transform(
                shard, lambda s: F.floor(n / n_shards).cast("bigint") + F.when(s < n % n_shards, 1).otherwise(0)
            ),
        ).alias("sizes"),
    )
    for level in range(max(0, math.ceil(math.log2(max(1, n_blocks))))):
        if level == 8:
            node = node.repartition(F.xxhash64("cells"))
        half = F.floor((F.size("cells") + 1) / 2).cast("int")
        parted = node.select(
            "sizes",
            F.slice("cells", F.lit(1), half).alias("left"),
            F.slice("cells", half + 1, F.size("cells") - half).alias("right"),
        )
        rows_left = F.aggregate("left", F.lit(0).cast("bigint"), lambda a, c: a + c["__n"])
        salt = F.xxhash64(F.lit(seed), F.lit(level), F.col("left")[0]["__block"])
        parted = parted.withColumn("given", _split_sizes(F.col("sizes"), rows_left, salt))
        children = F.array(
            F.struct(F.col("left").alias("cells"), F.col("given").alias("sizes")),
            F.struct(
                F.col("right").alias("cells"), F.zip_with("sizes", "given", lambda a, b: a - b).alias("sizes")
            ),
        )
        node = parted.select(F.explode(F.filter(children, lambda c: F.size(c["cells"]) > 0)).alias("c")).select("c.*")
    running = F.transform(
        "sizes",
        lambda _, i: F.aggregate(F.slice("sizes", F.lit(1), i + 1), F.lit(0).cast("bigint"), lambda a, x: a + x),
    )
    return node.select(F.explode("cells").alias("c"), running.alias("__cum")).select("c.__block", "__cum")


def shuffle_into_shards(
    df: DataFrame, n_shards: int = 24, seed: int = 11, block_bits: int = 18, bucket_rows: int = 1 << 18
) -> DataFrame:
    """All rows of ``df``, each with ``shard`` (int) and ``slot`` (long, gapless from 0 in its shard).

    Every permutation of the rows is equally likely; shard sizes differ by one row at most. Values of rows play no
    part, so nulls, ties, empty or very long texts and repeated rows are rows like any other and no key is hot. An
    empty frame gives an empty one. Columns of ``df`` called ``shard`` or ``slot`` are replaced. ``block_bits``: rows
    of a source block as a power of two; ``bucket_rows``: rows of a bucket of a shard, about.
    """
    df = df.drop(*[c for c in df.columns if c.lower() in ("shard", "slot")])
    table = materialize(
        df.select(
            whole_row(df).alias("__row"),
            F.shiftright(F.monotonically_increasing_id(), block_bits).alias("__block"),
            F.rand(seed).alias("__key1"),
            F.rand(seed + 1).alias("__key2"),
        ),
        "shards",
    )
    blocks = materialize(table.groupBy("__block").agg(F.count("*").alias("__n")), "blocks")
    n_blocks, n_rows = blocks.agg(F.count("*"), F.coalesce(F.sum("__n"), F.lit(0))).first()
    matrix = materialize(communication_matrix(blocks, n_blocks, n_shards, seed), "matrix")
    local = Window.partitionBy("__block").orderBy("__key1", "__key2")
    n_buckets = max(1, math.ceil(n_rows / n_shards / bucket_rows))
    placed = (
        table.withColumn("__rank", F.row_number().over(local) - 1)
        .join(matrix, "__block")
        .select(
            "__row",
            F.size(F.filter("__cum", lambda c: c <= F.col("__rank"))).cast("int").alias("shard"),
            F.least(F.floor(F.col("__key2") * n_buckets), F.lit(n_buckets - 1)).cast("int").alias("__bucket"),
            "__key1",
            "__key2",
        )
    )
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "__bucket").agg(F.count("*").alias("__n"))
        .select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    again = Window.partitionBy("shard", "__bucket").orderBy("__key2", "__key1")
    return (
        placed.withColumn("__rank", F.row_number().over(again) - 1)
        .join(offsets, ["shard", "__bucket"])
        .select("__row.*", "shard", (F.col("__before") + F.col("__rank")).alias("slot"))
    )


def op1_hypergeometric_shards(spark, sf_dir):
    """All documents into shards 0 to 23 under the law ``rows``; a null text counts as no bytes."""
    from .common import read_table

    binary = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    lean = read_table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(binary).cast("bigint") + 8).alias("size"), F.crc32(binary).alias("text_crc32")
    )
    return shuffle_into_shards(lean).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
