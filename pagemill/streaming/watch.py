"""Watching pages and attempts as streams."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "url string, ts timestamp, first_seen boolean, changed boolean, seq int"
STATE = "hash string, seq int"


def _visit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known, seq = state.get if state.exists else (None, -1)
    for batch in batches:
        rows = []
        for ts, digest in zip(*(batch.sort_values(["ts", "hash"])[c] for c in ("ts", "hash")), strict=True):
            first = known is None
            changed = not first and digest != known
            seq += first or changed
            known = digest
            rows.append((key[0], ts, first, changed, seq))
        yield pd.DataFrame(rows, columns=["url", "ts", "first_seen", "changed", "seq"])
    if known is not None:
        state.update((known, seq))


def watch(visits: DataFrame) -> DataFrame:
    """A stream of (url, ts, hash) to its verdicts; the state of a url is its last hash and count of changes."""
    return visits.groupBy("url").applyInPandasWithState(_visit, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def atlas(attempts: DataFrame, late: str = "10 minutes", span: str = "1 hour") -> DataFrame:
    """A stream of (ts, host, code) to counts per window, host and code; later rows than ``late`` are not counted."""
    return attempts.withWatermark("ts", late).groupBy(F.window("ts", span), "host", "code").count()


def once_a_day(submissions: DataFrame) -> DataFrame:
    """A stream of submissions without those whose key came within the last 24 hours."""
    return submissions.withWatermark("ts", "24 hours").dropDuplicatesWithinWatermark(["key"])


# Fixed value: hosts that the record of failures keeps at most.
MOST_HOSTS = 500

SUMMARY = "shard int, batch int, host string, count long, error long"


def _space_saving(kept: dict[str, tuple[int, int]], counts: dict[str, int], most: int) -> None:
    """Add ``counts`` to at most ``most`` (count, error) entries; a host that is new takes the place of the least counted."""
    for host in counts.keys() & kept.keys():
        kept[host] = (kept[host][0] + counts[host], kept[host][1])
    heap = [(n, h) for h, (n, _) in kept.items()]
    heapq.heapify(heap)
    for host, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        if host in kept:
            continue
        least = 0
        if len(kept) >= most:
            least, gone = heapq.heappop(heap)
            del kept[gone]
        kept[host] = (n + least, least)
        heapq.heappush(heap, (n + least, host))


def top_hosts(attempts: DataFrame, most: int = MOST_HOSTS, shards: int = 8) -> DataFrame:
    """A stream of (host) to bounded counts: (shard, batch, host, count, error) of each shard whenever it changes.

    A shard of the hosts keeps ``most`` entries, whatever comes; take those of its greatest batch, and of all shards the
    ``most`` greatest counts. Space saving bounds the mistake: a host's true count lies between count - error and count, no error is
    over a shard's rows / ``most``, and a host with more rows than that is never missing. Null hosts count as one.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hosts, counts, errors, turn = state.get if state.exists else ([], [], [], -1)
        kept = {h: (n, e) for h, n, e in zip(hosts, counts, errors, strict=True)}
        for batch in batches:
            _space_saving(kept, batch["host"].value_counts().to_dict(), most)
        turn += 1
        hosts = list(kept)
        state.update((hosts, [kept[h][0] for h in hosts], [kept[h][1] for h in hosts], turn))
        yield pd.DataFrame({"shard": key[0], "batch": turn, "host": hosts, "count": [kept[h][0] for h in hosts], "error": [kept[h][1] for h in hosts]})

    named = attempts.select(F.coalesce("host", F.lit("")).alias("host"))
    dealt = named.withColumn("shard", F.pmod(F.hash("host"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandasWithState(
        update, SUMMARY, "hosts array<string>, counts array<long>, errors array<long>, turn int", "update", GroupStateTimeout.NoTimeout
    )
