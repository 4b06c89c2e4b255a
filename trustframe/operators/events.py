"""Sliding-window over-limit detection (re-aimed from the request limiter).

For each event, ``n`` = events of the same key with ``t − 60 s < ts ≤ t``
(open lower bound, the current event and its same-time peers included);
``over_limit`` when ``n > limit``; ``remaining = max(0, limit − n)``.

A window ``partition by key order by ts range …`` would put one hot key in
one task.  Instead two probe rows per event are merged into the event
stream and one distributed running count (``with_running_sum``, range
partitioned on (key, time)) gives, at each probe, the number of events at or
before the probe time:

    n = count(ts ≤ t) − count(ts ≤ t − 60 s)

Probes sort after events with the same time, so "≤" includes peers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustframe.operators.splits import with_running_sum


def rate_window(events: DataFrame, key: str = "user_id", ts: str = "ts", event_id: str = "event_id",
                window_seconds: int = 60, limit: int = 60) -> DataFrame:
    ev = events.select(F.col(key).alias("k"), F.col(ts).alias("t"), F.col(event_id).alias("eid"))
    rows = ev.select("k", F.col("t").alias("time"), F.lit(0).alias("kind"), "eid", F.lit(1).alias("w"))
    hi = ev.select("k", F.col("t").alias("time"), F.lit(1).alias("kind"), "eid", F.lit(0).alias("w"))
    lo = ev.select("k", (F.col("t") - F.make_interval(secs=F.lit(window_seconds))).alias("time"),
                   F.lit(2).alias("kind"), "eid", F.lit(0).alias("w"))
    allr = rows.unionByName(hi).unionByName(lo)
    rs = with_running_sum(allr, ["k"], [F.col("time"), F.least(F.col("kind"), F.lit(1)), F.col("eid"),
                                         F.col("kind")], "w", "cum")
    probes = rs.filter(F.col("kind") > 0).groupBy("k", "eid").agg(
        F.max(F.when(F.col("kind") == 1, F.col("cum"))).alias("upto_t"),
        F.max(F.when(F.col("kind") == 2, F.col("cum"))).alias("upto_lo"))
    n = (F.col("upto_t") - F.col("upto_lo")).cast("long")
    return probes.select(F.col("k").alias(key), F.col("eid").alias(event_id), n.alias("n_in_window"),
                         (n > limit).alias("over_limit"),
                         F.greatest(F.lit(0).cast("long"), F.lit(limit) - n).alias("remaining"))
