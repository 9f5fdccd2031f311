"""Streaming twins of batch jobs: same operators, state kept by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from floodspark.operators.runs import run_summary


def summary_stream(steps: DataFrame) -> DataFrame:
    """Running summary of a stream of map steps: maxima and the least arrival do not depend on the blocks' order.
    Write it in update or complete mode."""
    return run_summary(steps)


def daily_rain_stream(rain: DataFrame, late: str = "3 days") -> DataFrame:
    """Daily sums per site, final once the watermark has passed the day."""
    return rain.withWatermark("ts", late).groupBy("site_id", F.window("ts", "1 day").alias("w")).agg(F.sum("mm").alias("mm")).select("site_id", F.col("w.start").alias("day"), "mm")


def trailing_rain_stream(rain: DataFrame, days: int = 7, late: str = "3 days") -> DataFrame:
    """Totals of every ``days`` days, sliding by one."""
    return rain.withWatermark("ts", late).groupBy("site_id", F.window("ts", f"{days} days", "1 day").alias("w")).agg(F.sum("mm").alias("mm")).select("site_id", F.col("w.start").alias("start"), "mm")


def crossing_stream(series: DataFrame, threshold: float, late: str = "1 hour", buckets: int = 1024) -> DataFrame:
    """poi_id, t_cross (seconds): one alert for each point at the first crossing of ``threshold``, interpolated from the
    sample before. Columns: poi_id, ts, q_m3s.

    Samples wait in the state until the watermark has passed them, so rows that come up to ``late`` late take
    their place in time. Nothing after a point's first sample at or over the threshold is kept, and after its
    alert only that it was given: it is what makes a second one impossible, so it stays.

    A group is one of ``buckets`` by the hash of the point, and its points are worked off together, so calls and rows of state do
    not grow with the number of points. A bucket holds its share of them: more points need more buckets, from the stream's first start on.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kinds = (np.int64, np.int64, float, float, np.int64, float, float)
        fired, known, last_t, last_q, poi, t, q = (np.frombuffer(x, kind) for x, kind in zip(state.get if state.exists else [b""] * 7, kinds))
        some = [rows.dropna(subset=["at_us", "q_m3s"]) for rows in batches]
        poi = np.concatenate([poi, *(rows["poi_id"].fillna(0).to_numpy(np.int64) for rows in some)])  # null is bucket -1 alone
        t, q = np.concatenate([t, *(rows["at_us"].to_numpy(float) / 1e6 for rows in some)]), np.concatenate([q, *(rows["q_m3s"].to_numpy(float) for rows in some)])
        order = np.lexsort((q, t, poi))
        order = order[~np.isin(poi[order], fired)]
        poi, t, q = poi[order], t[order], q[order]
        over = q >= threshold
        begun = np.cumsum(over) - over
        kept = begun == begun[np.searchsorted(poi, poi)]  # up to each point's first sample over
        poi, t, q = poi[kept], t[kept], q[kept]
        mark = state.getCurrentWatermarkMs()
        done = t <= mark / 1000
        at = np.flatnonzero(done & np.append((poi[1:] != poi[:-1]) | ~done[1:], True)[: len(poi)])  # each point's last one done
        who = poi[at]
        before_t, before_q = np.full(len(at), np.nan), np.full(len(at), np.nan)
        place = np.searchsorted(known, who)
        met = np.isin(who, known)
        before_t[met], before_q[met] = last_t[place[met]], last_q[place[met]]
        more = np.flatnonzero(at > np.searchsorted(poi, who))
        before_t[more], before_q[more] = t[at[more] - 1], q[at[more] - 1]
        alert = q[at] >= threshold  # the only such sample, as what comes after it was dropped
        if alert.any():
            t1, q1, t0, q0 = t[at[alert]], q[at[alert]], before_t[alert], before_q[alert]
            crossed = np.where(np.isnan(t0), t1, t0 + (threshold - q0) / (q1 - q0) * (t1 - t0))
            yield pd.DataFrame({"poi_id": who[alert] if key[0] >= 0 else [None], "t_cross": crossed})
        fired, stay = np.append(fired, who[alert]), ~np.isin(known, who)
        known, last_t, last_q = (np.concatenate([old[stay], new[~alert]]) for old, new in ((known, who), (last_t, t[at]), (last_q, q[at])))
        order, held = np.argsort(known), ~done
        poi, t, q = poi[held], t[held], q[held]
        state.update(tuple(x.tobytes() for x in (fired, known[order], last_t[order], last_q[order], poi, t, q)))
        if len(t):
            state.setTimeoutTimestamp(max(int(t.min() * 1000), mark) + 1)

    kind = "fired binary, known binary, last_t binary, last_q binary, held_poi binary, held_t binary, held_q binary"
    bucket = F.when(F.col("poi_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("poi_id"), F.lit(buckets))).cast("int")
    series = series.withColumns({"at_us": F.unix_micros("ts"), "bucket": bucket})  # since the epoch, whatever the session's time zone
    return series.withWatermark("ts", late).groupBy("bucket").applyInPandasWithState(step, "poi_id long, t_cross double", kind, "append", GroupStateTimeout.EventTimeTimeout)


def new_scenes_stream(scenes: DataFrame, late: str = "30 days") -> DataFrame:
    """Each scene (scene_id, ts, ...) once, also if several searches find it; ids are forgotten ``late`` after."""
    return scenes.withWatermark("ts", late).dropDuplicatesWithinWatermark(["scene_id"])


def revisions(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds each batch to a table of revisions, in a folder of its own: a batch that
    comes twice, after a restart too, replaces itself, and no older row is rewritten."""

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def current(revised: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """The newest revision of each key, whichever batch brought it: largest version, then largest row."""
    others = [x for x in revised.columns if x not in (*keys, version)]
    newest = F.max(F.struct(version, *others)).alias("newest")
    return revised.groupBy(*keys).agg(newest).select(*keys, "newest.*")
