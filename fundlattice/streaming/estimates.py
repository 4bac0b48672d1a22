"""STR-1 as a stateful stream: the value of each code now, an estimate until the official value of its day comes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What comes in: kind is 'estimate' or 'official'.
READINGS = "code string, at timestamp, kind string, value double"
CURRENT = "code string, at timestamp, source string, value double"
_STATE = "estimated_at timestamp, estimate double, official_at timestamp, official double"
#: How far behind the newest reading one may come, and how long an estimate stands without an official value.
LATE, STANDS_MS = "30 days", 7 * 86_400_000


def current_values(readings: DataFrame) -> DataFrame:
    """FLT-12 over a table of readings: the newest estimate where its day is later than the newest official value's, else that value.

    Of readings at one time the larger value counts. Rows without a code, a time or a value take no part; a code with none has no row.
    """
    rows = readings.where("code is not null and at is not null and value is not null and not isnan(value)")
    newest = lambda kind: F.max(F.when(F.col("kind") == kind, F.struct("at", "value"))).alias(kind)
    found = rows.groupBy("code").agg(newest("estimate"), newest("official"))
    fresh = F.col("official").isNull() | (F.to_date("estimate.at") > F.to_date("official.at"))
    taken = F.col("estimate").isNotNull() & fresh
    value = F.when(taken, F.col("estimate")).otherwise(F.col("official"))
    return found.where("estimate is not null or official is not null").select("code", value["at"].alias("at"), F.when(taken, "estimate").otherwise("official").alias("source"), value["value"].alias("value"))


def follow(readings: DataFrame, late: str = LATE, stands_ms: int = STANDS_MS) -> DataFrame:
    """current_values of a stream, in update mode: a row of a code each time its value changes.

    The state of a code is its newest estimate and its newest official value, whatever order they come in and however often; so it
    doesn't grow. An estimate goes when an official value of its day or a later one comes, or, by a timer, when the stream is `stands_ms` past
    it. Readings of more than `late` behind the newest are left out.
    """

    def answer(code: str, state: tuple) -> pd.DataFrame:
        estimated_at, estimate, official_at, official = state
        if estimated_at is not None:
            return pd.DataFrame([(code, estimated_at, "estimate", estimate)], columns=["code", "at", "source", "value"])
        if official_at is None:
            return pd.DataFrame({"code": [], "at": pd.to_datetime([]), "source": [], "value": []}).astype({"code": str, "source": str, "value": float})
        return pd.DataFrame([(code, official_at, "official", official)], columns=["code", "at", "source", "value"])

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get if state.exists else (None, None, None, None)
        plain = lambda t: None if t is None or pd.isna(t) else pd.Timestamp(t)
        newest = {"estimate": (plain(before[0]), before[1]), "official": (plain(before[2]), before[3])}
        if state.hasTimedOut:
            newest["estimate"] = (None, None)
        else:
            for batch in batches:
                for kind, rows in batch.dropna(subset=["at", "value"]).groupby("kind"):
                    if kind in newest:
                        last = rows.sort_values(["at", "value"]).iloc[-1]
                        found = (pd.Timestamp(last["at"]), float(last["value"]))
                        newest[kind] = max((x for x in (newest[kind], found) if x[0] is not None), default=(None, None))
        estimate, official = newest["estimate"], newest["official"]
        if None not in (estimate[0], official[0]) and official[0].date() >= estimate[0].date():
            estimate = (None, None)
        now = (*estimate, *official)
        if now != (None,) * 4:
            state.update(tuple(x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in now))
            if estimate[0] is not None:
                state.setTimeoutTimestamp(max(int(estimate[0].timestamp() * 1000) + stands_ms, state.getCurrentWatermarkMs() + 1))
        same = tuple(plain(x) if k % 2 == 0 else x for k, x in enumerate(before)) == now
        if not same:
            yield answer(key[0], now)

    rows = readings.where("code is not null and at is not null and value is not null and not isnan(value)").withWatermark("at", late)
    return rows.groupBy("code").applyInPandasWithState(update, CURRENT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
