"""Keyed state over streams: preference pairs per prompt (R1 + R2) and first rows per key.

Both keep one small row per key in the state store and give it out when the key closes: an
event-time timer fires once the watermark passes the key's deadline, the row is emitted and
the state removed, so the state holds open keys only. While a key is open the result does not
depend on the order of arrival or on the micro-batches; a row that comes after its key has
closed is late by more than ``wait`` (and for D1 is dropped while the key is remembered).

The processors run in Python workers through ``transformWithStateInPandas``, which needs the RocksDB
state store (:func:`stateful_session`). For a finite input ``close_*`` adds what was still open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from prefloom.functions.text import dedup_key
from prefloom.operators.pairs import PAIR_COLUMNS, build_pairs, eligible
from prefloom.operators.prep import deduplicate
from prefloom.streaming.jobs import WATERMARK, as_utc_instant, stream_session

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SIDE = "response string, score double, reason string, idx bigint"
_STATE = f"prompt string, n bigint, deadline bigint, best struct<{_SIDE}>, worst struct<{_SIDE}>"
_PAIRS = "prompt string, chosen string, rejected string, chosen_score double, rejected_score double, score_gap double, chosen_reason string, rejected_reason string"


def stateful_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A session of its own for a stream with timers, on the RocksDB state store."""
    own = stream_session(spark, state_partitions)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    return own


def _millis(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds() * 1000)


def _text(value) -> str | None:
    return None if value is None or value is pd.NA or value != value else value


class BestAndWorst(StatefulProcessor):
    """Per prompt: number of candidates, earliest best and latest worst. A prompt closes when the
    watermark is ``wait`` past its latest candidate; what comes before the timer fires still counts."""

    def __init__(self, wait: int, min_gap: float, key: str):
        self.wait, self.min_gap, self.key = wait, min_gap, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pair", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        prompt, n, deadline, best, worst = self.state.get() if self.state.exists() else (None, 0, None, None, None)
        latest = None
        for df in rows:
            for own, response, score, reason, idx, at in zip(df["prompt"], df["response"], df["score"], df["reason"], df["cand_idx"], df["at_ms"], strict=True):
                side = (response, float(score), _text(reason), int(idx))
                own = _text(own)
                prompt = own if prompt is None or (own is not None and own < prompt) else prompt
                n += 1
                if best is None or (side[1], -side[3]) > (best[1], -best[3]):
                    best = side
                if worst is None or (side[1], -side[3]) < (worst[1], -worst[3]):
                    worst = side
                latest = int(at) if latest is None else max(latest, int(at))
        if latest is not None:
            due = max(latest + self.wait, deadline or 0)
            if deadline is not None and due != deadline:
                self.handle.deleteTimer(deadline)
            if due != deadline:
                self.handle.registerTimer(due)
            self.state.update((prompt, n, due, tuple(best), tuple(worst)))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        prompt, n, _, best, worst = self.state.get()
        self.state.clear()
        if n >= 2 and best[1] - worst[1] >= self.min_gap:
            values = (key[0], prompt, best[0], worst[0], best[1], worst[1], best[1] - worst[1], best[2], worst[2])
            yield pd.DataFrame({c: [v] for c, v in zip([self.key, *PAIR_COLUMNS], values, strict=True)})

    def close(self) -> None:
        pass


def pairs_stream(scored: DataFrame, min_gap: float = 2.0, key: str = "prompt_id", ts: str = "ts", watermark: str | None = WATERMARK, wait: str = "10 minutes") -> DataFrame:
    """R1 + R2 on a stream of scored candidates (key, prompt, cand_idx, response, score, reason,
    ts): a prompt's pair is emitted when it closes, with the rules of ``build_pairs``. After
    ``scored_stream`` (ST2), which has set the watermark, pass ``watermark=None``."""
    if watermark:
        scored = scored.withColumn(ts, as_utc_instant(ts, scored.schema[ts].dataType)).withWatermark(ts, watermark)
    x = eligible(scored).select(key, "prompt", F.col("cand_idx").cast("bigint").alias("cand_idx"), "response", F.col("score").cast("double").alias("score"),
                           "reason", F.unix_millis(ts).alias("at_ms"), ts)
    out = T.StructType([scored.schema[key], *T.StructType.fromDDL(_PAIRS).fields])
    return x.groupBy(key).transformWithStateInPandas(BestAndWorst(_millis(wait), float(min_gap), key), out, "Append", "EventTime")


def close_pairs(emitted: DataFrame, scored: DataFrame, min_gap: float = 2.0, key: str = "prompt_id") -> DataFrame:
    """The closing step for a finite source: the stream's pairs and, from a batch over the same
    ``scored`` rows, those of the prompts it has given none for."""
    rest = build_pairs(scored.join(emitted.select(key), key, "left_anti"), min_gap, key)
    return emitted.unionByName(rest.select(*emitted.columns))


class FirstRow(StatefulProcessor):
    """Per key the row of the least ordinal. The key closes ``wait`` after the time of its first
    arrival and is remembered ``remember`` longer, so that later copies are dropped; after that it is new."""

    def __init__(self, wait: int, remember: int, columns: list[str], order: str, schema: str):
        self.wait, self.remember, self.columns, self.order, self.schema = wait, remember, columns, order, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("first", f"given boolean, deadline bigint, row struct<{self.schema}>")

    def _given(self, row: tuple) -> pd.DataFrame:
        return pd.DataFrame({c: [v] for c, v in zip(self.columns, row, strict=True)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given, deadline, row = self.state.get() if self.state.exists() else (False, None, None)
        before, order = deadline, self.columns.index(self.order)
        for df in rows:
            for *own, at in df.sort_values("at_ms")[[*self.columns, "at_ms"]].itertuples(index=False, name=None):
                # whether a row comes after closing is told by its own time, not by when the timer fires
                if deadline is None or at > deadline + (0 if given else self.remember):
                    if deadline is not None and not given:
                        yield self._given(row)
                    given, deadline, row = False, int(at) + self.wait, tuple(map(_text, own))
                elif not given and at <= deadline and own[order] < row[order]:
                    row = tuple(map(_text, own))
        if deadline != before and deadline is not None:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(deadline)
        if not given and row is not None:
            self.state.update((False, deadline, tuple(row)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        given, deadline, row = self.state.get()
        if given or not self.remember:
            self.state.clear()
        else:
            self.handle.registerTimer(deadline + self.remember)
            self.state.update((True, deadline + self.remember, None))
        if not given:
            yield self._given(row)

    def close(self) -> None:
        pass


def first_rows_stream(df: DataFrame, key: str = "prompt", order: str = "ord", ts: str = "ts", watermark: str = WATERMARK, wait: str = "10 minutes",
                      remember: str = "1 day", keep: list[str] | None = None) -> DataFrame:
    """D1 on a stream: of the rows with equal ``dedup_key`` the one with the least ``order``, emitted when
    its key closes. Rows without an order take no part. The state holds the columns ``keep`` (with
    ``order`` among them; by default all but ``ts``)."""
    columns = keep or [c for c in df.columns if c != ts]
    x = df.withColumn(ts, as_utc_instant(ts, df.schema[ts].dataType)).withWatermark(ts, watermark).where(F.col(order).isNotNull())
    x = x.select(dedup_key(key).alias("_key"), *columns, F.unix_millis(ts).alias("at_ms"), ts)
    out = T.StructType([df.schema[c] for c in columns])
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in out.fields)
    processor = FirstRow(_millis(wait), _millis(remember), columns, order, fields)
    return x.groupBy("_key").transformWithStateInPandas(processor, out, "Append", "EventTime")


def close_first_rows(emitted: DataFrame, df: DataFrame, key: str = "prompt", order: str = "ord") -> DataFrame:
    """The closing step for a finite source: the stream's rows and, from a batch over the same
    ``df``, the first rows of the keys it has given none for."""
    given = df.join(emitted.select(order), order, "left_semi").select(dedup_key(key).alias("_g"))
    keyed = df.where(F.col(order).isNotNull()).withColumn("_key", dedup_key(key))
    rest = keyed.join(given, keyed["_key"].eqNullSafe(given["_g"]), "left_anti").drop("_key")
    return emitted.unionByName(deduplicate(rest, key, order).select(*emitted.columns))
