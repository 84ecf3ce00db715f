"""Streaming operators. Those of built-in primitives run on batch and streaming input alike; keyed state has a batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import lexicon as lx
from ..functions.text import first_match, hits, java, quotes, redact, redact_json
from ..operators.detectors import unchanged, urgency_claims, urgency_said
from ..sources.committed import commit_batch


def _timed(events: DataFrame) -> DataFrame:
    """Streams need a time with a zone for their watermarks."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")) if events.isStreaming else events


def page_flags(snapshots: DataFrame) -> DataFrame:
    """Checks that one page can answer, on batch or stream: snapshots (id, …, full_text, checkboxes, buttons, links) to rows
    (…, pattern_code, ord, quote). They are weaker than the detectors: urgency is unverified, and guilt counts on any
    button or link. Null arrays hold nothing."""
    keep = [c for c in snapshots.columns if c not in ("full_text", "checkboxes", "buttons", "links")]
    flag = lambda code, ord_, quote: F.struct(F.lit(code).alias("pattern_code"), F.lit(ord_).cast("int").alias("ord") if isinstance(ord_, int) else ord_.cast("int").alias("ord"), quote.alias("quote"))
    none = F.array().cast("array<struct<pattern_code:string,ord:int,quote:string>>")
    label = lambda x: quotes(F.coalesce(x["label_text"], F.lit("")))
    ticked = lambda x: F.coalesce(x["is_prechecked"], F.lit(False))
    each = lambda test, code, quote: F.transform(F.filter("checkboxes", test), lambda x: flag(code, 0, quote(x)))
    said = F.concat(*[F.transform(F.coalesce(c, F.array().cast(snapshots.schema[c].dataType)), lambda x: x["text"]) for c in ("buttons", "links")])
    numbered = F.transform(said, lambda x, i: F.struct(x.alias("text"), i.alias("i")))
    urgent = [F.when(quotes(F.col("full_text")).rlike(java(p)), flag("DP-01", i, F.regexp_substr(quotes(F.col("full_text")), F.lit(java(p))))) for i, p in enumerate(lx.PAGE_URGENCY)]
    found = [
        each(lambda x: ticked(x) & label(x).rlike(java(lx.PAGE_CHARGE)), "DP-02", lambda x: x["label_text"]),
        each(lambda x: ticked(x) & hits(label(x), lx.PAGE_RECURRING), "DP-12", lambda x: first_match(label(x), lx.PAGE_RECURRING)),
        each(lambda x: hits(label(x), lx.PAGE_DOUBLE_NEGATIVE) | (ticked(x) & hits(label(x), lx.PAGE_OPT_OUT)), "DP-11", lambda x: x["label_text"]),
        F.transform(F.filter(numbered, lambda x: (F.char_length(x["text"]) > 8) & hits(x["text"], lx.PAGE_GUILT)), lambda x: flag("DP-03", x["i"], x["text"])),
        F.when(hits(F.col("full_text"), lx.PAGE_URGENCY), F.array_compact(F.array(*urgent))),
    ]
    return snapshots.select(*keep, F.explode(F.concat(*[F.coalesce(f, none) for f in found])).alias("f")).select(*keep, "f.*")


def live_pattern_counts(events: DataFrame, kind: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by window of event time; later than the watermark is dropped."""
    w = F.window("ts", size, slide or size)
    return _timed(events).withWatermark("ts", late).groupBy(w, kind).agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), kind, "n")


def debounced_snapshots(events: DataFrame, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """The last snapshot of each burst of changes: (key, start, last, n)."""
    df = _timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("last"), F.count("*").alias("n"))
    return df.select(key, F.col("session_window.start").cast("timestamp_ntz").alias("start"), "last", "n")


def dedupe_evaluations(events: DataFrame, key: list[str], late: str = "10 minutes") -> DataFrame:
    return _timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)


def first_price_drip(events: DataFrame, key: str, price: str, session_day: str = "day") -> DataFrame:
    """Batch: rows whose price is above 1.02 times the first of their key and session."""
    w = Window.partitionBy(key, session_day).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("first_price", F.first(price).over(w)).where(F.col(price) > F.col("first_price") * 1.02)


def _as_text(events: DataFrame, *ids: str) -> DataFrame:
    """Ids on their way through pandas as text: beside a null, numbers would turn into floats."""
    return events.withColumns({c: F.col(c).cast("string") for c in ids})


def _micros(x: pd.Timestamp) -> int:
    return int(x.value // 1000) if x.unit == "ns" else int(x.as_unit("us").value)


def _keyed(events: DataFrame, late: str, keys: list[str], ids: list[str], processor: StatefulProcessor, out: str, types: dict[str, str]) -> DataFrame:
    """A processor over keyed state with event-time timers. The session must name a state store that knows them:
    spark.sql.streaming.stateStore.providerClass = ...RocksDBStateStoreProvider (STATE_STORE)."""
    df = _as_text(_timed(events), *ids).withWatermark("ts", late)
    got = df.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime")
    return got.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in got.columns])


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Expiring(StatefulProcessor):
    """State of a key that goes `ttl` milliseconds of event time after its last event: one timer for each key, moved on."""

    ttl: int

    def _stay(self, rows: pd.DataFrame, watermark: int) -> None:
        until = max([watermark, *(_micros(x) // 1000 for x in rows["ts"])]) + self.ttl
        timers = [*self.handle.listTimers()]
        if not timers or max(timers) < until:
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(until)

    def _order(self, rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
        rows = pd.concat([*rows])
        return rows.assign(_n=[-1 if x is None or x != x else int(x) for x in rows[by[-1]]]).sort_values([*by[:-1], "_n"], kind="stable")


class _FirstPrice(_Expiring):
    """ValueState: a key's first price."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.first = handle, handle.getValueState("first", "price double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = self._order(rows, "ts", "event_id")
        if not self.first.exists():
            known = rows["price"].dropna()
            if len(known):
                self.first.update((float(known.iloc[0]),))
        self._stay(rows, timerValues.getCurrentWatermarkInMs())
        if self.first.exists():
            first = self.first.get()[0]
            yield rows[rows["price"] > first * 1.02].assign(first_price=first)[["key", "event_id", "price", "first_price"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.first.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_price_stream(events: DataFrame, late: str = "10 minutes", ttl: int = 3600) -> DataFrame:
    """Streaming twin for (key, ts, event_id, price): a key's first price is kept for `ttl` seconds of event time after its last
    event. Null prices are passed over; null keys are one key."""
    return _keyed(events, late, ["key"], ["key", "event_id"], _FirstPrice(ttl * 1000), "key string, event_id string, price double, first_price double", {"key": "long", "event_id": "long"})


def _admitted(times: list[float], limit: int, window: float, taken: list[float]) -> tuple[list[bool], list[float]]:
    """Flags of events in order of time, and the latest admitted times, `limit` at most: no more are ever looked at."""
    flags = []
    for t in times:
        taken = [x for x in taken[-limit:] if x > t - window]
        flags.append(len(taken) < limit)
        if flags[-1]:
            taken.append(t)
    return flags, taken[-limit:]


ADMITTED = "key string, event_id string, admitted boolean"


def _admit(limit: int, window: float):
    """Over rows sorted by (key, run, at, event): one pass that carries the run's admitted times from batch to batch, and holds no run whole."""
    def passed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, taken = None, []
        for b in batches:
            flags = []
            for key, nth, at in zip(b["key"], b["run"], (b["at"] / 1e6).tolist(), strict=True):
                if run != (key, nth):
                    run, taken = (key, nth), []
                (flag,), taken = _admitted([at], limit, window, taken)
                flags.append(flag)
            yield b.assign(admitted=flags)[["key", "event_id", "admitted"]]

    return passed


def admit_events(events: DataFrame, limit: int, window: float) -> DataFrame:
    """(key, event_id, admitted) of (key, ts, event_id): at most `limit` admitted in any `window` seconds; denied ones don't count.

    A key's events are cut where it pauses for as long as the window, since nothing carries over: a hot key becomes many
    groups, and groups of no more than `limit` events are all admitted without being looked at. Null keys are one key.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    w = Window.partitionBy("key").orderBy("at", "event_id")
    gap = F.coalesce(F.col("at") - F.lag("at").over(w) >= window * 1e6, F.lit(False))
    runs = events.select("key", at, "event_id").withColumn("gap", gap.cast("int")).withColumn("run", F.sum("gap").over(w))
    runs = runs.withColumn("n", F.count("*").over(Window.partitionBy("key", "run"))).drop("gap")
    few = runs.where(F.col("n") <= limit).select("key", "event_id", F.lit(True).alias("admitted"))
    busy = runs.where(F.col("n") > limit).select("key", "run", "at", "event_id").repartition("key", "run").sortWithinPartitions("key", "run", "at", "event_id")
    many = _as_text(busy, "key", "event_id").mapInPandas(_admit(limit, window), ADMITTED)
    kinds = {c: few.schema[c].dataType for c in ("key", "event_id")}
    return few.union(many.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()], "admitted"))


class _Admission(_Expiring):
    """ListState: the latest admitted times of a key, `limit` at most."""

    def __init__(self, limit: int, window: float):
        self.limit, self.window, self.ttl = limit, window, int(window * 1000) + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.taken = handle, handle.getListState("taken", "at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = self._order(rows, "ts", "event_id")
        before = [x[0] for x in self.taken.get()] if self.taken.exists() else []
        flags, taken = _admitted([_micros(x) / 1e6 for x in rows["ts"]], self.limit, self.window, before)
        if taken != before:
            self.taken.put([(x,) for x in taken])
        self._stay(rows, timerValues.getCurrentWatermarkInMs())
        yield rows.assign(admitted=flags)[["key", "event_id", "admitted"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.taken.clear()
        return iter(())

    def close(self) -> None:
        pass


def admit_stream(events: DataFrame, limit: int, window: float, late: str = "10 minutes") -> DataFrame:
    """Streaming twin: a key keeps its latest admitted times and is forgotten a window of event time after its last event.
    Within a batch a key's events are taken in order of time."""
    return _keyed(events.select("key", "ts", "event_id"), late, ["key"], ["key", "event_id"], _Admission(limit, window), ADMITTED, {"key": "long", "event_id": "long"})


class _Nagging(_Expiring):
    """MapState: by signature, where it was dismissed first and last, and how often, also at that last step; only signatures
    that a batch holds are read and written."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.gone = handle, handle.getMapState("gone", "signature string", "first int, last int, at_last int, times int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows, out = self._order(rows, "step_ord"), []
        for name, own in rows[rows["signature"].notna()].groupby("signature", sort=False):
            first, last, at_last, times = self.gone.getValue((name,)) if self.gone.containsKey((name,)) else (-1, -1, 0, 0)
            was = times
            for step, gone in zip(own["step_ord"].tolist(), own["dismissed"].tolist(), strict=True):
                before = times if step > last else times - at_last
                if before:
                    out.append((key[0], step, name, first, before))
                if gone:
                    first, last, at_last, times = first if times else step, step, at_last + 1 if step == last else 1, times + 1
            if times != was:
                self.gone.updateValue((name,), (first, last, at_last, times))
        self._stay(rows, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(out, columns=["trace_id", "step_ord", "signature", "first_gone", "times"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.gone.clear()
        return iter(())

    def close(self) -> None:
        pass


def nagging_stream(seen: DataFrame, ttl: int = 3600, late: str = "10 minutes") -> DataFrame:
    """Overlays (trace_id, ts, step_ord, signature, dismissed) that come back after an earlier step dismissed them: (trace_id,
    step_ord, signature, first_gone, times). Steps of a funnel come in order, at least from batch to batch; its dismissals are kept until
    `ttl` seconds of event time after its last step."""
    out = "trace_id string, step_ord int, signature string, first_gone int, times long"
    return _keyed(seen, late, ["trace_id"], ["trace_id"], _Nagging(ttl * 1000), out, {"trace_id": "long"})


def route_limits(requests: DataFrame, rules: list[tuple[str, str, int, int, str]], default: tuple[int, int] = (60, 60), trust_forwarded: bool = False) -> DataFrame:
    """Add limit, window (seconds), bucket and client: those of the first rule (method, path prefix, limit, window, bucket)
    that fits; all else shares one default bucket. The client is the first forwarded address only where that may be trusted."""
    out = F.struct(F.lit(default[0]).alias("limit"), F.lit(default[1]).alias("window"), F.lit("default").alias("bucket"))
    for method, prefix, limit, window, bucket in reversed(rules):
        rule = F.struct(F.lit(limit).alias("limit"), F.lit(window).alias("window"), F.lit(bucket).alias("bucket"))
        out = F.when((F.col("method") == method) & F.col("path").startswith(prefix), rule).otherwise(out)
    first = F.nullif(F.trim(F.split("forwarded", ",")[0]), F.lit("")) if trust_forwarded else F.lit(None).cast("string")
    got = requests.withColumns({"__rule": out, "client": F.coalesce(first, F.col("ip"), F.lit("unknown"))})
    return got.withColumns({c: F.col(f"__rule.{c}") for c in ("limit", "window", "bucket")}).drop("__rule")


def reload_staleness(first: DataFrame, second: DataFrame, within: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Urgency that a reload proves false, on batch or stream: captures (trace_id, step_name, ts, full_text) of first loads and
    reloads to (trace_id, step_name, ts, kind, value, again, again_at).

    Each capture carries its claim; a first load meets the reloads of its step that follow `within` that time, and the pair
    stays if the countdown hasn't gone down or the count is the same. Both sides have watermarks, so state is
    bounded; captures without a claim never enter it. Later than the watermark is dropped."""
    def side(df: DataFrame, name: str, keep: str) -> DataFrame:
        said = urgency_said(urgency_claims(F.col("full_text")))
        df = _timed(df).select("trace_id", "step_name", "ts", said.alias("u")).where("u.value != ''")
        return df.select("trace_id", "step_name", "ts", *([F.col("u.kind").alias("kind")] if keep == "value" else []), F.col("u.value").alias(keep)).withWatermark("ts", late).alias(name)

    near = F.expr(f"b.ts > a.ts AND b.ts <= a.ts + INTERVAL {within}")
    same = (F.col("a.trace_id") == F.col("b.trace_id")) & (F.col("a.step_name") == F.col("b.step_name"))
    df = side(first, "a", "value").join(side(second, "b", "again"), same & near).where(unchanged(F.col("kind"), F.col("value"), F.col("again")))
    return df.select("a.trace_id", "a.step_name", "a.ts", "kind", "value", "again", F.col("b.ts").alias("again_at"))


def findings_sink(path: str):
    """foreachBatch writer: explanation and evidence redacted, each batch committed by its id, so a repeated one changes nothing."""

    def write(df: DataFrame, batch: int) -> None:
        free = {c: f for c, f in (("explanation", redact), ("evidence", redact_json)) if c in df.columns}
        commit_batch(df.withColumns({c: f(F.col(c)) for c, f in free.items()}), path, str(batch))

    return write
