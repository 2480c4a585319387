"""Structured Streaming forms of the session operators.

Each keeps typed state per key (maps in the state store, keys dealt into groups) and shares its
step with the batch form, so a replay of the same events gives the same rows. A timer removes
state once the watermark has passed its life time; the steps compare event times as well, which
is what decides the result. Events later than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tarnhelm.operators import session as S

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _state_store(spark: SparkSession) -> None:
    """Typed state needs the RocksDB store; a session that names a store keeps its own."""
    if spark.conf.get(_PROVIDER, None) in (None, "") or "HDFSBacked" in spark.conf.get(_PROVIDER):
        spark.conf.set(_PROVIDER, _ROCKS)


#: Groups that keys are dealt into. A group is one call, so what a call costs is paid per group
#: and not per key; a group's rows of one micro-batch are sorted in memory.
GROUPS = 512


class _Timed(StatefulProcessor):
    """State of the keys of one group; a key's state ends ``ttl`` seconds after its last event.

    A key is the JSON of its columns. Its state is one row that ends with the time of its last
    event, read and written once per micro-batch. One timer per group removes what has ended.
    """

    ttl: int
    fields: str
    needs: tuple[str, ...]
    gives: tuple[str, ...]

    def __init__(self, limits: S.Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getMapState("kept", "key string", self.fields)
        self.sweep = handle.getValueState("sweep", "at bigint")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        pass

    def step(self, key: str, kept: tuple | None, rows: Iterator, out: list) -> tuple | None:
        """Take the rows of one key in order; the state that is left, if any."""
        raise NotImplementedError

    def forget(self, left: dict) -> None:
        """Remove what is kept beside the states that are ``left``."""

    def _until(self, kept: tuple) -> int:
        return int((kept[-1] or 0.0) * 1000) + self.ttl * 1000

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        import pandas as pd

        watermark = timerValues.getCurrentWatermarkInMs()
        frame = pd.concat([p[["key", *self.needs]] for p in rows])
        frame = frame.sort_values(["key", "at", "seq"], kind="stable")
        known, until, out = self.kept.exists(), 0, []
        for name, own in groupby(frame.itertuples(index=False), lambda r: r.key):
            old = self.kept.getValue((name,)) if known else None
            new = self.step(name, old, own, out)
            if new is not None and self._until(new) > watermark:
                self.kept.updateValue((name,), new)
                until = max(until, self._until(new))
            elif old is not None:
                self.kept.removeKey((name,))
        if until and self.sweep.get() is None:
            self._wake(until)
        yield pd.DataFrame(out, columns=["key", "seq", *self.gives])

    def _wake(self, until: int) -> None:
        self.handle.registerTimer(until)
        self.sweep.update((until,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        watermark = timerValues.getCurrentWatermarkInMs()
        left = {k[0]: v for k, v in self.kept.iterator()}
        for name in [k for k, v in left.items() if self._until(v) <= watermark]:
            self.kept.removeKey((name,))
            del left[name]
        self.forget(left)
        self.sweep.clear()
        if left:
            self._wake(max(map(self._until, left.values())))
        return iter(())

    def close(self) -> None:
        pass


class _StoredNames:
    """``session.Recent`` without a limit in the state store: only names asked for are read.

    A name is known if it was stored by the present generation, which is named by the time of
    its first event; forgetting begins another one.
    """

    def __init__(self, store, key: str, since: float | None):
        self.store, self.key, self.since = store, key, since
        self.now, self.stored, self.seen = None, since is not None, set()

    def add(self, target: str, limit: int | None) -> bool:
        if target in self.seen:
            return True
        self.seen.add(target)
        if self.stored and self.store.getValue((self.key, target)) == (self.since,):
            return True
        if self.since is None:
            self.since = float(self.now)
        self.store.updateValue((self.key, target), (self.since,))
        return False

    def clear(self) -> None:
        self.since, self.stored = None, False
        self.seen.clear()


class _Risk(_Timed):
    ttl = S.RISK_TTL
    fields = ("f double, r double, e double, b double, names array<string>, since double, "
              "at double")
    needs = ("at", "seq", "had_fragment", "had_entropy", "was_blocked", "targets")
    gives = ("risk", "band", "fragments", "escalate")

    def open(self, handle):
        self.names = handle.getMapState("names", "key string, target string", "since double")

    def step(self, key, kept, rows, out):
        f, r, e, b, names, since, at = kept or (0.0, 0.0, 0.0, 0.0, [], None, None)
        if self.limits.targets is None:
            targets = _StoredNames(self.names, key, since)
        else:
            targets = S.Recent()
            targets.order.update(dict.fromkeys(names or []))
        state = {"f": f, "r": r, "e": e, "b": b, "targets": targets, "at": at}
        for x in rows:
            targets.now = x.at
            state, graded = S.risk_step(
                state, x.at, x.had_fragment, x.had_entropy, x.was_blocked,
                [] if x.targets is None else list(x.targets), self.limits)
            out.append((key, x.seq, *graded))
        counters = [float(state[k]) for k in "freb"]
        if self.limits.targets is None:
            return (*counters, [], targets.since, float(state["at"]))
        return (*counters, list(targets.order), None, float(state["at"]))

    def forget(self, left):
        for name, since in list(self.names.iterator()):
            if name[0] not in left or left[name[0]][5] != since[0]:
                self.names.removeKey(tuple(name))


class _Bridge(_Timed):
    ttl = S.BRIDGE_TTL
    fields = "tail string, turns bigint, at double"
    needs = ("at", "seq", "head", "last", "blocked", "present")
    gives = ("split", "classes")

    def step(self, key, kept, rows, out):
        state = S.new_bridge() if kept is None else dict(zip(("tail", "turns", "at"), kept))
        for r in rows:
            state, classes = S.bridge_step(
                state, r.at, r.head, r.last, bool(r.blocked), bool(r.present), self.limits)
            if classes is not None:
                out.append((key, r.seq, bool(classes), ",".join(classes)))
        if state["at"] is None:
            return None
        return state["tail"], int(state["turns"]), float(state["at"])


class _Sink(_Timed):
    ttl = S.BRIDGE_TTL
    fields = "pieces array<string>, at double"
    needs = ("at", "seq", "piece", "starts")
    gives = ("pieces", "assembled")

    def step(self, key, kept, rows, out):
        state = {"pieces": list(kept[0]), "at": kept[1]} if kept else {"pieces": [], "at": 0.0}
        for r in rows:
            state, joined = S.sink_step(state, r.at, r.piece, bool(r.starts), self.limits)
            if joined is not None:
                out.append((key, r.seq, len(state["pieces"]), joined))
        return (state["pieces"], float(state["at"])) if state["pieces"] else None


def _timed(events: DataFrame, watermark: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def _run(inputs: DataFrame, keys: list[str], processor: _Timed, fields: str) -> DataFrame:
    _state_store(inputs.sparkSession)
    kind = dict(inputs.dtypes)
    dealt = inputs.select(
        F.pmod(F.xxhash64(*keys), F.lit(GROUPS)).alias("group"),
        F.to_json(F.struct(*keys)).alias("key"), "ts", *processor.needs)
    out = dealt.groupBy("group").transformWithStateInPandas(
        processor, f"key string, seq {kind['seq']}, {fields}", "Append", "EventTime")
    named = ", ".join(f"`{k}` {kind[k]}" for k in keys)
    return out.withColumn("key", F.from_json("key", named)).select(
        "key.*", *[c for c in out.columns if c != "key"])


def risk_stream(
    events: DataFrame, text: str = "text", watermark: str = "10 minutes",
    limits: S.Limits = S.LIMITS,
) -> DataFrame:
    """Risk after every event of a stream (session_id, ts, seq, text)."""
    inputs = S.risk_inputs(_timed(events, watermark), text, ["ts"], limits)
    return _run(inputs, ["session_id"], _Risk(limits), S.RISK_SCHEMA)


def bridge_stream(
    prompts: DataFrame, text: str = "text", watermark: str = "10 minutes",
    limits: S.Limits = S.LIMITS,
) -> DataFrame:
    """Prompt joins of a stream (session_id, ts, seq, text)."""
    inputs = S.bridge_inputs(_timed(prompts, watermark), text, ["ts"], limits)
    return _run(inputs, ["session_id"], _Bridge(limits), "split boolean, classes string")


def sink_stream(
    events: DataFrame, watermark: str = "10 minutes", limits: S.Limits = S.LIMITS
) -> DataFrame:
    """Assemblies of a stream (session_id, ts, seq, sink, payload)."""
    inputs = S.sink_inputs(_timed(events, watermark), limits, ["ts"])
    return _run(inputs, ["session_id", "sink"], _Sink(limits), "pieces int, assembled string")


def coverage_stream(
    requests: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes"
) -> DataFrame:
    """Coverage counters per window; rows later than the watermark are dropped."""
    c = F.col
    return (
        requests.withColumn("ts", c("ts").cast("timestamp"))
        .withWatermark("ts", watermark)
        .groupBy(F.window("ts", window), "harness", "route", "provider", "channel")
        .agg(
            F.count("*").alias("requests"),
            F.count_if(~c("outcome").isin("blocked", "failed")).alias("allowed"),
            F.count_if(c("outcome") == "blocked").alias("blocked"),
            F.count_if(c("outcome") == "failed").alias("failed"),
            F.max("ts").alias("last_seen"),
        )
    )


_COVERED = ("harness", "route", "provider", "channel")


class CoverageTable:
    """Coverage counters per window, kept as a table that a stream adds to.

    A stream with an append sink holds a window back until the watermark has passed it, so the
    last windows never come out. Here every micro-batch adds its counters to the table at
    ``path``, and ``windows`` sums them: each window is complete up to the last batch. Rows whose
    window had ended by the watermark, the latest time of earlier batches less ``delay``
    seconds, are not counted; ``late`` has their number per window. A batch that runs again
    replaces what it wrote.
    """

    def __init__(self, path: str, window: str = "5 minutes", delay: int = 600):
        self.path, self.window, self.delay = path, window, delay

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``. Rows: ts, harness, route, provider, channel, outcome."""
        rows = batch.withColumn("ts", F.col("ts").cast("timestamp"))
        rows = rows.withColumn("window", F.window("ts", self.window))
        seen = self._read(rows.sparkSession, "seen", "top timestamp, batch_id bigint").where(
            F.col("batch_id") < batch_id).agg(F.max("top")).first()[0]
        late = F.lit(False)
        if seen is not None:
            # A window is late if it ended at or before the watermark.
            late = F.col("window.end") <= F.lit(seen) - F.make_dt_interval(secs=F.lit(self.delay))
        rows.withColumn("late", late).groupBy("window", *_COVERED, "late").agg(
            F.count("*").alias("requests"),
            F.count_if(~F.col("outcome").isin("blocked", "failed")).alias("allowed"),
            F.count_if(F.col("outcome") == "blocked").alias("blocked"),
            F.count_if(F.col("outcome") == "failed").alias("failed"),
            F.max("ts").alias("last_seen"),
        ).write.mode("overwrite").parquet(f"{self.path}/counts/batch_id={batch_id}")
        rows.agg(F.max("ts").alias("top")).write.mode("overwrite").parquet(
            f"{self.path}/seen/batch_id={batch_id}")

    def _read(self, spark, part: str, schema: str) -> DataFrame:
        path = f"{self.path}/{part}"
        files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", path).parquet(path)

    def _counts(self, spark) -> DataFrame:
        return self._read(
            spark, "counts", "window struct<start:timestamp,end:timestamp>, harness string, "
            "route string, provider string, channel string, late boolean, requests bigint, "
            "allowed bigint, blocked bigint, failed bigint, last_seen timestamp, batch_id bigint")

    def windows(self, spark) -> DataFrame:
        sums = [F.sum(c).alias(c) for c in ("requests", "allowed", "blocked", "failed")]
        return self._counts(spark).where(~F.col("late")).groupBy("window", *_COVERED).agg(
            *sums, F.max("last_seen").alias("last_seen"))

    def late(self, spark) -> DataFrame:
        return self._counts(spark).where("late").groupBy("window").agg(
            F.sum("requests").alias("requests"))


def escalation_sink(path: str):
    """``foreachBatch`` writer of escalation features.

    Every batch is its own directory that a retry overwrites, so a replayed batch does not
    write twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write
