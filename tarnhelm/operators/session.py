"""Session operators over ordered events; the streaming module shares the state steps.

Text is reduced inside the JVM to the few fields a state needs (flags, hashed targets,
bounded tails) before any ordering happens, so only small rows are shuffled.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnhelm.functions.text import shape_of
from tarnhelm.operators.detect import CREDENTIAL_SHAPES, credential_hits
from tarnhelm.operators.ordered import with_history
from tarnhelm.sources.stored import keep

@dataclass(frozen=True)
class Limits:
    """How much of a session a state carries; None means all.

    ``window``: characters of a run, head or tail. ``fragments``, ``candidates``: runs of one
    event. ``pieces``, ``assembly``: writes and characters that are put together. ``turns``:
    prompts a tail is carried over. ``targets``: destinations remembered.
    """

    window: int
    fragments: int | None
    candidates: int | None
    pieces: int | None
    assembly: int
    turns: int | None
    targets: int | None


#: Characters alone bound what is put together: enough for the longest credentials, private
#: keys included, however small the pieces.
LIMITS = Limits(4096, None, None, None, 16_384, None, None)
#: The upstream's limits.
UPSTREAM = Limits(64, 3, 24, 12, 512, 3, 8)

# Prefixes a split secret starts with and life times.
ANCHOR_HEADS = (
    "sk-ant-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "AKIA", "ASIA", "rzp_live_",
    "rzp_test_", "xox", "AIza", "sk_live_", "sk_test_", "rk_live_", "rk_test_", "eyJ",
    "-----BEGIN",
)
BRIDGE_TTL = 3600
RISK_TTL = 7200
HALF_LIFE = 1200.0
BAND_LOW, BAND_HIGH = 0.35, 0.75
FRAGMENTS_PER_BAND = {"low": 3, "medium": 6, "high": 10}

RUN = r"([A-Za-z0-9+/=_.\-]{4,})"
DAY = 86_400


def _partial_anchor() -> str:
    """A run that starts with a whole prefix or ends in a part of one."""
    heads = "|".join(re.escape(a) for a in ANCHOR_HEADS)
    parts = sorted({a[:n] for a in ANCHOR_HEADS for n in range(2, len(a))}, key=len)
    tails = "|".join(re.escape(p) for p in parts)
    return rf"\A(?:{heads})|(?:{tails})\z"


PARTIAL_ANCHOR = _partial_anchor()


def _first(runs: Column, n: int | None) -> Column:
    return runs if n is None else F.slice(runs, 1, n)


def fragments_of(text: Column, limits: Limits = LIMITS) -> Column:
    """Runs that look like a piece of a secret, each the last ``window`` characters."""
    runs = F.transform(
        F.regexp_extract_all(text, F.lit(RUN), F.lit(1)),
        lambda r: F.right(r, F.lit(limits.window)),
    )
    return _first(F.filter(runs, lambda r: r.rlike(PARTIAL_ANCHOR)), limits.fragments)


def candidates_of(text: Column, limits: Limits = LIMITS) -> Column:
    """Leading runs a carried fragment may continue in."""
    runs = F.regexp_extract_all(text, F.lit(RUN), F.lit(1))
    return F.transform(
        _first(runs, limits.candidates), lambda r: F.left(r, F.lit(limits.window)))


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def split_on_gap(
    events: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, ttl: float,
    block: int = DAY,
) -> DataFrame:
    """Adds ``_segment``: state older than ``ttl`` is forgotten, so the events after a
    longer pause are an independent group, named by the time of its first event.

    A key is cut into blocks of ``block`` seconds. Events are shuffled once, by key and block;
    one row per block says what the next ones need.
    """
    c = F.col
    keys = list(keys)
    rows = events.withColumn("_block", F.floor(c(at) / block))
    inside = W.partitionBy(*keys, "_block").orderBy(*order)
    pause = c(at) - F.lag(at).over(inside) > ttl
    rows = rows.withColumn("_opens", F.when(pause, c(at)))
    rows = rows.withColumn(
        "_inner", F.max("_opens").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    across = W.partitionBy(*keys).orderBy("_block")
    blocks = rows.groupBy(*keys, "_block").agg(
        F.min(at).alias("_first"), F.max(at).alias("_end"), F.max("_opens").alias("_open"))
    before = F.lag("_end").over(across)
    blocks = blocks.withColumn(
        "_fresh", F.when(before.isNull() | (c("_first") - before > ttl), c("_first")))
    carried = F.last(F.coalesce("_open", "_fresh"), ignorenulls=True).over(
        across.rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.select(*keys, "_block", F.coalesce("_fresh", carried).alias("_entered"))
    return rows.join(blocks, [*keys, "_block"]).select(
        *events.columns, F.coalesce("_inner", "_entered").alias("_segment"))


# ------------------------------------------------------------------ session risk

RISK_SCHEMA = "risk double, band string, fragments int, escalate boolean"


def risk_inputs(
    events: DataFrame, text: str = "text", keep: Sequence[str] = (), limits: Limits = LIMITS
) -> DataFrame:
    """Signals of one event; the text itself is dropped."""
    c = F.col(text)
    targets = F.transform(
        F.regexp_extract_all(c, F.lit(r">>\s*(\S+)"), F.lit(1)),
        lambda t: F.substring(F.sha2(t, 256), 1, 12),
    )
    blocked = F.col("blocked") if "blocked" in events.columns else F.lit(False)
    return events.select(
        "session_id", "seq", seconds(F.col("ts")).alias("at"),
        (F.size(fragments_of(c, limits)) > 0).alias("had_fragment"),
        c.rlike(r"[A-Za-z0-9+/=_\-]{16}").alias("had_entropy"),
        F.coalesce(blocked, F.lit(False)).alias("was_blocked"),
        targets.alias("targets"), *keep,
    )


class Recent:
    """Destinations in the order they were first seen; beyond ``limit`` the oldest goes."""

    def __init__(self) -> None:
        self.order: dict[str, None] = {}

    def add(self, target: str, limit: int | None) -> bool:
        """Remember a destination; True if it was known."""
        if target in self.order:
            return True
        self.order[target] = None
        if limit is not None and len(self.order) > limit:
            del self.order[next(iter(self.order))]
        return False

    def clear(self) -> None:
        self.order.clear()


def new_risk() -> dict:
    return {"f": 0.0, "r": 0.0, "e": 0.0, "b": 0.0, "targets": Recent(), "at": None}


def risk_step(
    state: dict, at: float, fragment: bool, entropy: bool, blocked: bool,
    targets: Sequence[str], limits: Limits = LIMITS,
) -> tuple[dict, tuple]:
    """Decay the counters to ``at``, add one event, and grade the session: the form a stream
    uses, event by event."""
    if state["at"] is not None and at - state["at"] > RISK_TTL:
        state["targets"].clear()
        state = {**new_risk(), "targets": state["targets"]}
    if state["at"] is None:
        state["at"] = at
    elif at > state["at"]:
        keep = 0.5 ** ((at - state["at"]) / HALF_LIFE)
        for k in "freb":
            state[k] *= keep
        state["at"] = at
    state["f"] += bool(fragment)
    state["b"] += bool(blocked)
    state["e"] += bool(entropy)
    state["r"] += sum(state["targets"].add(t, limits.targets) for t in targets)
    f, r, e, b = (round(state[k], 12) for k in "freb")
    value = 0.30 * min(f, 4.0) + 0.18 * min(r, 4.0) + 0.05 * min(e, 4.0) + 0.25 * min(b, 2.0)
    value = max(0.0, min(1.0, value))
    band = "high" if value >= BAND_HIGH else "medium" if value >= BAND_LOW else "low"
    risk = math.floor(value * 1000 + 0.5) / 1000
    return state, (risk, band, FRAGMENTS_PER_BAND[band], band == "high")


#: Seconds of a session that are summed together; three half-lives.
RISK_BLOCK = 3600
#: Blocks whose counters are carried. What is older has faded by 2 ** -72, below the precision
#: of a double beside any newer event and of the three digits of a risk alone.
RISK_CARRIED = 24


def _first_seen(rows: DataFrame, limits: Limits) -> DataFrame:
    """How many destinations every event adds to what its session remembers (``_new``).

    Without a limit that is a minimum per destination. With one, only sessions that pass it
    forget anything; those are replayed in order with as many names as the limit says.
    """
    group = ["session_id", "_segment"]
    named = rows.where(F.size("targets") > 0).select(
        *group, "at", "seq", F.posexplode("targets").alias("_place", "target"))
    first = named.groupBy(*group, "target").agg(F.min(F.struct("at", "seq")).alias("_seen"))
    new = first.groupBy(*group, "_seen").agg(F.count("*").alias("_new")).select(
        *group, "_seen.*", "_new")
    if limits.targets is None:
        return new
    crowded = first.groupBy(*group).agg(F.count("*").alias("_n")).where(
        F.col("_n") > limits.targets).select(*group)
    schema = ", ".join(f"{n} {t}" for n, t in new.dtypes)

    def replay(batches: Iterator) -> Iterator:
        import pandas as pd

        key, recent = None, Recent()
        for pdf in batches:
            new_names = []
            for r in pdf.itertuples(index=False):
                if (r.session_id, r.segment) != key:
                    key, recent = (r.session_id, r.segment), Recent()
                new_names.append(0 if recent.add(r.target, limits.targets) else 1)
            yield pd.DataFrame({
                "session_id": pdf["session_id"], "_segment": pdf["segment"], "at": pdf["at"],
                "seq": pdf["seq"], "_new": new_names})

    replayed = (
        named.join(crowded, group, "left_semi").withColumnRenamed("_segment", "segment")
        .repartition("session_id", "segment")
        .sortWithinPartitions("session_id", "segment", "at", "seq", "_place")
        .mapInPandas(replay, schema)
        .groupBy(*group, "at", "seq").agg(F.sum("_new").alias("_new")))
    return new.join(crowded, group, "left_anti").unionByName(replayed)


def session_risk(
    events: DataFrame, text: str = "text", limits: Limits = LIMITS
) -> DataFrame:
    """Risk after every event. Events: session_id, ts, seq, text, optionally blocked.

    A counter is the sum of its events, each halved every ``HALF_LIFE`` seconds. Such sums add
    up over blocks of time, so a long session is spread over tasks: sums run inside a block, one
    row per block carries its total on. An event is known by session_id, ts and seq; those of one
    time and seq count together. Events without a session or a time have no risk.
    """
    return _grade(keep(risk_inputs(events, text, limits=limits)), limits)


def _grade(inputs: DataFrame, limits: Limits) -> DataFrame:
    """Risk after every event from stored ``risk_inputs``, which are read several times."""
    c = F.col
    rows = keep(split_on_gap(
        inputs, ["session_id"], ["at", "seq"], "at", RISK_TTL, RISK_BLOCK))
    event = ["session_id", "_segment", "at", "seq"]
    rows = rows.join(_first_seen(rows, limits), event, "left")
    block = F.floor(c("at") / RISK_BLOCK)
    since = (c("at") - block * RISK_BLOCK) / HALF_LIFE
    own = {
        "f": c("had_fragment").cast("double"), "e": c("had_entropy").cast("double"),
        "b": c("was_blocked").cast("double"),
        "r": (F.greatest(F.size("targets"), F.lit(0)) - F.coalesce("_new", F.lit(0))).cast("double"),
    }
    rows = rows.select(
        "session_id", "seq", "at", "_segment", block.alias("_block"), since.alias("_since"),
        *[F.coalesce(x, F.lit(0.0)).alias(f"_{k}") for k, x in own.items()])
    unit = ["session_id", "_segment", "_block"]
    grown = {k: c(f"_{k}") * F.pow(F.lit(2.0), c("_since")) for k in own}
    # Totals as they stand at the end of a block.
    faded = 2.0 ** (-RISK_BLOCK / HALF_LIFE)
    totals = rows.groupBy(*unit).agg(*[(F.sum(x) * faded).alias(k) for k, x in grown.items()])
    earlier = W.partitionBy("session_id", "_segment").orderBy("_block").rangeBetween(
        -RISK_CARRIED, -1)
    totals = totals.withColumn("_past", F.collect_list(F.struct("_block", *own)).over(earlier))

    def carried(k: str) -> Column:
        return F.aggregate("_past", F.lit(0.0), lambda a, p: a + p[k] * F.pow(
            F.lit(faded), c("_block") - p["_block"] - 1))

    totals = totals.select(*unit, *[carried(k).alias(f"_c_{k}") for k in own])
    before = W.partitionBy(*unit).orderBy("at", "seq").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns(
        {f"_s_{k}": F.coalesce(F.sum(x).over(before), F.lit(0.0)) for k, x in grown.items()})
    fade = F.pow(F.lit(2.0), -c("_since"))
    now = {
        k: c(f"_{k}") + (c(f"_s_{k}") + c(f"_c_{k}")) * fade for k in own}
    f, r, e, b = (F.round(now[k], 12) for k in "freb")
    value = (
        F.least(f, F.lit(4.0)) * 0.30 + F.least(r, F.lit(4.0)) * 0.18
        + F.least(e, F.lit(4.0)) * 0.05 + F.least(b, F.lit(2.0)) * 0.25)
    graded = rows.join(totals, unit).select(
        "session_id", "seq", F.least(value, F.lit(1.0)).alias("_value"))
    value = c("_value")
    band = F.when(value >= BAND_HIGH, "high").when(value >= BAND_LOW, "medium").otherwise("low")
    places = F.create_map(*[F.lit(x) for kv in FRAGMENTS_PER_BAND.items() for x in kv])
    return graded.select(
        "session_id", "seq", (F.floor(value * 1000 + 0.5) / 1000).alias("risk"),
        band.alias("band"), places[band].alias("fragments"),
        (value >= BAND_HIGH).alias("escalate"))


def risk_records(
    events: DataFrame, risk: DataFrame, text: str = "text", limits: Limits = LIMITS
) -> DataFrame:
    """Escalation records of risky sessions: shapes only, never text."""
    shapes = F.transform(fragments_of(F.col(text), limits), lambda f: shape_of(f, 24))
    return events.join(risk.filter("escalate"), ["session_id", "seq"]).select(
        F.substring(F.col("session_id").cast("string"), 1, 8).alias("session"), "seq", "tool",
        "risk", "band", shapes.alias("shapes"),
    )


# ----------------------------------------------------------------- sink assembly


def piece_of(payload: Column, limits: Limits) -> Column:
    """A write as it is carried; limits on the number of pieces cut a single write as well."""
    return payload if limits.pieces is None else F.left(payload, F.lit(limits.assembly))


def sink_assembly(events: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """What the writes to one destination add up to.

    Events: session_id, ts, seq, sink, payload. An assembly starts at a payload that
    holds a piece of a secret and keeps the longest run of last pieces that fits the limits
    on pieces and characters. That run depends on the last rows only, so it is a sliding frame
    and needs no custom state. A single longer write is kept whole.
    """
    return _assemble(keep(sink_inputs(events, limits)), limits)


def sink_inputs(
    events: DataFrame, limits: Limits = LIMITS, extra: Sequence[str] = ()
) -> DataFrame:
    """Writes with their piece and whether a secret may start in it."""
    c = F.col
    return events.filter((c("sink") != "") & (F.trim("payload") != "")).select(
        "session_id", "sink", "seq", *extra, seconds(c("ts")).alias("at"),
        piece_of(c("payload"), limits).alias("piece"),
        (F.size(fragments_of(c("payload"), limits)) > 0).alias("starts"),
    )


def _assemble(rows: DataFrame, limits: Limits) -> DataFrame:
    c = F.col
    rows = split_on_gap(rows, ["session_id", "sink"], ["at", "seq"], "at", BRIDGE_TTL)
    group = W.partitionBy("session_id", "sink", "_segment").orderBy("at", "seq")
    rows = rows.withColumn(
        "_started", F.max(c("starts")).over(group.rowsBetween(W.unboundedPreceding, 0))
    ).filter("_started")
    # Places in the text so far. No write is empty, so places grow from write to write.
    upto = F.sum(F.length("piece")).over(group.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_upto", upto).withColumn("_from", c("_upto") - F.length("piece"))
    if limits.pieces is None:
        near = W.partitionBy("session_id", "sink", "_segment").orderBy("_from").rangeBetween(
            -limits.assembly, 0)
    else:
        near = group.rowsBetween(1 - limits.pieces, 0)
    rows = rows.withColumn("_last", F.collect_list(F.struct("_from", "piece")).over(near))
    # The longest run of last pieces that fits; the newest piece always stays.
    first = F.least(c("_from"), c("_upto") - limits.assembly)
    rows = rows.withColumn("_first", first).withColumn(
        "_kept", F.filter("_last", lambda p: p["_from"] >= c("_first")))
    return rows.filter(F.size("_kept") >= 2).select(
        "session_id", "sink", "seq", F.size("_kept").alias("pieces"),
        F.array_join(c("_kept.piece"), "").alias("assembled"))


def assembled_secrets(assembled: DataFrame) -> DataFrame:
    """Assemblies that form a credential, without the assembled text."""
    hits = credential_hits(F.col("assembled"))
    return assembled.withColumn(
        "classes", F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["entity_class"])))
    ).filter(F.size("classes") > 0).drop("assembled")


def sink_step(
    state: dict, at: float, piece: str, starts: bool, limits: Limits = LIMITS
) -> tuple[dict, str | None]:
    """One write to a destination in a stream; same rule as ``sink_assembly``."""
    pieces = state.get("pieces", [])
    if pieces and at - state["at"] > BRIDGE_TTL:
        pieces = []
    if not pieces and not starts:
        return {"pieces": [], "at": at}, None
    pieces = [*pieces, piece][-(limits.pieces or 0):]
    while len(pieces) > 1 and sum(map(len, pieces)) > limits.assembly:
        pieces = pieces[1:]
    return {"pieces": pieces, "at": at}, "".join(pieces) if len(pieces) >= 2 else None


# ----------------------------------------------------------------- prompt bridge

_SHAPES = [
    (s, re.compile(s.pattern), re.compile(s.prefix)) for s in CREDENTIAL_SHAPES
]


def _entropy(text: str) -> float:
    n = len(text)
    if n < 2:
        return 0.0
    return -sum(
        k / n * math.log2(k / n) for k in (text.count(ch) for ch in set(text))
    )


def jwt_header_is_json(token: str) -> bool:
    head = token.split(".", 1)[0]
    try:
        text = base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)).decode()
    except (ValueError, UnicodeDecodeError):
        return False
    return text.startswith("{")


def credential_classes(text: str) -> list[str]:
    """Classes of the credentials in a short text (two windows here)."""
    found = set()
    for shape, pattern, prefix in _SHAPES:
        if not any(a in text for a in shape.anchors):
            continue
        for m in pattern.finditer(text):
            body = prefix.sub("", m.group(0))
            ok = shape.body_entropy is None or round(_entropy(body), 9) >= shape.body_entropy
            if shape.full_length is not None:
                ok = ok or len(body) >= shape.full_length
            if shape.entity_class == "AWS_ACCESS_KEY":
                around = text[max(0, m.start() - 1) : m.start()] + text[m.end() : m.end() + 1]
                ok = ok and not any(ch.isalnum() or ch == "_" for ch in around)
            if shape.entity_class == "JWT":
                ok = ok and jwt_header_is_json(m.group(0))
            if ok:
                found.add(shape.entity_class)
    return sorted(found)


def new_bridge() -> dict:
    return {"tail": "", "turns": 0, "at": None}


def bridge_step(
    state: dict, at: float, head: str, last: str, blocked: bool, present: bool,
    limits: Limits = LIMITS,
) -> tuple[dict, list[str] | None]:
    """One prompt: join with the carried tail, remember it when it was allowed.

    Returns the classes the join forms, or None when nothing was joined.
    """
    if state["at"] is not None and at - state["at"] > BRIDGE_TTL:
        state = new_bridge()
    if blocked or not present:
        return state, None
    classes = None
    if state["tail"]:
        classes = credential_classes(state["tail"] + head)
        if classes:
            return new_bridge(), classes
    tail, turns = state["tail"], state["turns"]
    if limits.turns is not None and turns >= limits.turns:
        tail, turns = "", 0
    return {"tail": (tail + last)[-limits.window:], "turns": turns + 1, "at": at}, classes


def bridge_inputs(
    prompts: DataFrame, text: str = "text", keep: Sequence[str] = (), limits: Limits = LIMITS
) -> DataFrame:
    """First and last window of a prompt and whether it was blocked by itself."""
    c = F.col(text)
    blocked = (
        F.col("blocked") if "blocked" in prompts.columns
        else F.size(credential_hits(c)) > 0
    )
    return prompts.select(
        "session_id", "seq", seconds(F.col("ts")).alias("at"),
        F.left(c, F.lit(limits.window)).alias("head"),
        F.right(c, F.lit(limits.window)).alias("last"),
        blocked.alias("blocked"),
        c.rlike(r"\S").alias("present"), *keep,
    )


def _bridge_partition(batches: Iterator, limits: Limits) -> Iterator:
    import pandas as pd

    group, state = None, new_bridge()
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            key = (r.session_id, r.segment)
            if key != group:
                group, state = key, new_bridge()
            state, classes = bridge_step(
                state, r.at, r.head, r.last, bool(r.blocked), bool(r.present), limits
            )
            if classes is not None:
                out.append((r.session_id, r.seq, bool(classes), ",".join(classes)))
        yield pd.DataFrame(out, columns=["session_id", "seq", "split", "classes"])


def prompt_bridge(
    prompts: DataFrame, text: str = "text", limits: Limits = LIMITS
) -> DataFrame:
    """Joins of a prompt with the one before it, and the classes a join forms."""
    inputs = bridge_inputs(prompts, text, limits=limits)
    kinds = {f.name: f.dataType.simpleString() for f in inputs.schema.fields}
    split = split_on_gap(inputs, ["session_id"], ["at", "seq"], "at", BRIDGE_TTL)
    return (
        split.withColumnRenamed("_segment", "segment")
        .repartition("session_id", "segment")
        .sortWithinPartitions("session_id", "segment", "at", "seq")
        .mapInPandas(
            lambda batches: _bridge_partition(batches, limits),
            f"session_id {kinds['session_id']}, seq {kinds['seq']}, split boolean, "
            "classes string",
        )
    )


def fragment_bridge(
    events: DataFrame, text: str = "text", limits: Limits = LIMITS
) -> DataFrame:
    """Fragments of the previous call joined to the leading runs of this one.

    Only the call right before counts, so this is a lag. Off by default upstream of any
    decision: it over-reports on ordinary commands.
    """
    c = F.col(text)
    rows = events.select(
        "session_id", "seq", seconds(F.col("ts")).alias("at"),
        fragments_of(c, limits).alias("fragments"), candidates_of(c, limits).alias("runs"),
    )
    hist = with_history(
        rows, ["session_id"], ["at", "seq"], F.floor(F.col("at") / DAY),
        lags={"_carried": "fragments", "_before": "at"},
    ).filter((F.col("at") - F.col("_before") <= BRIDGE_TTL) & (F.size("_carried") > 0))
    joins = F.flatten(
        F.transform("_carried", lambda f: F.transform("runs", lambda r: F.concat(f, r)))
    )
    return hist.select("session_id", "seq", joins.alias("joins"))


def call_trace(events: DataFrame, text: str = "text", limits: Limits = LIMITS) -> DataFrame:
    """Per call: own verdict, sink, risk, and whether the assembled writes deny it.

    Events: session_id, ts, seq, tool, text, sink, payload. Joined text counts only when
    the call itself is clean.
    """
    own = F.size(credential_hits(F.col(text))) > 0
    marked = events.withColumn("own_block", own)
    # A call is reduced once to what its verdict, its risk and its destination need.
    calls = keep(risk_inputs(
        marked.withColumn("blocked", F.col("own_block")), text,
        ["tool", "sink", "own_block"], limits))
    risk = _grade(calls.drop("tool", "sink", "own_block"), limits)
    split = assembled_secrets(sink_assembly(events, limits)).select(
        "session_id", "seq", F.array_join("classes", ",").alias("split_classes")
    )
    keys = ["session_id", "seq"]
    return (
        calls.select(*keys, "tool", "sink", "own_block")
        .join(risk, keys).join(split, keys, "left")
        .withColumn("split", ~F.col("own_block") & F.col("split_classes").isNotNull())
        .withColumn("allow", ~F.col("own_block") & ~F.col("split"))
    )
