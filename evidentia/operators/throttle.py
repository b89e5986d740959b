"""Windows of one second that begin with an event: throttling without a walk in one task.

A category's window begins with its first event, and the next one with the first
event at least a second later, in order of arrival. A window can only begin with
an event that is later than all before it, so the walk runs over the running
maximum of time: its distinct values (marks), in slots of ``SLOT``. Inside a slot
every mark is followed to the first window start beyond the slot, at most
``SLOT`` steps for all marks at once; this needs the first marks of the next two
slots that have any. Only marks near a slot's beginning can be entered from
outside; their pointers are joined with themselves, which doubles the distance,
until no new start is reached. A mark that follows a silence of a second is a
start in any case, so the doubling only has to cover the longest burst.

No step holds a category or a host in one task: marks are grouped by slot, events
by chunk of arrivals. Only drop reports walk along a category, over its windows
with drops (one row a window).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .asof import running_max
from .ranking import null_safe_join
from .windows import THROTTLE_LIMITS

SECOND = 1_000_000
SLOT = 16 * SECOND
STRETCH = 32  # slots that one call of Python takes one after another
NONE = -(2**63)  # no number
CHUNK = 1 << 20
REPORT_INTERVAL = 5 * SECOND
KEYS = ["host", "category"]
STATE = "host string, category string, start_us bigint, count bigint, dropped bigint, reported_us bigint"


def limit_column(limits: dict[str, int] | None, common: int) -> Column:
    """The limit of a row's category: the common one if positive, else its own; null without a limit."""
    if common > 0:
        return F.lit(common).cast("bigint")
    known = {k: v for k, v in (THROTTLE_LIMITS if limits is None else limits).items() if v > 0}
    if not known:
        return F.lit(None).cast("bigint")
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), F.col("category")).cast("bigint")


def _slot(column: str, width: int) -> Column:
    return F.col(column) - F.pmod(F.col(column), F.lit(width))


def _follow(own: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """For each of a slot's marks the first start beyond the slot, if a window begins at the mark; -1 if there is none."""
    known = np.concatenate([own, np.unique(ahead)])
    step = np.append(np.searchsorted(known, own + SECOND), len(known))
    at = step[: len(own)]
    while (inside := at < len(own)).any():
        at = np.where(inside, step[np.minimum(at, len(own))], at)
    return np.where(at < len(known), known[np.minimum(at, len(known) - 1)], -1)


def _by_slot(
    rows: DataFrame, keys: list[str], width: int, rule: Callable[[int, dict[str, np.ndarray]], dict[str, np.ndarray]], columns: dict[str, str]
) -> DataFrame:
    """``rule`` of every slot's rows, as arrays by column; a group has the slots of a stretch of time, one after another.

    Missing numbers are ``NONE`` in the arrays that a rule takes and returns.
    """
    numbers = [f.name for f in rows.schema if f.dataType.typeName() == "long" and f.name != "slot"]
    rows = rows.withColumns({"stretch": F.call_function("div", F.col("slot"), F.lit(STRETCH * width).cast("bigint")), **{n: F.coalesce(F.col(n), F.lit(NONE)) for n in numbers}})

    def each(group: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(group["slot"].to_numpy(), kind="stable")
        arrays = {n: group[n].to_numpy()[order] for n in group.columns if n not in (*keys, "stretch")}
        slots, first = np.unique(arrays["slot"], return_index=True)
        ends = [*first[1:].tolist(), len(order)]
        parts = [rule(int(s), {n: v[a:b] for n, v in arrays.items()}) for s, a, b in zip(slots, first.tolist(), ends, strict=True)]
        out = pd.DataFrame({n: np.concatenate([p[n] for p in parts]) for n in columns})
        for key in reversed(keys):
            out.insert(0, key, group[key].iloc[0])
        return out

    made = rows.groupBy(*keys, "stretch").applyInPandas(each, ", ".join([*[f"`{k}` string" for k in keys], *[f"{n} {t}" for n, t in columns.items()]]))
    return made.select(*keys, *[F.nullif(F.col(n), F.lit(NONE)).alias(n) if t == "bigint" else F.col(n) for n, t in columns.items()])


def _pointers(marks: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``entry, target, certain`` of the marks at which a window may reach a slot."""
    late = F.min(F.when(F.col("at") >= F.col("slot") + SECOND, F.col("at")))
    slots = marks.groupBy(*keys, "slot").agg(F.min("at").alias("first"), F.max("at").alias("last"), late.alias("late"))
    along = Window.partitionBy(*keys).orderBy("slot")
    slots = cut_lineage(slots.withColumns({"before": F.lag("slot").over(along), "second": F.lag("slot", 2).over(along), "left": F.lag("last").over(along)}))
    early = marks.where(F.col("at") < F.col("slot") + SECOND)
    entries = early.select(*keys, "slot", "at").unionByName(slots.where("late is not null").select(*keys, "slot", F.col("late").alias("at")))
    sent = null_safe_join(entries, slots.where("before is not null").select(*keys, "slot", "before"), [*keys, "slot"], "inner")
    sent = sent.select(*keys, F.col("before").alias("slot"), "at").unionByName(slots.where("second is not null").select(*keys, F.col("second").alias("slot"), F.col("first").alias("at")))
    own = null_safe_join(marks.select(*keys, "slot", "at"), slots.select(*keys, "slot", "left"), [*keys, "slot"], "inner")
    rows = own.withColumn("ahead", F.lit(False)).unionByName(sent.withColumns({"left": F.lit(None).cast("long"), "ahead": F.lit(True)}))

    def follow(slot: int, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        at, is_ahead, left = rows["at"], rows["ahead"], rows["left"]
        own = np.unique(at[~is_ahead])
        target = _follow(own, at[is_ahead])
        left = left[left != NONE]
        before = np.concatenate([left[:1] if len(left) else own[:1] - SECOND, own[:-1]])
        n = int(np.searchsorted(own, slot + SECOND)) + 1  # those of the first second, and the next one
        return {"entry": own[:n], "target": np.where(target == -1, NONE, target)[:n], "certain": (own - before >= SECOND)[:n]}

    return _by_slot(rows, keys, width, follow, {"entry": "bigint", "target": "bigint", "certain": "boolean"})


def _reached(pointers: DataFrame, keys: list[str]) -> DataFrame:
    """The entries at which a window does begin: all that follow from the certain ones."""
    reached = cut_lineage(pointers.where("certain").select(*keys, "entry"))
    jumps = cut_lineage(pointers.where("target is not null").select(*keys, "entry", "target"))
    n = reached.count()
    while True:
        further = null_safe_join(reached, jumps, [*keys, "entry"], "inner").select(*keys, F.col("target").alias("entry"))
        reached = cut_lineage(reached.unionByName(further).distinct())
        before, n = n, reached.count()
        if n == before:
            return reached
        onwards = jumps.select(*keys, F.col("entry").alias("target"), F.col("target").alias("further"))
        jumps = cut_lineage(null_safe_join(jumps, onwards, [*keys, "target"], "inner").select(*keys, "entry", F.col("further").alias("target")))


def anchored(marks: DataFrame, keys: list[str], width: int = SLOT) -> DataFrame:
    """``marks`` (keys, ``at``, ``position``; rising together) with ``start`` and ``start_position`` of the window each lies in."""
    marks = marks.withColumn("slot", _slot("at", width))
    reached = _reached(cut_lineage(_pointers(marks, keys, width)), keys).withColumn("slot", _slot("entry", width))
    rows = marks.select(*keys, "slot", "at", "position", F.lit(False).alias("entry")).unionByName(
        reached.select(*keys, "slot", F.col("entry").alias("at"), F.lit(None).cast("long").alias("position"), F.lit(True).alias("entry"))
    )

    def walk(slot: int, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        own = np.flatnonzero(~rows["entry"])
        own = own[np.argsort(rows["at"][own], kind="stable")]
        at, position = rows["at"][own], rows["position"][own]
        begun = rows["at"][rows["entry"]]
        starts = []
        here = int(np.searchsorted(at, begun.min())) if len(begun) else len(at)
        while here < len(at):
            starts.append(here)
            here = int(np.searchsorted(at, at[here] + SECOND))
        which = np.searchsorted(np.array(starts, np.int64), np.arange(len(at)), "right") - 1
        of = np.array(starts or [0], np.int64)[np.maximum(which, 0)]
        begins = {name: np.where(which < 0, NONE, values[of]) if len(at) else at for name, values in (("start", at), ("start_position", position))}
        return {"slot": np.full(len(at), slot), "at": at, **begins}

    walked = cut_lineage(_by_slot(rows, keys, width, walk, {n: "bigint" for n in ("slot", "at", "start", "start_position")}))
    # The window that is still open when a slot begins: the last start of the slots before.
    last = walked.groupBy(*keys, "slot").agg(F.max("start").alias("s"), F.max("start_position").alias("p"))
    earlier = Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    open_ = last.select(*keys, "slot", F.max("s").over(earlier).alias("s"), F.max("p").over(earlier).alias("p"))
    filled = null_safe_join(walked, open_, [*keys, "slot"], "left")
    return filled.select(*keys, "at", F.coalesce("start", "s").alias("start"), F.coalesce("start_position", "p").alias("start_position"))


def placed(events: DataFrame, state: DataFrame | None = None, width: int = SLOT, chunk_width: int = CHUNK) -> DataFrame:
    """``host, category, ingest_seq, us`` with ``start`` of the event's window and ``number``, its place in it.

    ``state`` has the open window of a category before these events (``STATE``).
    """
    keys, chunk = KEYS, F.call_function("div", F.col("ingest_seq"), F.lit(chunk_width).cast("bigint"))
    rows = cut_lineage(events.withColumn("chunk", chunk))
    counts = rows.groupBy(*keys, "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*keys, "chunk").orderBy("ingest_seq", "us")
    rows = null_safe_join(rows.withColumn("place", F.row_number().over(inside)), counts, [*keys, "chunk"], "left")
    rows = rows.withColumn("position", F.col("place") + F.col("before")).drop("place", "before")
    rows = running_max(rows, keys, "position", "chunk", {"at": F.col("us")})
    if state is not None:
        begun = state.select(*keys, F.col("start_us").alias("begun"), F.col("count").alias("so_far"))
        rows = null_safe_join(rows, begun, keys, "left").withColumn("at", F.greatest("at", "begun")).drop("begun", "so_far")
    rows = cut_lineage(rows)
    marks = rows.groupBy(*keys, "at").agg(F.min("position").alias("position"))
    if state is not None:
        # The open window as a mark before the first event; events at its very time belong to it anyway.
        open_ = state.where("start_us is not null").select(*keys, F.col("start_us").alias("at"), (1 - F.col("count")).alias("position"))
        marks = marks.unionByName(open_).groupBy(*keys, "at").agg(F.min("position").alias("position"))
    windows = anchored(cut_lineage(marks), keys, width)
    found = null_safe_join(rows, windows, [*keys, "at"], "left")
    return found.select(*keys, "ingest_seq", "us", "start", (F.col("position") - F.col("start_position") + 1).alias("number"))


def _reports(windows: DataFrame, state: DataFrame | None) -> DataFrame:
    """Drop reports of each category, and its state afterwards.

    ``windows`` has a row for each of a category's windows that may matter: its
    ``start``, how many events it holds (``total``), how many of them are new
    drops (``over``) and its first event's arrival number (``seq``; null if the
    window was open before).
    """
    known = windows.withColumns({n: F.lit(None).cast("long") for n in ("dropped", "reported")})
    if state is not None:
        held = state.select(*KEYS, *[F.lit(None).cast("long").alias(n) for n in ("start", "seq", "total", "over")], "dropped", F.col("reported_us").alias("reported"))
        known = known.unionByName(null_safe_join(held, windows.select(*KEYS).distinct(), KEYS, "left_semi"))

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        before = group[group["start"].isna()]
        dropped = int(before["dropped"].fillna(0).sum())
        reported = before["reported"].dropna().max() if before["reported"].notna().any() else None
        out, start, total = [], None, 0
        rows = group[group["start"].notna()].sort_values("start")
        for start, seq, total, over in rows[["start", "seq", "total", "over"]].itertuples(index=False, name=None):
            if not pd.isna(seq) and dropped > 0 and (reported is None or start - reported >= REPORT_INTERVAL):
                out.append((seq, start, dropped, None))
                reported, dropped = start, 0
            dropped += int(over)
        out.append((None, start, dropped, total))
        made = pd.DataFrame(out, columns=["ingest_seq", "us", "dropped", "count"]).astype("Int64")
        made["reported"] = pd.array([pd.NA if reported is None else int(reported)] * len(made), "Int64")
        for key in reversed(KEYS):
            made.insert(0, key, group[key].iloc[0])
        return made

    return known.groupBy(*KEYS).applyInPandas(walk, "host string, category string, ingest_seq bigint, us bigint, dropped bigint, count bigint, reported bigint")


def throttled(
    events: DataFrame, limits: dict[str, int] | None = None, common: int = 0, state: DataFrame | None = None, width: int = SLOT, chunk_width: int = CHUNK
) -> tuple[DataFrame, DataFrame]:
    """What an anchored throttle lets through of ``host, category, ingest_seq, ts``, with its drop reports, and its state afterwards.

    Rows are ``host, category, ingest_seq, ts_us, kind, dropped``: ``pass`` for an
    event within its window's limit, ``warning`` for a report of the drops so far,
    which is due with the first event of a window and every five seconds at most.
    Categories without a limit pass. Arrival numbers order the events of a host;
    one window after another may fill up with events whose times lie back.
    """
    limit = limit_column(limits, common)
    rows = events.select("host", "category", "ingest_seq", F.unix_micros("ts").alias("us"))
    free = rows.where(limit.isNull()).select(*KEYS, "ingest_seq", F.col("us").alias("ts_us"), F.lit("pass").alias("kind"), F.lit(None).cast("long").alias("dropped"))
    found = cut_lineage(placed(rows.where(limit.isNotNull()), state, width, chunk_width).withColumn("lim", limit))
    passed = found.where("number <= lim").select(*KEYS, "ingest_seq", F.col("us").alias("ts_us"), F.lit("pass").alias("kind"), F.lit(None).cast("long").alias("dropped"))

    windows = found.groupBy(*KEYS, "start", "lim").agg(
        F.max("number").alias("total"), F.min(F.when(F.col("number") == 1, F.col("ingest_seq"))).alias("seq"), F.count_if(F.col("number") > F.col("lim")).alias("over")
    )
    if state is None:
        # Without drops owed nothing is reported: the walk needs windows with drops, and those behind them until five seconds are over.
        along = Window.partitionBy(*KEYS).orderBy("start")
        owing = F.max(F.when(F.col("over") > 0, F.col("start"))).over(along.rowsBetween(Window.unboundedPreceding, -1))
        windows = windows.withColumns({"waits": F.lag("start").over(along) - owing < REPORT_INTERVAL, "last": F.lead("start").over(along).isNull()})
        windows = windows.where((F.col("over") > 0) | F.col("last") | F.col("waits"))
    told = _reports(windows.select(*KEYS, "start", "seq", "total", "over"), state)
    told = cut_lineage(told)
    warnings = told.where("count is null").select(*KEYS, "ingest_seq", F.col("us").alias("ts_us"), F.lit("warning").alias("kind"), "dropped")
    after = told.where("count is not null").select(*KEYS, F.col("us").alias("start_us"), "count", "dropped", F.col("reported").alias("reported_us"))
    if state is not None:
        after = after.unionByName(null_safe_join(state.select(*after.columns), after.select(*KEYS), KEYS, "left_anti"))
    return free.unionByName(passed).unionByName(warnings), after
