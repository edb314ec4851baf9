"""References to records that do not exist, kept as incremental state.

The state has: `index`, one row for each parent key (earliest load, earliest deletion); `pending`, the references whose parent
has not been seen; `parts`, the references whose parent is known, each with why it is a case, if it is one, appended
step by step; and `reopened`, which keys a later parent row changed. One step takes references and parents: new references
probe the index, arriving parents resolve waiting references, and a parent row that changes a key, such as a deletion,
reopens the references of that key, which are then judged anew. So the result does not depend on how rows are cut into
steps. Steps may come from a batch loop (track) or from a stream's foreachBatch (tamarind.streaming.orphans).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarind.plans.shared import keep_table
from tamarind.plans.skew import hot_keys, skew_join

KEYS = ["relation", "key"]


def normal_key(c: str | Column) -> Column:
    """Keys are compared without case and surrounding blanks; a blank key is null."""
    k = F.lower(F.trim(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^\s+|\s+$", "")))
    return F.when(F.length(k) > 0, k)


def references(df: DataFrame, relation: str, child_id: str, key: str, at: str, loaded: str) -> DataFrame:
    """Child rows of one relation as references: each child_id once, at its earliest load; null and blank keys refer to nothing.

    A redelivered row has the same content, so child, key and period are its identity here.
    """
    rows = df.select(F.lit(relation).alias("relation"), F.col(child_id).cast("string").alias("child_id"), normal_key(F.col(key).cast("string")).alias("key"), F.date_format(at, "yyyy-MM").alias("period"), F.col(loaded).alias("child_loaded"))
    return rows.where(F.col("key").isNotNull()).groupBy("relation", "child_id", "key", "period").agg(F.min("child_loaded").alias("child_loaded"))


def parents(df: DataFrame, relation: str, key: str, loaded: str, deleted: str | None = None) -> DataFrame:
    """Parent rows of one relation: key, load time, deletion time (null if never deleted)."""
    gone = F.col(deleted) if deleted else F.lit(None).cast("timestamp")
    rows = df.select(F.lit(relation).alias("relation"), normal_key(F.col(key).cast("string")).alias("key"), F.col(loaded).alias("parent_loaded"), gone.alias("deleted_at"))
    return rows.where(F.col("key").isNotNull())


@dataclass
class State:
    """index: relation, key, parent_loaded, deleted_at; pending: references; parts: (step, references with why); reopened: relation, key, step."""

    index: DataFrame
    pending: DataFrame
    parts: list[tuple[int, DataFrame]] = field(default_factory=list)
    reopened: DataFrame | None = None

    @property
    def step(self) -> int:
        return max((s for s, _ in self.parts), default=0)


def _reason() -> Column:
    """Why a reference whose parent is in the index is a case; null if it is none."""
    return F.when(F.col("deleted_at") <= F.col("child_loaded"), "deleted").when(F.col("parent_loaded") > F.col("child_loaded"), "late")


def empty(refs: DataFrame, pars: DataFrame) -> State:
    none = F.lit(False)
    return State(pars.where(none), refs.where(none))


def known(state: State, hot: DataFrame | None = None) -> DataFrame:
    """The references whose parent is known, each once, with why as things stand (null if it is no case).

    A row counts unless its key was reopened after it was written: then a later part has it again.
    """
    rows = reduce(DataFrame.unionByName, [df.withColumn("_step", F.lit(s)) for s, df in state.parts])
    if state.reopened is not None:
        last = state.reopened.groupBy(*KEYS).agg(F.max("step").alias("_last"))
        rows = skew_join(rows, last, KEYS, hot).where(F.col("_last").isNull() | (F.col("_step") >= F.col("_last"))).drop("_last")
    return rows.drop("_step")


def advance(state: State, refs: DataFrame, pars: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: keep_table(df), hot: DataFrame | None = None) -> State:
    """The state after one step of references and parent rows.

    Parents are merged by key (earliest load, earliest deletion); a null never wins over a time. New and waiting references
    probe the merged index once, under a skew-safe join, and so do those of keys that the step changed. What was written
    before stays as it is. `hot` names the hot keys of the references, where the caller knows them. An empty step changes nothing.
    """
    step, cols = state.step + 1, refs.columns
    new = pars.groupBy(*KEYS).agg(F.min("parent_loaded").alias("parent_loaded"), F.min("deleted_at").alias("deleted_at"))
    was = state.index.select(*KEYS, F.lit(True).alias("_there"), F.col("parent_loaded").alias("_loaded"), F.col("deleted_at").alias("_deleted"))
    merged = new.join(was, KEYS, "full").select(
        *KEYS,
        F.least("parent_loaded", "_loaded").alias("parent_loaded"),
        F.least("deleted_at", "_deleted").alias("deleted_at"),
        (F.col("_there") & ~(F.least("parent_loaded", "_loaded").eqNullSafe(F.col("_loaded")) & F.least("deleted_at", "_deleted").eqNullSafe(F.col("_deleted")))).alias("_changed"),
    )
    index = keep(merged, "index")
    changed = index.where("_changed").select(*KEYS)
    waiting = state.pending.unionByName(refs)
    reopened = state.reopened
    if state.parts:
        reopened = changed.withColumn("step", F.lit(step))
        reopened = keep(reopened if state.reopened is None else state.reopened.unionByName(reopened), "reopened")
        waiting = waiting.unionByName(known(state, hot).join(changed, KEYS, "left_semi").select(cols))
    probed = skew_join(waiting, index.drop("_changed"), KEYS, hot)
    there = F.col("parent_loaded").isNotNull()
    probed = keep(probed.select(*cols, there.alias("known"), F.when(there, _reason()).alias("why")), "probed")
    return State(index.drop("_changed"), probed.where(~F.col("known")).select(cols), [*state.parts, (step, probed.where("known").select(*cols, "why"))], reopened)


def bounds(frames: list[DataFrame], cols: list[str], slices: int) -> list:
    """Up to slices - 1 times that part the load times into slices of equal length."""
    low_high = [f.agg(F.min(c), F.max(c)).first() for f, c in zip(frames, cols)]
    lows, highs = [r[0] for r in low_high if r[0]], [r[1] for r in low_high if r[1]]
    if not lows:
        return []
    low, high = min(lows), max(highs)
    return [low + (high - low) * k / slices for k in range(1, slices)]


def track(refs: DataFrame, pars: DataFrame, slices: int = 3, each=None) -> State:
    """Runs the state over `slices` of load time, in order; `each(until, state)` sees the state after each slice.

    Rows without a load time are in the first slice. A reference without one is never late or deleted, only missing.
    A parent row without one is there from the start, but says nothing about when: other rows of its key do, if any.
    Both inputs are written once, parted by slice, so each slice reads its own rows only.
    """
    refs, pars = keep_table(refs), keep_table(pars)
    marks = bounds([refs, pars], ["child_loaded", "parent_loaded"], slices)
    at = lambda c: sum((F.when(F.col(c) >= F.lit(m), 1).otherwise(0) for m in marks), F.lit(0)).cast("int")
    hot = keep_table(hot_keys(refs, KEYS))
    parted = [keep_table(f.withColumn("_slice", at(c)), "_slice") for f, c in ((refs, "child_loaded"), (pars, "parent_loaded"))] if marks else [f.withColumn("_slice", F.lit(0)) for f in (refs, pars)]
    state = empty(refs, pars)
    for k in range(len(marks) + 1):
        state = advance(state, *[f.where(F.col("_slice") == k).drop("_slice") for f in parted], hot=hot)
        if each:
            each(marks[k] if k < len(marks) else None, state)
    return state


def _untimed(state: State) -> DataFrame:
    """The references still pending whose parent is there without a load time, with its deletion."""
    return state.pending.join(state.index.where("parent_loaded IS NULL").drop("parent_loaded"), KEYS)


def orphans(state: State) -> DataFrame:
    """(relation, child_id, period, why): the cases among references with a known parent, and what is still pending as 'missing'.

    Pending references whose parent has no load time aren't missing; they are cases only if it was deleted before they loaded.
    """
    cols = ["relation", "child_id", "period", "why"]
    missing = state.pending.join(state.index.select(*KEYS), KEYS, "left_anti").withColumn("why", F.lit("missing"))
    gone = _untimed(state).where(F.col("deleted_at") <= F.col("child_loaded")).withColumn("why", F.lit("deleted"))
    found = [missing.select(cols), gone.select(cols)]
    if state.parts:
        cases = State(state.index, state.pending, [(s, p.where("why IS NOT NULL")) for s, p in state.parts], state.reopened)
        found.append(known(cases).select(cols))
    return reduce(DataFrame.unionByName, found).distinct()


def snapshot(state: State) -> DataFrame:
    """(relation, period, why, n): the orphan counts per table and period as the state stands."""
    return orphans(state).groupBy("relation", "period", "why").agg(F.count(F.lit(1)).alias("n"))


def reopened(state: State) -> DataFrame:
    """(relation, period, n): references that were fine when they loaded and whose parent has been deleted since."""
    gone = state.index.where(F.col("deleted_at").isNotNull()).select(*KEYS)
    fine = _untimed(state).where(F.coalesce(F.col("deleted_at") > F.col("child_loaded"), F.col("deleted_at").isNotNull())).select(*KEYS, "period")
    if state.parts:
        fine = fine.unionByName(known(state).where(F.coalesce("why", F.lit("late")) == "late").join(gone, KEYS, "left_semi").select(*KEYS, "period"))
    return fine.groupBy("relation", "period").agg(F.count(F.lit(1)).alias("n"))
