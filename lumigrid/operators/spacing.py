"""Keeping events at a minimum distance, when a session may be far too long for one task.

Whether an event is kept depends on the last one kept before it, so a session looks sequential.
But the effect of a *block* of time on the clock is a small step function, "clock on entry to clock
on exit": after at most one gap only few different futures are left, and these soon coincide.  So

1. every block, in parallel, summarises itself as such a step function;
2. step functions are chained, first over groups of blocks, then over the groups;
3. every block, in parallel, keeps its events given the clock on entry.

Inside a task the rows are Arrow batches and the work is vectorised over all blocks of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

import lumigrid
from lumigrid.scale import materialize

# Functions travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(lumigrid)

NEVER = np.iinfo(np.int64).min // 4
ALWAYS = np.iinfo(np.int64).max // 4
STEPS = "session BIGINT, block BIGINT, upto BIGINT, exit BIGINT"
# With the times of the first and last row of the block.
BLOCK_STEPS = f"{STEPS}, first BIGINT, last BIGINT"


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables made of whole blocks, from batches sorted by (session, block).  The last block of a
    batch waits for the next batch."""
    waiting: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if table.num_rows == 0:
            continue
        last = waiting[-1] if waiting else table
        goes_on = all(last[c][-1] == table[c][0] for c in ("session", "_block"))
        cut = int(_starts(table)[-1])
        # Pieces of a block that fills many batches are put together once, when it ends.
        if cut or not goes_on:
            whole = [*waiting, *([table.slice(0, cut)] if cut else [])]
            if whole:
                yield pa.concat_tables(whole)
            waiting = []
        waiting.append(table.slice(cut))
    if waiting:
        yield pa.concat_tables(waiting)


def _ints(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def _starts(table: pa.Table) -> np.ndarray:
    """Row numbers at which blocks start."""
    session, block = _ints(table, "session"), _ints(table, "_block")
    changed = (session[1:] != session[:-1]) | (block[1:] != block[:-1])
    return np.concatenate([[0], np.flatnonzero(changed) + 1])


class Orbit:
    """For each row of a table of whole blocks the next row kept after it, if it is kept."""

    def __init__(self, table: pa.Table, gap: int, length: int):
        self.n = table.num_rows
        self.us = _ints(table, "_us")
        self.restart = _ints(table, "_restart").astype(bool)
        self.starts = _starts(table)
        sizes = np.diff(np.append(self.starts, self.n))
        self.group = np.repeat(np.arange(len(self.starts)), sizes)
        self.end = np.repeat(self.starts + sizes, sizes)
        self.since = self.us - _ints(table, "_block") * length
        # Blocks are laid out one after the other with room for a gap between them.
        self.place = self.group * (length + 2 * gap) + self.since
        later = np.searchsorted(self.place, self.place + gap, "left")
        self.next = self._inside(np.minimum(later, self._restart_from(np.arange(self.n) + 1)))

    def _restart_from(self, rows: np.ndarray) -> np.ndarray:
        """First restarting row at or after each of ``rows``."""
        which = np.append(np.flatnonzero(self.restart), self.n)
        return which[np.searchsorted(which[:-1], rows, "left")]

    def _inside(self, rows: np.ndarray) -> np.ndarray:
        """``n`` in place of rows that belong to a later block."""
        return np.where(rows < self.end, rows, self.n)

    def last_kept(self) -> np.ndarray:
        """Last row kept in the block if a row is kept, by doubling the jump distance."""
        last, jump = np.arange(self.n), self.next
        while (inside := jump < self.n).any():
            last[inside] = last[jump[inside]]
            jump = np.append(jump, self.n)[jump]
        return last

    def kept(self, clock: np.ndarray, gap: int) -> np.ndarray:
        """Mask of kept rows, given the clock on entry to each block."""
        base = self.us[self.starts] - self.place[self.starts]
        first = np.searchsorted(self.place, np.maximum(clock + gap - base, self.place[self.starts]),
                                "left")
        first = np.minimum(first, self._restart_from(self.starts))
        mask = np.zeros(self.n + 1, bool)
        mask[first[first < self.end[self.starts]]] = True
        jump = np.append(self.next, self.n)
        while (jump < self.n).any():
            mask[jump[mask]] = True
            jump = jump[jump]
        return mask[:-1]


def _steps(gap: int, length: int):
    """Step function of every block: rows (upto, exit), the first ``upto`` not below clock + gap
    giving the clock on exit.  Without such a row the block leaves the clock alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_blocks(batches):
            orbit = Orbit(table, gap, length)
            # A row can be the first one kept only while no earlier row surely is.
            settles = (orbit.since >= gap) | orbit.restart
            before = np.cumsum(settles) - settles
            possible = before == before[orbit.starts][orbit.group]
            upto = np.where(orbit.restart, ALWAYS, orbit.us)[possible]
            leave = orbit.us[orbit.last_kept()][possible]
            group = orbit.group[possible]
            # Neighbouring steps with the same exit are one step.
            final = np.append((group[1:] != group[:-1]) | (leave[1:] != leave[:-1]), True)
            at = orbit.starts[group[final]]
            columns = [_ints(table, "session")[at], _ints(table, "_block")[at], upto[final],
                       leave[final], orbit.us[at], orbit.us[orbit.end[at] - 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in columns],
                ["session", "block", "upto", "exit", "first", "last"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(session, run, blocks) with blocks as (block, [(upto, exit), ...]), all in order, from rows
    sorted that way."""
    names = ("session", "_run", "block", "upto", "exit")
    rows = (row for batch in batches
            for row in zip(*[batch.column(name).to_pylist() for name in names]))
    for (session, run), of_run in groupby(rows, itemgetter(0, 1)):
        yield session, run, ((block, [row[3:] for row in of_block])
                             for block, of_block in groupby(of_run, itemgetter(2)))


def _through(clock: int, gap: int, steps: list[tuple[int, int]]) -> int:
    """Clock on exit from a block."""
    return next((leave for upto, leave in steps if upto >= clock + gap), clock)


def _batched(rows: Iterator[tuple], names: list[str], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    while chunk := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*chunk)], names)


def _compose(gap: int):
    """Step functions of whole runs of blocks."""

    def composed(batches):
        for session, run, blocks in _runs(batches):
            futures: list[tuple[int, int]] = []  # (upto, clock so far)
            for k, (_, steps) in enumerate(blocks):
                futures = [(upto, _through(clock, gap, steps)) for upto, clock in futures]
                # Clocks that no row of the first block answers meet the second block unchanged, and
                # none of them reaches past its first row.
                if k == 0:
                    futures = steps
                elif k == 1 and futures[-1][0] < ALWAYS:
                    futures.append((max(steps[0][0], futures[-1][0]), steps[0][1]))
                futures = [f for f, g in zip(futures, [*futures[1:], (None, None)]) if f[1] != g[1]]
            for upto, clock in futures:
                yield session, run, upto, clock

    return lambda batches: _batched(composed(batches), ["session", "block", "upto", "exit"])


def _walk(gap: int):
    """Clock on entry to each block of a run.  A row without block carries the clock on entry to
    the run; without it nothing was kept before."""

    def walked(batches):
        for session, _, blocks in _runs(batches):
            clock = int(NEVER)
            for block, steps in blocks:
                if block is None:
                    clock = steps[0][1]
                    continue
                yield session, block, clock
                clock = _through(clock, gap, steps)

    return lambda batches: _batched(walked(batches), ["session", "block", "clock"])


def mark_chained(steps: DataFrame, gap: int, fan: int) -> DataFrame:
    """Add the run of each block and whether its step has to be ``chained``.

    A block of one step that begins at least a gap after the block before keeps its first row
    whatever the clock.  Such a block needs no clock on entry, and unless a less certain block
    follows it, nobody asks for its clock on exit.  In sparse sessions hardly any step is left.
    """
    by_run = Window.partitionBy("session", "_run").orderBy("block", "upto")
    lag, lead = (lambda c: F.lag(c).over(by_run)), (lambda c: F.lead(c).over(by_run))
    single = ~F.coalesce(lag("block") == F.col("block"), F.lit(False)) \
        & ~F.coalesce(lead("block") == F.col("block"), F.lit(False))
    certain = single & F.coalesce(F.col("first") - lag("last") >= gap, F.lit(False))
    return (steps.withColumn("_run", F.floor(F.col("block") / fan))
            .withColumn("certain", certain)
            .withColumn("chained", ~F.col("certain") | ~F.coalesce(lead("certain"), F.lit(False)))
            .drop("first", "last", "certain"))


def entry_clocks(marked: DataFrame, gap: int) -> DataFrame:
    """(session, block, clock): the clock on entry to every block, by way of runs of blocks."""

    def by_run(df: DataFrame) -> DataFrame:
        return df.repartition("session", "_run").sortWithinPartitions(
            "session", "_run", "block", "upto")

    clocks = "session BIGINT, block BIGINT, clock BIGINT"
    chained = marked.filter("chained").drop("chained")
    runs = by_run(chained).mapInArrow(_compose(gap), STEPS)
    into_runs = by_run(runs.withColumn("_run", F.lit(0).cast("bigint"))).mapInArrow(
        _walk(gap), clocks)
    heads = into_runs.select("session", F.col("block").alias("_run"), F.col("clock").alias("exit"))
    walked = by_run(chained.unionByName(heads, allowMissingColumns=True)).mapInArrow(
        _walk(gap), clocks)
    free = marked.filter("NOT chained").select("session", "block", F.lit(int(NEVER)).alias("clock"))
    return walked.unionByName(free)


def _keep(gap: int, length: int, columns: list[str]):
    """Kept rows of every block.  The first row of a block only carries the clock on entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_blocks(batches):
            head = np.zeros(table.num_rows, bool)
            head[_starts(table)] = True
            clock = _ints(table.filter(pa.array(head)), "clock")
            rows = table.filter(pa.array(~head))
            mask = Orbit(rows, gap, length).kept(clock, gap)
            yield from rows.select(columns).filter(pa.array(mask)).to_batches()

    return run


def keep_spaced(events: DataFrame, gap_us: int, restart: Column, free: Column,
                block_gaps: int = 1024, fan: int = 256) -> DataFrame:
    """Rows of ``events`` (session, event_id, ts, ...) that are at least ``gap_us`` after the last
    kept row of the session.

    ``restart`` rows are always kept and restart the clock; ``free`` rows are always kept and do
    not touch it.  ``block_gaps`` gaps make a block, ``fan`` blocks a run.
    """
    length = gap_us * block_gaps
    keys, order = ["session", "_block"], ["session", "_block", "_us", "event_id"]
    timed = events.withColumns({"_us": F.unix_micros("ts"), "_restart": restart, "_free": free}) \
        .withColumn("_block", F.expr(f"(_us - pmod(_us, {length})) div {length}"))
    clocked = timed.filter(~F.col("_free")).drop("_free")
    steps = (clocked.select(*order, "_restart")
             .repartition(*keys).sortWithinPartitions(*order)
             .mapInArrow(_steps(gap_us, length), BLOCK_STEPS))
    marked = materialize(mark_chained(steps, gap_us, fan))
    # The clock on entry travels as the first row of its block, so one shuffle brings both together.
    heads = entry_clocks(marked, gap_us).withColumnRenamed("block", "_block")
    kept = (clocked.unionByName(heads, allowMissingColumns=True)
            .repartition(*keys).sortWithinPartitions(*order)
            .mapInArrow(_keep(gap_us, length, events.columns), events.schema))
    return kept.unionByName(timed.filter("_free").select(*events.columns))
