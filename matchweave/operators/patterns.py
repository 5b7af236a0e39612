"""Declared sequence patterns over ordered events, matched by one automaton in a single pass."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Step:
    """A row that meets ``condition`` (null: doesn't), at most ``gap`` rows after the step before."""

    name: str
    condition: Column
    gap: int = 0


class Automaton:
    """Runs of a pattern in one group's rows, fed in order; holds only runs that can still go on."""

    def __init__(self, gaps: list[int], within: float | None):
        self.gaps, self.within = gaps, within
        self.runs: list[tuple[tuple[int, ...], float]] = []  # (places of the steps so far, clock of the first)

    def feed(self, place: int, clock: float | None, bits: int) -> list[tuple[int, ...]]:
        """Matches that end at this row; each start is matched once, at its earliest end and then by earliest steps."""
        if self.within is not None and clock is None:
            return []
        done, kept, seen = [], [], set()
        for places, since in self.runs:
            step = len(places)
            if places[0] in done or place - places[-1] > self.gaps[step] + 1 or (self.within is not None and clock - since > self.within):
                continue
            if bits >> step & 1:
                longer = (*places, place)
                if len(longer) == len(self.gaps):
                    done.append(places[0])
                    seen.add(longer)
                    continue
                kept.append((longer, since))
            if place - places[-1] <= self.gaps[step]:
                kept.append((places, since))
        found = sorted(seen)
        # Of runs with the same start, step and last row the first found has the earliest steps.
        fresh: dict[tuple, tuple] = {}
        for places, since in sorted(kept):
            if places[0] not in done:
                fresh.setdefault((places[0], len(places), places[-1]), (places, since))
        self.runs = list(fresh.values())
        if bits & 1:
            if len(self.gaps) == 1:
                found.append((place,))
            else:
                self.runs.append(((place,), clock))
        return found


def match_pattern(events: DataFrame, steps: list[Step], by: list[str], order: list[str], carry: list[str], clock: Column | None = None, within: float | None = None) -> DataFrame:
    """Every start of the pattern with its match: ``by``, each step's ``carry`` columns as <step>_<column>, and ``seconds`` from first to last.

    A match is a row for each step, in order, each at most its ``gap`` rows after the
    one before (0: the next row) and, with ``within``, the last at most so much after
    the first by ``clock``. A row that may start a match is reported once, with the match
    that ends first, of these the one with the earliest steps. Matches may overlap.
    ``seconds`` is null without ``clock``; with ``within`` a row whose clock is null
    is no step but counts for gaps. Null keys are a group; rows that tie in ``order``
    may come in any order.

    Conditions become the bits of one number, in the JVM; a group's rows are then
    streamed in order past the automaton, which skips rows of no use. A task holds the open
    runs, of which there are at most the product of the gaps, and a batch of rows.
    """
    names = [s.name for s in steps]
    if len(set(names)) < len(names) or not steps or any(s.gap < 0 for s in steps):
        raise ValueError("steps need names of their own and gaps of 0 or more")
    bits = F.lit(0)
    for k, s in enumerate(steps):
        bits = bits + F.when(s.condition, 1 << k).otherwise(0)
    columns = [F.col(f"`{c}`") for c in carry]
    rows = events.select(F.struct(*[F.col(f"`{b}`") for b in by]).alias("_by"), F.struct(*[F.col(f"`{o}`") for o in order]).alias("_order"), (clock if clock is not None else F.lit(None)).cast("double").alias("_clock"), bits.alias("_bits"), F.struct(*columns).alias("_carry"))
    place = (F.row_number().over(Window.partitionBy("_by").orderBy("_order")) - 1).alias("_place")
    rows = rows.repartition("_by").select("*", place).sortWithinPartitions("_by", "_order").select("_by", "_place", "_clock", "_bits", "_carry")
    gaps = [s.gap for s in steps]
    inner = rows.schema
    parts = T.StructType([T.StructField("by", inner["_by"].dataType), *[T.StructField(f"s{k}", inner["_carry"].dataType) for k in range(len(steps))], T.StructField("seconds", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, held = Automaton(gaps, within), {}
        for batch in batches:
            by_col, place_col, clock_col, bit_col, carry_col = batch.columns
            places, flags = (c.to_numpy(zero_copy_only=False) for c in (place_col, bit_col))
            out: list[dict] = []
            for i in np.flatnonzero((flags != 0) | (places == 0)).tolist():
                at = int(places[i])
                if not at:  # the first row of a group
                    machine, held = Automaton(gaps, within), {}
                if not flags[i]:
                    continue
                now = clock_col[i].as_py()
                held[at] = (carry_col[i].as_py(), now)
                for found in machine.feed(at, now, int(flags[i])):
                    first = held[found[0]][1]
                    out.append({"by": by_col[i].as_py(), **{f"s{k}": held[p][0] for k, p in enumerate(found)}, "seconds": None if first is None or now is None else now - first})
                used = {p for places_, _ in machine.runs for p in places_}
                held = {p: v for p, v in held.items() if p in used}
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([pa.field("by", by_col.type), *[pa.field(f"s{k}", carry_col.type) for k in range(len(gaps))], pa.field("seconds", pa.float64())]))

    found = rows.mapInArrow(run, parts)
    return found.select("by.*", *[F.col(f"s{k}.`{c}`").alias(f"{s.name}_{c}") for k, s in enumerate(steps) for c in carry], "seconds")
