"""Ordered computation over series of any length without one task per series.

A window partitioned by series puts a whole series into one task, which fails when one
series holds a third of all rows. Everything ordered in this package is therefore built
from four steps that partition by ``(series, block)``:

* a *slot* is a fixed span of time. State that crosses slots (the last known value, a
  running sum, a row count) is reduced to one row per (series, slot), accumulated over
  those few rows, and joined back on (series, slot), the partitioning the rows already have;
* a *row block* is a fixed number of consecutive rows of a series. Rows near a border
  are copied to the neighbouring block (the halo), so a frame of bounded length is complete;
* a *time block* is the same with a span of time instead of a row count.

A NULL series key raises an error, since the joins on keys would lose its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400
SLOT, BLOCK, OWN, POS = "_slot", "_block", "_own", "_pos"


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp"))


def floor_to(us: Column, width_s: float) -> Column:
    """Start of the ``width_s`` wide span that holds ``us`` (both in microseconds)."""
    return us - F.pmod(us, F.lit(int(width_s * 1_000_000)))


def ceil_to(us: Column, width_s: float) -> Column:
    """First multiple of ``width_s`` at or after ``us`` (both in microseconds)."""
    return us + F.pmod(-us, F.lit(int(width_s * 1_000_000)))


#: Steps of a series that one task unfolds at a time.
GRID_PART = 1000


def steps_between(spans: DataFrame, keys: Sequence[str], ts: str, step_s: float) -> DataFrame:
    """One row per step of ``spans(series…, _lo, _hi)``: parts of a span first, then their steps."""
    step = F.make_interval(secs=F.lit(step_s).cast("decimal(18,6)"))
    part = F.make_interval(secs=F.lit(step_s * GRID_PART).cast("decimal(18,6)"))
    last = F.make_interval(secs=F.lit(step_s * (GRID_PART - 1)).cast("decimal(18,6)"))
    parts = spans.select(*keys, "_hi", F.explode(F.sequence("_lo", "_hi", part)).alias("_lo"))
    return parts.select(*keys, F.explode(F.sequence("_lo", F.least("_hi", F.col("_lo") + last), step)).alias(ts))


def with_slot(df: DataFrame, ts: str, width_s: float) -> DataFrame:
    """Tag rows with their slot. Rows tagged by the caller keep their tag, so that several
    steps in a row share one partitioning."""
    return df if SLOT in df.columns else df.withColumn(SLOT, floor_to(micros(ts), width_s))


# Candidate slot lengths in seconds, from a quarter to a minute.
SLOT_LENGTHS = (90 * DAY, 30 * DAY, 7 * DAY, DAY, 21_600, 3_600, 900, 60)


def slot_for(
    df: DataFrame, keys: Sequence[str], ts: str, *, max_rows: int = 2_000_000, lengths: Sequence[int] = SLOT_LENGTHS
) -> int:
    """The longest slot of which the busiest one holds at most ``max_rows`` rows.

    One pass counts rows per series map-side; if none is too long, no slot is either. Else
    each length is counted in turn, the longest first, so few groups meet in a task. If even
    the shortest slot holds more, it is returned.
    """

    def busiest(*by: Column) -> int | None:
        return df.groupBy(*keys, *by).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("_n")).first()["_n"]

    most = busiest()
    if most is None:
        return min(lengths)
    if most <= max_rows:
        return max(lengths)
    for length in sorted(lengths, reverse=True):
        if busiest(floor_to(micros(ts), length).alias(SLOT)) <= max_rows:
            return length
    return min(lengths)


#: Rows that a task sorts at a time.
PART_ROWS = 500_000


def parts_for(df: DataFrame, part_rows: int = PART_ROWS) -> int | None:
    """How many tasks share ``df`` at ``part_rows`` rows each, None where the session's shuffles have as many."""
    parts = -(-df.count() // part_rows)
    return parts if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def join_series(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on series keys of which a NULL equals a NULL; the keys of ``left`` stay."""
    renamed = right.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_on_{k}" for k in keys])


def checked(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df``, failing on the first row with a NULL key."""
    unknown = reduce(or_, [F.col(k).isNull() for k in keys], F.lit(False))
    return df.filter(F.when(unknown, F.raise_error(F.lit("series keys must not be NULL")).cast("boolean")).otherwise(True))


def _order(order: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in order]


def _sort_key(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def carry(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    values: Mapping[str, Column],
    *,
    order: Sequence[str] | None = None,
    slot_s: float = DAY,
    backward: bool = False,
    strict: bool = False,
) -> DataFrame:
    """Add, per name in ``values``, the nearest earlier non-NULL value of that expression.

    ``strict`` leaves the row itself out (the value *before* it); ``backward`` looks ahead
    instead of back.
    """
    keys, order = list(keys), list(order or [ts])
    tagged = with_slot(checked(df, keys), ts, slot_s)
    tagged = tagged.withColumns({f"_in_{n}": expr for n, expr in values.items()})
    sort = _order(order) if not backward else [c.desc() for c in _order(order)]
    local = Window.partitionBy(*keys, SLOT).orderBy(*sort).rowsBetween(
        Window.unboundedPreceding, -1 if strict else 0
    )
    near = tagged.select(
        "*",
        *[F.last(f"_in_{n}", ignorenulls=True).over(local).alias(f"_near_{n}") for n in values],
    )

    pick = F.min_by if backward else F.max_by
    ends = tagged.groupBy(*keys, SLOT).agg(
        *[
            pick(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), _sort_key(order))).alias(f"_end_{n}")
            for n in values
        ]
    )
    slot_order = F.col(SLOT).desc() if backward else F.col(SLOT)
    across = Window.partitionBy(*keys).orderBy(slot_order).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *keys, SLOT, *[F.last(f"_end_{n}", ignorenulls=True).over(across).alias(f"_far_{n}") for n in values]
    )
    joined = near.join(carried, [*keys, SLOT], "left")
    return joined.select(
        *df.columns, *[F.coalesce(f"_near_{n}", f"_far_{n}").alias(n) for n in values]
    )


def neighbours(
    df: DataFrame, keys: Sequence[str], ts: str, values: Mapping[str, Column], *, slot_s: float = DAY
) -> DataFrame:
    """Add ``<name>_prev`` and ``<name>_next``, the nearest non-NULL values at or before and
    at or after each row, with one summary and one join for both directions."""
    keys = list(keys)
    tagged = with_slot(checked(df, keys), ts, slot_s)
    tagged = tagged.withColumns({f"_in_{n}": expr for n, expr in values.items()})
    rows = Window.partitionBy(*keys, SLOT)
    past = rows.orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    future = rows.orderBy(F.col(ts).desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = tagged.select(
        "*",
        *[F.last(f"_in_{n}", ignorenulls=True).over(past).alias(f"_p_{n}") for n in values],
        *[F.last(f"_in_{n}", ignorenulls=True).over(future).alias(f"_n_{n}") for n in values],
    )
    known = {n: F.when(F.col(f"_in_{n}").isNotNull(), F.col(ts)) for n in values}
    ends = tagged.groupBy(*keys, SLOT).agg(
        *[F.max_by(f"_in_{n}", known[n]).alias(f"_pe_{n}") for n in values],
        *[F.min_by(f"_in_{n}", known[n]).alias(f"_ne_{n}") for n in values],
    )
    slots = Window.partitionBy(*keys)
    before = slots.orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
    after = slots.orderBy(F.col(SLOT).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *keys,
        SLOT,
        *[F.last(f"_pe_{n}", ignorenulls=True).over(before).alias(f"_pf_{n}") for n in values],
        *[F.last(f"_ne_{n}", ignorenulls=True).over(after).alias(f"_nf_{n}") for n in values],
    )
    joined = near.join(carried, [*keys, SLOT], "left")
    return joined.select(
        *df.columns,
        *[F.coalesce(f"_p_{n}", f"_pf_{n}").alias(f"{n}_prev") for n in values],
        *[F.coalesce(f"_n_{n}", f"_nf_{n}").alias(f"{n}_next") for n in values],
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    values: Mapping[str, Column],
    *,
    order: Sequence[str] | None = None,
    slot_s: float = DAY,
) -> DataFrame:
    """Add running totals (the row included) per series for each expression in ``values``."""
    keys, order = list(keys), list(order or [ts])
    tagged = with_slot(checked(df, keys), ts, slot_s)
    tagged = tagged.withColumns({f"_in_{n}": expr for n, expr in values.items()})
    local = Window.partitionBy(*keys, SLOT).orderBy(*_order(order)).rowsBetween(
        Window.unboundedPreceding, 0
    )
    inside = tagged.select(
        "*", *[F.sum(f"_in_{n}").over(local).alias(f"_near_{n}") for n in values]
    )
    totals = tagged.groupBy(*keys, SLOT).agg(*[F.sum(f"_in_{n}").alias(f"_end_{n}") for n in values])
    across = Window.partitionBy(*keys).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, SLOT, *[F.sum(f"_end_{n}").over(across).alias(f"_far_{n}") for n in values]
    )
    joined = inside.join(offsets, [*keys, SLOT], "left")
    out = []
    for n in values:
        near, far = F.col(f"_near_{n}"), F.col(f"_far_{n}")
        out.append(F.when(near.isNull(), far).otherwise(near + F.coalesce(far, F.lit(0))).alias(n))
    return joined.select(*df.columns, *out)


def with_positions(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    *,
    order: Sequence[str] | None = None,
    slot_s: float = DAY,
    pos: str = POS,
    total: str | None = None,
) -> DataFrame:
    """Number the rows of every series 1, 2, … in order; optionally add the series length."""
    keys, order = list(keys), list(order or [ts])
    tagged = with_slot(checked(df, keys), ts, slot_s)
    local = Window.partitionBy(*keys, SLOT).orderBy(*_order(order))
    numbered = tagged.withColumn("_rn", F.row_number().over(local))
    counts = tagged.groupBy(*keys, SLOT).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("_n").over(whole).alias(total)] if total else []
    offsets = counts.select(
        *keys, SLOT, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), *extra
    )
    joined = numbered.join(offsets, [*keys, SLOT])
    return joined.select(
        *df.columns, (F.col("_before") + F.col("_rn")).alias(pos), *([total] if total else [])
    )


def _copies(own: Column, back_copy: Column, fwd_copy: Column) -> Column:
    return F.filter(F.array(own, back_copy, fwd_copy), lambda c: c.isNotNull())


def _home_and_halo(block: Column, to_next: Column, to_prev: Column, step: int) -> Column:
    home = F.struct(block.alias("block"), F.lit(True).alias("own"))
    after = F.struct((block + F.lit(step)).alias("block"), F.lit(False).alias("own"))
    prior = F.struct((block - F.lit(step)).alias("block"), F.lit(False).alias("own"))
    return F.explode(_copies(home, F.when(to_next, after), F.when(to_prev, prior)))


def row_blocks(
    df: DataFrame, *, size: int, back: int = 0, ahead: int = 0, pos: str = POS
) -> DataFrame:
    """Place each row in its block of ``size`` rows and copy border rows to the neighbours.

    Adds ``_block`` and ``_own``; evaluate frames over ``(keys, _block)`` and keep own rows.
    """
    if max(back, ahead) > size:
        raise ValueError("a halo may not be longer than a block")
    zero = F.col(pos) - F.lit(1)
    offset = F.pmod(zero, F.lit(size))
    block = zero - offset
    placed = _home_and_halo(block, offset >= F.lit(size - back), offset < F.lit(ahead), size)
    return df.select("*", placed.alias("_place")).select(
        *df.columns, F.col("_place.block").alias(BLOCK), F.col("_place.own").alias(OWN)
    )


def time_blocks(
    df: DataFrame, ts: str, *, width_s: float, back_s: float = 0, ahead_s: float = 0
) -> DataFrame:
    """As :func:`row_blocks`, with blocks and halos measured in seconds."""
    if max(back_s, ahead_s) > width_s:
        raise ValueError("a halo may not be longer than a block")
    width, back, ahead = (int(s * 1_000_000) for s in (width_s, back_s, ahead_s))
    us = micros(ts)
    offset = F.pmod(us, F.lit(width))
    placed = _home_and_halo(us - offset, offset >= F.lit(width - back), offset < F.lit(ahead), width)
    return df.select("*", placed.alias("_place")).select(
        *df.columns, F.col("_place.block").alias(BLOCK), F.col("_place.own").alias(OWN)
    )


def own_rows(df: DataFrame, *drop: str) -> DataFrame:
    """Keep each row once, in its home block."""
    return df.filter(F.col(OWN)).drop(BLOCK, OWN, *drop)


def block_window(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, BLOCK).orderBy(*_order(order))


def trailing(
    placed: DataFrame, keys: Sequence[str], us: str, width_s: float, parts: Mapping[str, tuple[Callable[[Column], Column], Column]]
) -> DataFrame:
    """Add ``<name>_tail`` and ``<name>_head``, two aggregates that make up the frame
    ``(t - width, t]`` of a row at ``t``; ``parts`` gives the function and its input.

    Time is cut into panes as wide as the frame, so a frame is the end of one pane (the
    tail) and the beginning of the next (the head). Both are running aggregates of a pane,
    and a row costs the same however many rows its frame holds. ``placed`` has blocks with a
    halo of at least one width; results are whole in own rows.
    """
    keys, width = list(keys), F.lit(int(width_s * 1_000_000))
    ins = {n: f"_in_{n}" for n in parts}
    rows = placed.select("*", *[value.alias(ins[n]) for n, (_, value) in parts.items()], (F.col(us) - F.pmod(us, width)).alias("_pane"))
    pane = Window.partitionBy(*keys, BLOCK, "_pane")
    so_far = pane.orderBy(us).rangeBetween(Window.unboundedPreceding, 0)
    heads = rows.select("*", *[f(F.col(ins[n])).over(so_far).alias(f"{n}_head") for n, (f, _) in parts.items()])

    # Each row asks from the first instant of its frame on; a frame that is one whole pane asks nothing.
    since = F.col(us) - width + F.lit(1)
    row = F.struct(F.lit(False).alias("asks"), F.col(us).alias("at"), F.col("_home").alias("pane"))
    ask = F.struct(F.lit(True).alias("asks"), since.alias("at"), (since - F.pmod(since, width)).alias("pane"))
    both = heads.withColumnRenamed("_pane", "_home").select("*", F.explode(F.array(row, ask)).alias("_x"))
    both = both.select("*", F.col("_x.pane").alias("_pane"), F.col("_x.at").alias("_at"), F.col("_x.asks").alias("_asks"))
    onward = pane.orderBy(F.col("_at").desc()).rangeBetween(Window.unboundedPreceding, 0)
    seen = both.select(
        "*", *[f(F.when(~F.col("_asks"), F.col(ins[n]))).over(onward).alias(f"_seen_{n}") for n, (f, _) in parts.items()]
    )
    before = F.col("_pane") < F.col("_home")
    tails = [F.when(before, F.col(f"_seen_{n}")).alias(f"{n}_tail") for n in parts]
    return seen.filter("_asks").select(*placed.columns, *[f"{n}_head" for n in parts], *tails)


def sum_of(*parts: str) -> Column:
    """The sum of the columns that are known, NULL if none is."""
    known = reduce(or_, [F.col(p).isNotNull() for p in parts])
    return F.when(known, reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p in parts]))


def group_starts(table: pa.Table | pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """First row of each stretch of rows that agree in ``names``, NULL being a value of its own."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in names:
        column = table.column(c)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and where each begins, from batches sorted by ``names``.

    A task holds one batch and the group that it breaks off.
    """
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        if table.num_rows:
            starts = group_starts(table, names)
            if len(starts) > 1:
                yield table.slice(0, starts[-1]), starts[:-1]
            rest = table.slice(starts[-1])
    if rest is not None:
        yield rest, np.zeros(1, np.int64)
