"""The row before and after, validity periods and filled series, for keys of any number of rows.

A window over a key sorts all its rows in one task. Here a key's time is cut into
blocks; windows run inside blocks, and what goes across is one row for each block:
its last (or first) row, handed to the next block that has rows, however far that
is. So a key that has most of all rows is spread over its blocks, and only its
blocks are sorted together.

Null keys are a key. Rows without a time are in no series. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a series that are one block.
BLOCK_CELLS = 4096
OWN = ("_block", "_carried", "_is_row", "_beside")


def _free(rows: DataFrame, *names: str) -> None:
    if clash := {*names, *OWN} & set(rows.columns):
        raise ValueError(f"columns of these names are there already: {sorted(clash)}")


def beside(rows: DataFrame, keys: list[str], block: str, order: list[str], columns: list[str], following: bool = False) -> DataFrame:
    """rows with `_beside`: a struct of `columns` of the key's row before by (block, order), or after; null where there is none. Rows of a key are told apart by order."""
    toward = F.desc if following else F.asc
    held = F.struct(*columns)
    edge = (F.min_by if following else F.max_by)(held, F.struct(*order))
    edges = rows.groupBy(*keys, block).agg(edge.alias("_edge"))
    carried = F.lag("_edge").over(Window.partitionBy(*keys).orderBy(toward(block)))
    markers = edges.select(*keys, block, carried.alias("_carried"), F.lit(0).alias("_is_row")).where("_carried is not null")
    kind = markers.schema["_carried"].dataType
    both = rows.select("*", F.lit(None).cast(kind).alias("_carried"), F.lit(1).alias("_is_row")).unionByName(markers, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, block).orderBy("_is_row", *(toward(o) for o in order))
    before = F.lag(F.when(F.col("_is_row") == 1, held).otherwise(F.col("_carried"))).over(inside)
    return both.withColumn("_beside", before).where("_is_row = 1").drop("_carried", "_is_row")


def _block_of(time_col: str, block_seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(time_col).cast("timestamp")) / F.lit(block_seconds * 1_000_000))


def periods(changes: DataFrame, keys: list[str], time_col: str, columns: list[str], then: tuple[str, ...] = (), block_seconds: int = 86_400) -> DataFrame:
    """keys, columns, valid_from, valid_to (exclusive; null: still valid): the times in which a key's columns stayed the same.

    Of a key's changes at one time the last by `then` counts, among equals the greatest. A change to what
    was already so begins no period. A null is a value. Repeated changes alter nothing, so a batch may come again.
    """
    _free(changes.select(*columns), "valid_from", "valid_to", "_at", "_state")
    state = F.struct(*columns)
    timed = changes.where(F.col(time_col).isNotNull()).select(*keys, F.col(time_col).alias("_at"), _block_of(time_col, block_seconds).alias("_block"), state.alias("_state"), F.struct(*then, *columns).alias("_carried"))
    once = timed.groupBy(*keys, "_block", "_at").agg(F.max_by("_state", "_carried").alias("_state"))
    known = beside(once, keys, "_block", ["_at"], ["_state"])
    begun = known.where(F.col("_beside").isNull() | ~F.col("_beside._state").eqNullSafe(F.col("_state"))).drop("_beside")
    ended = beside(begun, keys, "_block", ["_at"], ["_at"], following=True)
    return ended.select(*keys, "_state.*", F.col("_at").alias("valid_from"), F.col("_beside._at").alias("valid_to"))


def valid_at(history: DataFrame, time: Column) -> DataFrame:
    """The rows of periods() that held at a time."""
    return history.where((F.col("valid_from") <= time) & (F.col("valid_to").isNull() | (F.col("valid_to") > time)))


def filled(rows: DataFrame, keys: list[str], time_col: str, value: Column, step_seconds: int, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """keys, at, known, previous, following, linear, nearest: a row for each step from a key's first to its last value.

    Time is cut into cells of step_seconds (from 1970 on); `value`, an aggregate of a number, is a cell's
    value, and cells where it is null are gaps. `previous` and `following` are the nearest values on
    either side (at known cells the value itself, as in all columns), `linear` lies between them by time and
    `nearest` is the nearer, the earlier if both are as near. Gaps are cut at the blocks' borders and dealt
    anew before they are filled, so that a long one isn't filled by one task.
    """
    step = step_seconds * 1_000_000
    timed = rows.where(F.col(time_col).isNotNull()).withColumn("_cell", F.floor(F.unix_micros(F.col(time_col).cast("timestamp")) / F.lit(step)))
    cells = timed.groupBy(*keys, "_cell").agg(value.cast("double").alias("_value")).where("_value is not null")
    cells = cells.withColumn("_block", F.floor(F.col("_cell") / block_cells))
    gaps = beside(cells, keys, "_block", ["_cell"], ["_cell", "_value"], following=True)
    until = F.coalesce(F.col("_beside._cell"), F.col("_cell") + 1)  # exclusive
    gaps = gaps.select(*keys, "_cell", "_value", until.alias("_until"), F.coalesce("_beside._value", "_value").alias("_next"))
    cut = gaps.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_cell") / block_cells), F.floor((F.col("_until") - 1) / block_cells)))).repartition(*keys, "_block")
    own = F.sequence(F.greatest(F.col("_cell"), F.col("_block") * block_cells), F.least(F.col("_until"), (F.col("_block") + 1) * block_cells) - 1)
    c, v, n = F.col("_c"), F.col("_value"), F.col("_next")
    passed = c - F.col("_cell")
    length = F.col("_until") - F.col("_cell")
    known = passed == 0
    out = cut.withColumn("_c", F.explode(own))
    kind = rows.schema[time_col].dataType.simpleString()
    return out.select(
        *keys, F.timestamp_micros(c * step).cast(kind).alias("at"), known.alias("known"), v.alias("previous"), F.when(known, v).otherwise(n).alias("following"),
        F.when(known, v).otherwise(v + (n - v) * (passed / length)).alias("linear"), F.when(2 * passed <= length, v).otherwise(n).alias("nearest"),
    )
