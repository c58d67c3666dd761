"""Which items are new to a memory of the last titles, without one pass over all of them in one task."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.config import SETTINGS
from tidewater.scratch import stored

from .sequence import BLOCK, blocked


def take(memory: dict[str, None], title: str, most: int) -> bool:
    """Whether the title is new to the memory; if so it goes in, and the oldest out beyond `most`."""
    if title in memory:
        return False
    memory[title] = None
    if len(memory) > most:
        del memory[next(iter(memory))]
    return True


def remembered(items: DataFrame, order: list[str], title: str = "title", most: int = SETTINGS.seen_titles, block: int = BLOCK, halo: int | None = None, memory: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The items with `fresh`, and the memory after them: one row with `memory`, the titles as JSON, oldest first.

    memory: such a row, to start from; none where there is nothing to remember yet.

    A block of so many rows is a task's group.  The memory at its start is guessed from the rows before it and compared with that
    at the end of the block before.  Where they differ the block runs again from that end, then 4, 16 blocks in one go and so on,
    as some memories don't forget what they started from: few titles are never pushed out.  So rounds are few, and the last of
    them is one pass in order.  Rows stream through a task, whatever the length of its group.
    """
    items = items.where(F.col(title).isNotNull())
    names = items.columns
    rows = blocked(items, order, block, min(block, max(1, 4 * most if halo is None else halo)))
    last = rows.agg(F.max("_place")).first()[0]
    if last is None:
        return items.withColumn("fresh", F.lit(None).cast("boolean")), memory

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, None] = {}
        group = None
        for batch in batches:
            kept, fresh, starts, ends = [], [], [], []
            for i, (g, b, place, seed, t) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_group", "_block", "_place", "_seed", title)), strict=True)):
                if g != group:
                    group, known = g, {}
                if seed is not None:
                    known = dict.fromkeys(json.loads(seed))
                    continue
                own = place // block == b
                start = json.dumps(list(known)).encode() if own and place % block == 0 else None
                new = take(known, t, most)
                if own:
                    kept.append(i)
                    fresh.append(new)
                    starts.append(start)
                    ends.append(json.dumps(list(known)).encode() if place % block == block - 1 or place == last else None)
            out = batch.select([*names, "_place", "_block"]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(fresh, pa.bool_()), pa.array(starts, pa.binary()), pa.array(ends, pa.binary())], names=[*out.schema.names, "fresh", "_starts", "_ends"])

    parts, span = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)

    def ran(grouped: DataFrame, seeds: list[DataFrame]) -> DataFrame:
        """Rows with a `_group`, each group run in order; seeds: `_group` and `_seed`, the memory that it starts from."""
        grouped = grouped.withColumn("_seed", F.lit(None).cast("binary"))
        for seed in seeds:
            grouped = grouped.unionByName(seed.withColumns({"_block": F.lit(-1), "_place": F.lit(-1)}), allowMissingColumns=True)
        dealt = grouped.repartition(min(parts, 2 * (1 + last // (block * span))), "_group").sortWithinPartitions("_group", F.col("_seed").isNull(), "_place")
        return stored(dealt.mapInArrow(run, f"{schema}, _place long, _block long, fresh boolean, _starts binary, _ends binary"), "remembered")

    given = [] if memory is None else [memory.select(F.lit(0).cast("long").alias("_group"), F.col("memory").alias("_seed"))]
    done = ran(rows.withColumn("_group", F.col("_block")), given)
    while last >= block:
        group = F.floor(F.col("_block") / span)
        before = done.where("_ends is not null").select((F.col("_block") + 1).alias("_block"), F.col("_ends").alias("_seed"))
        starts = done.where("_starts is not null").select("_block", "_starts")
        wrong = stored(starts.join(before, "_block").where("_starts != _seed").select(group.alias("_group")).distinct(), "wrong")
        if not wrong.limit(1).count():
            break
        own = rows.where(F.floor(F.col("_place") / block) == F.col("_block")).withColumn("_group", group)
        seeds = before.where(F.col("_block") % span == 0).select(group.alias("_group"), "_seed")
        again = ran(own.join(wrong, "_group", "left_semi"), [s.join(wrong, "_group", "left_semi") for s in (seeds, *given)])
        done = stored(done.withColumn("_group", group).join(wrong, "_group", "left_anti").select(*done.columns).unionByName(again), "settled")
        span *= 4
    return done.select(*names, "fresh"), done.where(F.col("_place") == last).select(F.col("_ends").alias("memory"))


def seen_lately(items: DataFrame, order: list[str], title: str = "title", most: int = SETTINGS.seen_titles, block: int = BLOCK, halo: int | None = None) -> DataFrame:
    """Adds `fresh`: whether the title isn't among the last `most` that were fresh, over all items in order.

    A repeat doesn't refresh its place, and a title that was pushed out is fresh again.  Items without a title go.
    """
    return remembered(items, order, title, most, block, halo)[0]
