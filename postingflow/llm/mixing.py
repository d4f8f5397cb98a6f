"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postingflow.llm.common import fresh, ranked
from postingflow.session import settle


def whole_weights(weights: dict, period: int | None = None) -> dict:
    """Weights as whole numbers in exactly the same proportions.

    With a period they are whole numbers of its slots, by largest remainders.
    """
    exact = {s: Fraction(w) for s, w in weights.items()}
    if any(w < 0 for w in exact.values()):
        raise ValueError("weights must not be negative")
    if period is None:
        unit = lcm(*(w.denominator for w in exact.values()))
        return {s: int(w * unit) for s, w in exact.items()}
    total = sum(exact.values())
    shares = {s: w / total * period for s, w in exact.items()}
    slots = {s: int(x) for s, x in shares.items()}
    rest = sorted(shares, key=lambda s: (int(shares[s]) - shares[s], str(s)))
    for s in rest[: period - sum(slots.values())]:
        slots[s] += 1
    return slots


def turns(widths: list[int], total: int, blocks: list[int]) -> Iterator[tuple]:
    """(source, block, release, deadline, slot): earliest deadline first among released blocks.

    Block j of a source with w of ``total`` is released at floor(j total / w) and due by
    ceil((j + 1) total / w). The widths sum to at most the total, so every block is in its
    window and at any time a source is less than one block from its share. Slots of sources
    that have run out are skipped, not walked: the work grows with the blocks alone.
    """
    coming = [(0, i, 0) for i in range(len(widths)) if blocks[i]]  # release, source, block
    heapq.heapify(coming)
    ready, now = [], 0
    while coming or ready:
        if not ready:
            now = max(now, coming[0][0])
        while coming and coming[0][0] <= now:
            release, i, j = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(j + 1) * total // widths[i]), i, j, release))
        due, i, j, release = heapq.heappop(ready)
        if due <= now:
            raise AssertionError("a block missed its deadline")
        yield i, j, release, due, now
        now += 1
        if j + 1 < blocks[i]:
            heapq.heappush(coming, ((j + 1) * total // widths[i], i, j + 1))


def schedule(slots: dict) -> list[tuple]:
    """One period as (source, block, slot), for weights in whole slots."""
    names = sorted(slots, key=str)
    widths = [slots[s] for s in names]
    return [(names[i], j, now) for i, j, _, _, now in turns(widths, sum(widths), widths)]


def natural_weights(df: DataFrame, source: str, power: float = 0.7) -> dict:
    """Weights from the sources' numbers of rows to a power below 1: small ones gain.

    One row per source comes to the driver, which needs the list of sources anyway.
    """
    counts = df.groupBy(F.col(source).cast("string").alias("s")).count().collect()
    return {r["s"]: float(r["count"]) ** power for r in counts}


def mix(
    df: DataFrame, weights: dict | None = None, source: str = "source", id_column: str = "doc_id", block_rows: int = 16,
    seed: int = 5, per_bucket: int = 10_000,
) -> DataFrame:
    """Order rows so that, block by block, sources come in proportion to their weights.

    Adds ``block`` (of the source, from 0), ``release`` and ``deadline`` (its window),
    ``turn`` (its slot in the schedule of all sources) and ``position`` (gapless from 0).
    Rows of a source come in a random order fixed by the seed, in blocks of ``block_rows``.
    Before every slot each source that has not run out has had less than one block more or
    less than its exact weight's share of the slots, however many slots there are. No row is dropped or repeated: when a source runs out its slots stay
    empty and the others go on in the same proportions. Weights default to
    ``natural_weights``; a null source is a source; every source of the table needs a weight above 0.

    The slots are walked by one task, which holds one entry for each source and hands on a
    row for each block; all else is spread. A source's rows are ranked in buckets, and
    positions by ranges of slots: no source's rows, however many, are in one task. Repeated rows and ids are rows of their own, null ids sort as one value;
    input columns of the added names are replaced; an empty table gives an empty result.
    """
    spark = df.sparkSession
    added = ("block", "release", "deadline", "turn", "position")
    df = df.drop(*[c for c in df.columns if c.lower() in added])
    columns = df.columns
    bits, rank, offset, key = (fresh(df, n) for n in ("bits", "rank", "in_block", "source_key"))
    slots = whole_weights(natural_weights(df, source) if weights is None else weights)
    row = fresh(df, "row")
    # Equal ids and sources of many rows must not fall into one bucket: the scan number spreads them.
    keyed = df.withColumn(row, F.monotonically_increasing_id()).withColumn(key, F.col(source).cast("string"))
    narrow = settle(keyed.select(row, key, F.xxhash64(F.lit(seed), id_column, row).alias(bits)), "rows")
    counts = {r[0]: r[1] for r in narrow.groupBy(key).count().collect()}
    lost = [s for s in counts if not slots.get(s)]
    if lost:
        raise ValueError(f"sources without a weight: {lost[:5]}")
    names = sorted(counts, key=lambda s: (s is not None, s or ""))
    numbers = spark.createDataFrame(list(zip(names, range(len(names)))), "s string, source_number bigint")
    blocks = [-(-counts[s] // block_rows) for s in names]
    plan = settle(_plan(spark, [slots[s] for s in names], sum(slots.values()), blocks), "schedule")
    ranks = ranked(narrow, [key], bits, [row], rank, per_bucket)
    placed = ranks.withColumn("block", F.floor(F.col(rank) / block_rows)).withColumn(offset, F.col(rank) % block_rows)
    placed = placed.join(F.broadcast(numbers), F.col(key).eqNullSafe(F.col("s")))
    timed = placed.join(plan, ["source_number", "block"]).select(row, "block", "release", "deadline", "turn", offset)
    timed = settle(timed, "turns")
    placed = _positions(timed, ["turn", offset], "position", block_rows, per_bucket).drop(offset)
    return keyed.join(placed, row).select(*columns, *added)


def _plan(spark: SparkSession, widths: list[int], total: int, blocks: list[int]) -> DataFrame:
    """A row for each block, written by one task in batches as it walks the slots."""
    names = ["source_number", "block", "release", "deadline", "turn"]

    def run(batches):
        for _ in batches:
            walk = turns(widths, total, blocks)
            while part := list(islice(walk, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part)], names=names)

    return spark.range(0, 1, 1, 1).mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def _positions(df: DataFrame, order: list[str], name: str, block_rows: int, per_bucket: int) -> DataFrame:
    """Gapless positions by turn and place in the block, ranked in ranges of turns."""
    from pyspark.sql import Window

    width = max(1, per_bucket // block_rows)
    cut = df.withColumn("range", F.expr(f"turn div {width}"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range of turns.
    base = cut.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("range").orderBy(*order)
    numbered = cut.withColumn("n", F.row_number().over(inside) - 1).join(base, "range")
    return numbered.withColumn(name, F.col("n") + F.col("base")).drop("n", "base", "range")


def ordered(mixed: DataFrame, columns: list[str], per_file: int = 32 << 20, docs: DataFrame | None = None, text: str = "text") -> DataFrame:
    """The mix as files to be read in turn: ranges of positions, each in order.

    Files hold about ``per_file`` bytes of ``text`` on average (64 bytes a row beside it), so a
    later stage has tasks by the table's size and not by its rows. The bytes are summed over
    ``docs``, the table that was mixed, where it is given: the mix itself would be computed again.
    """
    table = mixed if docs is None else docs
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 64 if text in table.columns else F.lit(64)
    total = table.agg(F.sum(size.cast("bigint"))).first()[0] or 0
    return mixed.repartitionByRange(total // per_file + 1, "position").sortWithinPartitions("position").select(*columns)


def with_turns(docs: DataFrame, file: str, place: str) -> DataFrame:
    """Number the rows of files written by ``ordered``: the file's key, sorted as text, and the place in it.

    ``docs`` must be a plain read. A scan takes large files first, so its own order is another.
    """
    number = F.lpad(F.regexp_extract("_metadata.file_name", "^part-([0-9]+)", 1), 12, "0")
    key = F.concat(number, F.lit("/"), F.col("_metadata.file_path"))
    return docs.select(*docs.columns, key.alias(file), F.col("_metadata.row_index").alias(place))
