"""Packing tokenized texts into sequences by vector bin packing."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postingflow.llm.common import extended, fresh, with_row
from postingflow.llm.tokens import slices, word_encoder

SEQUENCE, SEGMENTS, END = 4096, 256, 2
GROUP_ROWS = 4096
WINDOW = 512  # pieces from a sequence's first to its last, where the order of the rows counts
BATCH_ROWS = 500  # texts that a task gets at once
SLICE_BYTES = 2 << 20  # of them, tokenized at once
PIECE = "start bigint, length bigint, loss_tokens bigint, doc_tokens bigint"


def pieces(
    docs: DataFrame, vocabulary: str, text: str = "text", most: int = SEQUENCE, end: int = END,
    checksums: bool = False, plain_specials: bool = False,
) -> DataFrame:
    """Tokenize whole texts, add the end id, and cut into pieces of at most ``most`` ids.

    One row per piece: the other columns of ``docs``, ``start`` (ids before it), ``length``,
    ``loss_tokens`` (ids with one before them in the text, which a model can be taught),
    ``doc_tokens`` and ``ids`` (little-endian unsigned 32-bit), or with ``checksums`` only
    their CRC-32 as ``ids_crc32``. Null texts are empty: the end id alone. ``vocabulary`` is
    the vocabulary file's path on every machine. Special tokens' strings in a text become
    those tokens, as in the library's plain call, unless ``plain_specials``.
    """
    columns = PIECE + (", ids_crc32 bigint" if checksums else ", ids binary")
    made = [c.split()[0] for c in columns.split(", ")]
    rest = [c for c in docs.columns if c != text and c.lower() not in made]
    schema = extended(docs.select(*rest), columns)

    def run(batches):
        encoder = word_encoder(vocabulary, plain_specials)
        for batch in batches:
            for low, high in slices(batch.column(text), SLICE_BYTES):
                part = batch.slice(low, high - low)
                ids, counts = encoder.encode(part.column(text))
                stops = np.cumsum(counts)
                totals = counts + 1
                with_end = np.insert(ids, stops, end).astype("<u4")
                cuts = -(-totals // most)
                doc = np.repeat(np.arange(len(totals)), cuts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * most
                length = np.minimum(totals[doc] - start, most)
                whole = pa.py_buffer(with_end)
                bounds = np.concatenate(([0], np.cumsum(length) * 4)).astype(np.int32)
                if checksums:
                    view, edges = memoryview(whole), bounds.tolist()
                    blobs = pa.array([zlib.crc32(view[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.int64())
                else:
                    blobs = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(bounds), whole])
                taken = part.select(rest).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays(
                    [taken.column(c) for c in rest]
                    + [pa.array(start), pa.array(length), pa.array(length - (start == 0)), pa.array(totals[doc]), blobs],
                    names=schema.names,
                )

    return docs.select(*rest, text).mapInArrow(run, schema)


def fill(demands: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The bin of each item: bins are filled one by one, by the dot-product heuristic.

    Demands and what is left of a bin are shares of the limits. Of the items that fit in
    every dimension, the one with the largest dot product of its demands with what is left
    goes in next. An item that is alone over a limit gets a bin of its own.
    """
    shares = demands / limits
    bins = np.full(len(demands), -1)
    alive = np.lexsort(tuple(-shares[:, k] for k in range(shares.shape[1])))
    bin_ = 0
    while len(alive):
        v = shares[alive]
        left = np.ones(shares.shape[1])
        open_ = np.ones(len(alive), bool)
        first = True
        while True:
            fits = open_ & (v <= left + 1e-9).all(axis=1)
            if not fits.any():
                if not first:
                    break
                fits[0] = True
            best = int(np.where(fits, v @ left, -1.0).argmax())
            open_[best] = False
            bins[alive[best]] = bin_
            left = left - v[best]
            first = False
        alive = alive[open_]
        bin_ += 1
    return bins


def fill_in_turn(demands: np.ndarray, limits: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The bin of each item, where items come in an order that the bins must follow.

    A bin is opened by the first item without one. What goes in next is chosen as in ``fill``,
    but only among the ``window`` items from the bin's first on: bins are in the order of
    their first items, and no item is ``window`` places or more ahead of its turn.
    """
    shares = demands / limits
    bins = np.full(len(demands), -1)
    bin_ = 0
    for at in range(len(demands)):
        if bins[at] >= 0:
            continue
        bins[at] = bin_
        left = 1 - shares[at]
        ahead = at + np.flatnonzero(bins[at : at + window] < 0)
        v = shares[ahead]
        # What does not fit now will not fit later, as a bin only gets fuller.
        while len(ahead := ahead[fits := (v <= left + 1e-9).all(axis=1)]):
            v = v[fits]
            best = int((v @ left).argmax())
            bins[ahead[best]] = bin_
            left = left - v[best]
            v[best] = np.inf
        bin_ += 1
    return bins


def in_turn(items: DataFrame, order: list[str], group: str, group_rows: int, block_rows: int = 256) -> DataFrame:
    """Number runs of about ``group_rows`` rows in ``order``, a file and a place in it, as ``group``.

    Rows are counted by blocks of places; only these counts, one row per block, are summed in
    order, and a block is in one group.
    """
    file, place = order
    block, base = fresh(items, "block"), fresh(items, "base")
    cut = items.withColumn(block, F.expr(f"`{place}` div {block_rows}"))
    before = Window.orderBy(file, block).rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(file, block).agg(F.count("*").alias(base))
    bases = counts.withColumn(base, F.coalesce(F.sum(base).over(before), F.lit(0)))
    return cut.join(bases, [file, block]).withColumn(group, F.expr(f"`{base}` div {group_rows}")).drop(block, base)


def pack(
    items: DataFrame, demands: dict[str, int], offset_by: str = "length", group_rows: int = GROUP_ROWS, one: int | None = None,
    order: list[str] | None = None,
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``items`` (a plain read), limits holding at once.

    ``demands`` maps a column to its limit in a sequence; ``one`` is the limit of the number
    of items. Rows are dealt by their number into groups of about ``group_rows``, and each
    group is packed in one task: groups stay small however large the table or a key is, and
    a sequence is left part empty at the end of a group only. Null demands count as 0. Input
    columns of the two names are replaced; an empty table gives an empty result.

    With ``order`` (a file and a place in it, never null, then further columns) groups are runs
    of rows in that order, sequences are numbered in it, and a sequence holds rows of ``WINDOW``
    places at most, in turn. Without it rows are dealt at random and fit a little closer.
    """
    items = items.drop(*[c for c in items.columns if c.lower() in ("sequence_id", "offset")])
    row, group = fresh(items, "row"), fresh(items, "group")
    columns, limits = list(demands), [*demands.values(), *([one] if one else [])]
    narrow = with_row(items, row).select(row, *dict.fromkeys([*columns, offset_by, *(order or [])]))
    if order:
        narrow = in_turn(narrow, order[:2], group, group_rows)
    else:
        groups = items.count() // group_rows + 1
        narrow = narrow.withColumn(group, F.pmod(F.xxhash64(row), F.lit(groups)))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([*(order or []), row], ignore_index=True)
        want = part[columns].fillna(0).to_numpy(float)
        if one:
            want = np.column_stack([want, np.ones(len(part))])
        bins = (fill_in_turn if order else fill)(want, np.array(limits, float))
        size = part[offset_by].fillna(0).to_numpy(np.int64)
        by_bin = np.argsort(bins, kind="stable")
        ends = np.cumsum(size[by_bin])
        first = np.concatenate(([True], np.diff(bins[by_bin]) > 0)) if len(by_bin) else np.array([], bool)
        base = np.repeat((ends - size[by_bin])[first], np.diff(np.append(np.flatnonzero(first), len(by_bin))))
        offset = np.empty(len(part), np.int64)
        offset[by_bin] = ends - size[by_bin] - base
        return pd.DataFrame({row: part[row], "sequence_id": part[group].to_numpy(np.int64) * (1 << 32) + bins, "offset": offset})

    placed = narrow.groupBy(group).applyInPandas(run, f"`{row}` bigint, sequence_id bigint, offset bigint")
    return with_row(items, row).join(placed, row).drop(row)


def pack_texts(
    items: DataFrame, most: int = SEQUENCE, segments: int = SEGMENTS, loss: int = SEQUENCE, order: list[str] | None = None
) -> DataFrame:
    """Pack pieces under limits on tokens, segments and loss-bearing tokens."""
    return pack(items, {"length": most, "loss_tokens": loss}, one=segments, order=order)
