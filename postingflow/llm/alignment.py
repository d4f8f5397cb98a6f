"""Aligning the tokens of two tokenizers by the byte ranges that they cover.

Both token sequences of a text are sorted lists of byte ends. Merging the lists is cut by
merge paths: a binary search on each diagonal of the merge finds how many ends of either list
come first, so that pieces of equal work are independent rows, also within one long text. A
piece emits the overlaps at its own ends; groups that cross a border are stitched afterwards.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postingflow.llm.common import arrow_rows, fresh, with_row
from postingflow.llm.tokens import slices
from postingflow.session import settle

WORK = 1 << 16  # ends of both lists that one piece merges
BLOCK_TOKENS = 1 << 22  # tokens whose links are counted and looked up together
SLICE_BYTES = 1 << 20  # texts tokenized at once
BATCH_ROWS = 200

# Characters that both readers of the byte vocabulary class alike, and no long runs: the
# quick one is quadratic in the length of a run.
TAME = re.compile("[\t\n\r\x20-\x7e¡-¬®-ſΑ-Ρα-ωА-яぁ-ゖァ-ヺ一-龥]*")
RUN = re.compile(r"\S{400}|\s{400}")


class Vocabularies:
    """Token ids and token bytes of a byte-level vocabulary (A) and a piece vocabulary (B).

    ``paths`` are A's file, the same vocabulary as ranks, and B's model. The ranks are read
    with the pattern ``pattern``; they give the same ids several times faster and are used
    for texts of ordinary characters without very long runs, A's own file for all others.
    Special tokens' strings in a text are plain text.
    """

    def __init__(self, byte_file: str, rank_file: str, piece_file: str, pattern: str):
        # A task has one core: threads of its own would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import base64

        import sentencepiece
        import tiktoken

        self.byte_file = byte_file
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.piece = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        # A byte-level vocabulary writes a byte that isn't a visible character from 0x100 on.
        shown = [b for b in range(256) if 0x21 <= b <= 0x7E or b >= 0xA1 and b != 0xAD]
        byte_of = {chr(b): b for b in shown}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        with open(byte_file, encoding="utf-8") as f:
            known = json.load(f)["model"]["vocab"]
        a = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        p = self.piece
        b = [
            bytes([int(p.id_to_piece(i)[3:-1], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode()
            for i in range(p.get_piece_size())
        ]
        self.bytes = [pa.array(a, pa.binary()), pa.array(b, pa.binary())]
        self.lengths = [np.array([len(t) for t in table], np.int64) for table in (a, b)]
        #: all ids in decimal, with the sign after them: A's ``,`` and ``|``, then B's ``,`` and ``;``
        self.shown = pa.array(
            [f"{i}{mark}" for n, marks in ((len(a), ",|"), (len(b), ",;")) for i in range(n) for mark in marks], pa.large_string()
        )
        self.b_shown = 2 * len(a)
        self.type = "<u2" if max(len(a), len(b)) <= 1 << 16 else "<u4"

    @cached_property
    def full(self):
        """A's own tokenizer, read when a text asks for it."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.byte_file)
        found.encode_special_tokens = True
        return found

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and B: all ids in turn, and how many each text has; no tokens where the
        tokens' bytes are not a space and the text."""
        spaced = [" " + t for t in texts]
        rough = [k for k, t in enumerate(spaced) if not TAME.fullmatch(t) or RUN.search(t)]
        a = [None] * len(texts)
        if rough:
            for k, e in zip(rough, self.full.encode_batch_fast([spaced[k] for k in rough], add_special_tokens=False), strict=True):
                a[k] = np.array(e.ids, np.int32)
        for k, t in enumerate(spaced):
            if a[k] is None:
                a[k] = np.array(self.quick.encode_ordinary(t), np.int32)
        b = [np.array(self.piece.encode(t), np.int32) for t in texts]
        none = [np.array([], np.int32)]
        flat = [np.concatenate(x + none).astype(np.int64) for x in (a, b)]
        counts = [np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b)]
        good = np.array([bool(t) for t in texts], bool)
        want = pa.array(spaced, pa.large_string())
        for table, ids, count in zip(self.bytes, flat, counts, strict=True):
            good &= self._same(table, ids, count, want)
        out = []
        for ids, count in zip(flat, counts, strict=True):
            out.append((ids[np.repeat(good, count)], np.where(good, count, 0)))
        return out

    @staticmethod
    def _same(table: pa.Array, ids: np.ndarray, count: np.ndarray, want: pa.Array) -> np.ndarray:
        """Which texts' token bytes, put together, are the text's."""
        joined = pc.take(table.cast(pa.large_binary()), pa.array(ids))
        ends = np.concatenate(([0], np.cumsum(count)))
        at = np.frombuffer(joined.buffers()[1], np.int64)[: len(ids) + 1][ends] if len(ids) else ends * 0
        goal = np.frombuffer(want.buffers()[1], np.int64)[: len(want) + 1]
        got = memoryview(joined.buffers()[2] or b"")
        text = memoryview(want.buffers()[2] or b"")
        return np.array([got[at[k] : at[k + 1]] == text[goal[k] : goal[k + 1]] for k in range(len(want))], bool)


@lru_cache(maxsize=2)
def vocabularies(*paths: str) -> Vocabularies:
    """Kept by the Python worker, which serves several tasks."""
    return Vocabularies(*paths)


def merge_path(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """How many ends of ``a`` and of ``b`` come before each border of ``work`` merged ends.

    One binary search on each diagonal, all at once; of equal ends a's comes first. Borders
    0 and len(a) + len(b) are included.
    """
    total = len(a) + len(b)
    d = np.append(np.arange(0, max(total, 1), work), total)
    low, high = np.maximum(d - len(b), 0), np.minimum(d, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        first = np.zeros(len(d), bool)
        first[open_] = a[middle[open_]] <= b[d[open_] - 1 - middle[open_]]
        low, high = np.where(open_ & first, middle + 1, low), np.where(open_ & ~first, middle, high)
    return low, d - low


PIECE = (
    "row bigint, block bigint, piece int, pieces int, a_start bigint, b_start bigint, "
    "a binary, b binary, a_next int, b_next int"
)
NAMES = [c.split()[0] for c in PIECE.split(", ")]


def _blobs(ids: np.ndarray, sizes: list[int], kind: str) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(sizes))) * np.dtype(kind).itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.astype(kind))]).cast(pa.binary())


def pieces(docs: DataFrame, paths: tuple[str, ...], work: int = WORK, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Tokenize (row, text) and cut each text's merge into pieces; one row per piece.

    A piece has its ids of A and B, the byte where each begins, the next id of either list
    after it (-1 at the end), and the number of a block of about ``block_tokens`` tokens.
    Texts without tokens have one empty piece.
    """

    def run(batches):
        v = vocabularies(*paths)
        block, filled = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for start, stop in slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(start, stop - start)
                texts = pc.fill_null(part.column("text"), "").to_pylist()
                (a, na), (b, nb) = v.encode(texts)
                ends = [np.cumsum(v.lengths[0][a]), np.cumsum(v.lengths[1][b])]
                out = {name: [] for name in NAMES if name not in ("a", "b")}
                sizes = [[], []]
                at_a = at_b = 0
                for row, ka, kb in zip(part.column("row").to_pylist(), na.tolist(), nb.tolist(), strict=True):
                    if ka + kb <= work:
                        i, j, base = [0, ka], [0, kb], 0
                    else:
                        base = int(ends[0][at_a - 1]) if at_a else 0
                        i, j = (x.tolist() for x in merge_path(ends[0][at_a : at_a + ka], ends[1][at_b : at_b + kb], work))
                    for k in range(len(i) - 1):
                        if filled >= block_tokens:
                            block, filled = block + 1, 0
                        filled += i[k + 1] - i[k] + j[k + 1] - j[k]
                        out["row"].append(row)
                        out["block"].append(block)
                        out["piece"].append(k)
                        out["pieces"].append(len(i) - 1)
                        out["a_start"].append(int(ends[0][at_a + i[k] - 1]) - base if i[k] else 0)
                        out["b_start"].append(int(ends[1][at_b + j[k] - 1]) - base if j[k] else 0)
                        out["a_next"].append(int(a[at_a + i[k + 1]]) if i[k + 1] < ka else -1)
                        out["b_next"].append(int(b[at_b + j[k + 1]]) if j[k + 1] < kb else -1)
                        sizes[0].append(i[k + 1] - i[k])
                        sizes[1].append(j[k + 1] - j[k])
                    at_a, at_b = at_a + ka, at_b + kb
                blobs = {"a": _blobs(a, sizes[0], v.type), "b": _blobs(b, sizes[1], v.type)}
                kinds = {"piece": pa.int32(), "pieces": pa.int32(), "a_next": pa.int32(), "b_next": pa.int32()}
                columns = [blobs[n] if n in blobs else pa.array(out[n], kinds.get(n, pa.int64())) for n in NAMES]
                yield pa.RecordBatch.from_arrays(columns, names=NAMES)

    return docs.select("row", "text").mapInArrow(run, PIECE)


BITS = 24  # ids are below 2^24 in a pair's code


def coded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a << BITS) | b


class Merged:
    """The merge of a batch of pieces, all in one pass: links, and which ends cut groups.

    Each piece gets a zone of byte offsets of its own, so that the batch is one merge. A
    link belongs to the end at which the overlap of its two tokens ends: an end of A, or an
    end of B where no token of A ends. The other token is the one of the piece that reaches
    the end, or the next one after the piece.
    """

    def __init__(self, v: Vocabularies, batch):
        self.size = batch.num_rows
        ids, ends, piece_of = [], [], []
        starts = [batch.column(c).to_numpy().astype(np.int64) for c in ("a_start", "b_start")]
        origin = np.minimum(*starts)
        flat, counts = [], []
        for name in ("a", "b"):
            rows = batch.column(name).to_pylist()
            flat.append(np.frombuffer(b"".join(rows), v.type).astype(np.int64))
            counts.append(np.array([len(r) // np.dtype(v.type).itemsize for r in rows], np.int64))
        reach = []
        for k in range(2):
            total = np.concatenate(([0], np.cumsum(v.lengths[k][flat[k]])))
            stop = np.cumsum(counts[k])
            reach.append(starts[k] - origin + total[stop] - total[stop - counts[k]])
        # Two more than the bytes of a piece: room for the next tokens' ends, which only have to be last.
        zones = np.cumsum(np.maximum(*reach) + 2)
        base = zones - (np.maximum(*reach) + 2)
        for k, name in enumerate(("a_next", "b_next")):
            which = np.repeat(np.arange(self.size), counts[k])
            total = np.cumsum(v.lengths[k][flat[k]])
            before = np.concatenate(([0], total))[np.cumsum(counts[k]) - counts[k]]
            own = total - before[which] + (base + starts[k] - origin)[which]
            # After the tokens of each piece: the next one, with the zone's last offset as its end.
            place = np.arange(len(own)) + which
            all_ids = np.empty(len(own) + self.size, np.int64)
            all_ends = np.empty(len(own) + self.size, np.int64)
            last = np.cumsum(counts[k]) + np.arange(self.size)
            all_ids[place], all_ids[last] = flat[k], batch.column(name).to_numpy()
            all_ends[place], all_ends[last] = own, zones - 1
            ids.append(all_ids)
            ends.append(all_ends)
            piece_of.append((which, place))
        (self.a_piece, a_place), (self.b_piece, b_place) = piece_of
        self.a_ids, self.b_ids = flat
        at = np.searchsorted(ends[1], ends[0][a_place], "left")
        own_a, own_b = ends[0][a_place], ends[1][b_place]
        met = np.searchsorted(ends[0], own_b, "left")
        # A group ends at this token of B: a token of A ends there too, here or as the last before the piece.
        cut = (ends[0][met] == own_b) | (own_b == (base + starts[0] - origin)[self.b_piece])
        self.link_piece = np.concatenate((self.a_piece, self.b_piece[~cut]))
        self.link_a = np.concatenate((self.a_ids, ids[0][met[~cut]]))
        self.link_b = np.concatenate((ids[1][at], self.b_ids[~cut]))
        # Groups of the batch in turn: each piece has one more than its cuts, the last one open.
        closed = own_b[cut]
        self.a_group = np.searchsorted(closed, own_a, "left") + self.a_piece
        self.b_group = np.searchsorted(closed, own_b, "left") + self.b_piece
        self.counts = counts
        self.groups = np.bincount(self.b_piece[cut], minlength=self.size)

    def pairs(self) -> tuple[pa.Array, pa.Array]:
        """Each piece's different pairs, coded, and how many links each of them has."""
        key, times = np.unique(self.link_piece << (2 * BITS) | coded(self.link_a, self.link_b), return_counts=True)
        ends = pa.array(np.searchsorted(key >> (2 * BITS), np.arange(self.size + 1)), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(key & ((1 << 2 * BITS) - 1))), pa.ListArray.from_arrays(ends, pa.array(times))

    def written(self, v: Vocabularies) -> tuple[memoryview, np.ndarray]:
        """All pieces' groups as text, ``a1,a2|b1;`` one after the other, and where each piece's text ends."""
        n = int(max(self.a_group.max(initial=-1), self.b_group.max(initial=-1))) + 1
        in_a, in_b = np.bincount(self.a_group, minlength=n), np.bincount(self.b_group, minlength=n)
        index = np.empty(len(self.a_group) + len(self.b_group), np.int64)
        a_last = np.append(self.a_group[1:] != self.a_group[:-1], True)[: len(self.a_group)]
        b_last = np.append(self.b_group[1:] != self.b_group[:-1], True)[: len(self.b_group)]
        index[np.arange(len(self.a_group)) + (np.cumsum(in_b) - in_b)[self.a_group]] = 2 * self.a_ids + a_last
        index[np.arange(len(self.b_group)) + np.cumsum(in_a)[self.b_group]] = v.b_shown + 2 * self.b_ids + b_last
        text = pc.take(v.shown, pa.array(index))
        stops = np.cumsum(self.counts[0] + self.counts[1])
        offsets = np.frombuffer(text.buffers()[1], np.int64)[: len(text) + 1] if len(text) else np.zeros(1, np.int64)
        return memoryview(text.buffers()[2] or b""), offsets[stops]

    def opened(self, k: int) -> dict:
        """A piece of a longer text: its first group, the whole groups after it, and its open last group."""
        a, b = (self.a_piece == k).nonzero()[0], (self.b_piece == k).nonzero()[0]
        low = int(np.cumsum(self.groups + 1)[k] - self.groups[k] - 1)
        parts: dict[int, tuple[list, list]] = {}
        for side, ids, groups, some in ((0, self.a_ids, self.a_group, a), (1, self.b_ids, self.b_group, b)):
            for i, g in zip(ids[some].tolist(), (groups[some] - low).tolist(), strict=True):
                parts.setdefault(g, ([], []))[side].append(str(i))
        last = int(self.groups[k])
        first, end = parts.get(0, ([], [])), parts.get(last, ([], [])) if last else ([], [])
        whole = ";".join(shown(*parts[g]) for g in range(1, last))
        return {"cuts": last, "a": ",".join(first[0]), "b": ",".join(first[1]), "whole": whole, "a_open": ",".join(end[0]), "b_open": ",".join(end[1])}


def shown(a: list[str], b: list[str]) -> str:
    return ",".join(a) + "|" + ",".join(b)


OPEN = "struct<cuts: int, a: string, b: string, whole: string, a_open: string, b_open: string>"
SUMS = ("n_a", "n_b", "n_groups", "n_links")
MERGED = "row bigint, block bigint, piece int, pieces int, " + ", ".join(f"{c} bigint" for c in SUMS) + (
    f", pairs array<bigint>, times array<bigint>, sha string, open {OPEN}"
)


def merged(parts: DataFrame, paths: tuple[str, ...]) -> DataFrame:
    """Merge each piece: its numbers, its different pairs with their links, and its groups.

    ``sha`` is the digest of the groups of a text of one piece ('' without tokens); a piece
    of a longer text has its groups in ``open`` instead, as they may go on in the next one.
    """
    texts = pa.struct([("cuts", pa.int32()), *((c, pa.string()) for c in ("a", "b", "whole", "a_open", "b_open"))])

    def run(batches):
        v = vocabularies(*paths)
        for batch in batches:
            if not batch.num_rows:
                continue
            m = Merged(v, batch)
            text, stops = m.written(v)
            starts = np.concatenate(([0], stops[:-1]))
            pieces_ = batch.column("pieces").to_pylist()
            sha = [
                None if n > 1 else hashlib.sha256(text[a : b - 1]).hexdigest() if b > a else ""
                for n, a, b in zip(pieces_, starts.tolist(), stops.tolist(), strict=True)
            ]
            open_ = pa.array([m.opened(k) if n > 1 else None for k, n in enumerate(pieces_)], texts)
            links = np.bincount(m.link_piece, minlength=m.size)
            numbers = [pa.array(x.astype(np.int64)) for x in (m.counts[0], m.counts[1], m.groups, links)]
            columns = [batch.column(c) for c in ("row", "block", "piece", "pieces")] + numbers + [*m.pairs(), pa.array(sha, pa.string()), open_]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in MERGED.split(", ")[:12]])

    return parts.mapInArrow(run, MERGED)


def pair_facts(done: DataFrame) -> DataFrame:
    """(pair, n, best): in how many texts a pair is linked, and whether no pair of its A id is in more.

    A text in pieces counts a pair once, so there the texts' pairs are made distinct first.
    """
    pair = F.explode("pairs").alias("pair")
    short = done.where("pieces = 1").select(pair).groupBy("pair").agg(F.count("*").alias("n"))
    long = done.where("pieces > 1").select("row", pair).distinct().groupBy("pair").agg(F.count("*").alias("n"))
    counts = settle(short.unionByName(long).groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    a = F.shiftright("pair", BITS)
    most = settle(counts.groupBy(a.alias("a")).agg(F.max("n").alias("most")), "most")
    return settle(counts.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "facts")


LOOKED = "row bigint, " + ", ".join(f"{c} bigint" for c in (*SUMS, "n_best", "count_sum")) + ", sha string"


def looked_up(done: DataFrame, facts: DataFrame) -> DataFrame:
    """Each piece's links with their pairs' facts, block by block: a block asks once for a pair."""
    # The two sides of the cogroup come from one table: an alias tells their columns apart.
    asked = done.select(F.col("block").alias("block"), F.explode("pairs").alias("pair")).distinct().join(facts, "pair").select("block", "pair", "n", "best")

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("pair")
        pair, n, best = (known.column(c).to_numpy() for c in ("pair", "n", "best"))
        rows = rows.combine_chunks()
        pairs = rows.column("pairs").combine_chunks()
        times = rows.column("times").combine_chunks().flatten().to_numpy()
        at = np.searchsorted(pair, pairs.flatten().to_numpy())
        ends = np.concatenate(([0], np.cumsum(pairs.value_lengths().to_numpy())))

        def summed(x):
            total = np.concatenate(([0], np.cumsum(x)))[ends]
            return pa.array(np.diff(total), pa.int64())

        columns = [rows.column("row"), *(rows.column(c) for c in SUMS), summed(times * best[at]), summed(times * n[at]), rows.column("sha")]
        return pa.Table.from_arrays(columns, names=[c.split()[0] for c in LOOKED.split(", ")])

    left = done.select("block", "row", *SUMS, "pairs", "times", "sha")
    return left.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(run, LOOKED)


def stitched(done: DataFrame) -> DataFrame:
    """(row, whole_sha) of the texts in pieces: groups that go on in the next piece are put together."""

    def run(parts: pa.Table) -> pa.Table:
        rows = parts.sort_by("piece").to_pylist()
        digest, first, a, b = hashlib.sha256(), True, [], []
        for r in rows:
            o = r["open"]
            a, b = a + [o["a"]], b + [o["b"]]
            if o["cuts"]:
                groups = [shown([x for x in a if x], [x for x in b if x]), *([o["whole"]] if o["whole"] else [])]
                digest.update((("" if first else ";") + ";".join(groups)).encode())
                first, a, b = False, [o["a_open"]], [o["b_open"]]
        return pa.table({"row": [rows[0]["row"]], "whole_sha": [digest.hexdigest()]})

    return done.where("pieces > 1").select("row", "piece", "open").groupBy("row").applyInArrow(run, "row bigint, whole_sha string")


def align(
    docs: DataFrame, paths: tuple[str, ...], text: str = "text", work: int = WORK, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """The rows of ``docs`` (a plain read), without the text, with the alignment of its tokens.

    Adds ``n_a`` and ``n_b`` (tokens), ``n_groups`` (runs between bytes where tokens of both
    end), ``n_links`` (pairs of tokens whose bytes overlap), ``n_best`` (links whose pair is
    in as many texts as any pair of its A id), ``count_sum`` (texts that hold the pair, over
    the links) and ``groups_sha256`` of ``a1,a2|b1;a3|b2,b3``. ``paths`` are those of
    :class:`Vocabularies`, the same on every machine.

    Null and empty texts, and texts that a tokenizer changes, have no tokens: zeros and ''.
    Repeated rows and repeated or null ids stay rows of their own, each counted as a text.
    Ties for the best pair all count. An empty table gives no rows. Input columns with the
    added names are replaced. Tokenizing takes a text as a whole; all later work is by piece,
    but for the digest, which reads the groups of one text in turn.
    """
    added = (*SUMS, "n_best", "count_sum", "groups_sha256")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added and c != text])
    spark = docs.sparkSession
    plain = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    with arrow_rows(spark, BATCH_ROWS):
        parts = settle(pieces(plain, paths, work, block_tokens), "pieces")
        done = settle(merged(parts, paths), "merged")
    looked = looked_up(done, pair_facts(done))
    sums = looked.groupBy("row").agg(*(F.sum(c).alias(c) for c in (*SUMS, "n_best", "count_sum")), F.max("sha").alias("sha"))
    found = settle(sums.join(stitched(done), "row", "left").withColumn("groups_sha256", F.coalesce("whole_sha", "sha")), "found")
    row = fresh(docs, "row")
    rest = [c for c in docs.columns if c != text]
    return with_row(docs, row).join(found.select(F.col("row").alias(row), *added), row).select(*rest, *added)
