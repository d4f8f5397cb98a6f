import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postingflow.llm import mixing, tokens
from postingflow.llm import packing as P
from postingflow.llm.queries import QUERIES
from postingflow.llm.tokens import slices
from postingflow.session import settle
from tests.llm.helpers import CLASH, SCHEMA, odd_documents, stored, with_clashes

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain(texts, plain_specials=False):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = plain_specials
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def strange_texts():
    rnd = random.Random(1)
    pool = list("abcdeABZ019 .,|'\n\t\r-_é É ß ſ İ Σ ς ñ × ÷ ÿ Ḱक़ \u0085\xa0​\u3000你好اªº²¼«»¿…–“”") + [
        "'s", "'re", "'ll", "'", "...", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "  ", "they're", "Don't", "word.", "x.,", "a|b | ", "e\u0301", "1'd", "\"'s", "''t", "'Sx",
    ]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40))) for _ in range(4000)]
    tame = [c for c in pool if tokens.TAME.fullmatch(c) and "|" not in c]
    texts += ["".join(rnd.choice(tame) for _ in range(rnd.randint(0, 60))) for _ in range(4000)]
    return texts + [None, "", " ", "a <|endoftext|> b", "y" * 3000, "Word " * 50]


@pytest.mark.parametrize("plain_specials", [False, True])
def test_encoder_against_the_library(plain_specials):
    texts = strange_texts()
    ids, counts = tokens.WordEncoder(PATH, plain_specials).encode(pa.array(texts))
    want = plain(texts, plain_specials)
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert (49407 in ids) == (not plain_specials)
    assert list(slices(pa.array(["aaa", "b", "cc", None]), 3)) == [(0, 1), (1, 4)]


def test_pieces_and_round_trip(spark):
    rows = odd_documents()
    docs = stored(spark, with_clashes(rows), SCHEMA + CLASH).drop("doc_tokens")
    made = settle(P.pieces(docs, PATH), "pieces")
    packed = P.pack_texts(made).collect()
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, t)
    want = dict(zip(texts, plain(texts.values())))
    by_text, bins = {}, {}
    for r in packed:
        assert r["length"] <= 4096 and len(r["ids"]) == 4 * r["length"]
        by_text.setdefault(r["doc_id"], {})[r["start"]] = r["ids"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, parts in by_text.items():
        ids = np.frombuffer(b"".join(parts[s] for s in sorted(parts)), "<u4").tolist()
        assert ids == want[i] + [2]
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(packed) == len(rows) + sum((len(w)) // 4096 for i, w in want.items())
    assert zlib.crc32(b"") == 0


def test_limits_hold_together():
    rng = np.random.default_rng(2)
    demands = np.column_stack([rng.integers(1, 4000, 600), rng.integers(0, 900, 600), np.ones(600)]).astype(float)
    limits = np.array([4096.0, 1000.0, 8.0])
    bins = P.fill(demands, limits)
    sums = np.array([demands[bins == b].sum(axis=0) for b in range(bins.max() + 1)])
    assert (sums <= limits).all() and bins.min() == 0
    least = np.ceil(demands.sum(axis=0) / limits).max()
    assert bins.max() + 1 <= 1.15 * least
    alone = P.fill(np.array([[5000.0, 1, 1], [10, 1, 1]]), limits)
    assert alone[0] != alone[1]


def test_little_padding_and_many_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(n), int(n) - 1) for i, n in enumerate(np.minimum(rng.lognormal(6, 1.2, 3000).astype(int) + 1, 4096))]
    items = stored(spark, rows, "id bigint, length bigint, loss_tokens bigint")
    got = P.pack(items, {"length": 4096, "loss_tokens": 4096}, group_rows=1000, one=256).toPandas()
    sizes = got.groupby("sequence_id")["length"].sum()
    assert sizes.max() <= 4096 and sizes.sum() / (4096 * len(sizes)) > 0.97 and len(got) == 3000


def test_empty_and_nulls(spark):
    assert P.pack_texts(settle(P.pieces(stored(spark, [], SCHEMA), PATH), "none")).count() == 0
    items = stored(spark, [(1, None, None), (2, 5, 4)], "id bigint, length bigint, loss_tokens bigint")
    assert P.pack_texts(items).count() == 2


def test_registered_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    df = QUERIES["op9_packing"](spark, sf_dir)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(df.columns)
    rows = df.collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    for d, ids in zip(docs, plain([d["text"] for d in docs]), strict=True):
        ids, at = np.array([*ids, 2], "<u4"), 0
        for r in sorted(pieces.pop(d["doc_id"]), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert not pieces
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 4096
    assert sum(n for p in bins.values() for _, n in p) > 0.9 * 4096 * (len(bins) - 1)


def test_fill_in_turn():
    rng = np.random.default_rng(3)
    lengths = np.minimum(rng.lognormal(6, 1.2, 3000).astype(int) + 1, 4096)
    demands = np.column_stack([lengths, lengths - 1, np.ones(3000)]).astype(float)
    limits = np.array([4096.0, 4096.0, 256.0])
    bins = P.fill_in_turn(demands, limits, 512)
    places = [np.flatnonzero(bins == b) for b in range(bins.max() + 1)]
    assert all((demands[p].sum(axis=0) <= limits).all() and p[-1] - p[0] < 512 for p in places)
    assert [p[0] for p in places] == sorted(p[0] for p in places)
    assert lengths.sum() / (4096 * len(places)) > 0.97
    alone = P.fill_in_turn(np.array([[5000.0, 1, 1], [10, 1, 1], [20, 1, 1]]), limits)
    assert alone.tolist() == [0, 1, 1]
    assert P.fill_in_turn(np.zeros((0, 3)), limits).tolist() == []


def test_sequences_follow_the_order_of_the_files(spark, tmp_path):
    """Later files are larger, so that a scan takes them first; groups are cut across files."""
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(n)) for i, n in enumerate(rng.integers(1, 60, 3000) * (1 + np.arange(3000) // 500))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.repartitionByRange(6, "doc_id").sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "mix"))
    turns = mixing.with_turns(spark.read.parquet(str(tmp_path / "mix")), "f", "r")
    items = settle(turns.select("doc_id", "f", "r", (F.length("text") + 1).cast("bigint").alias("length")), "items")
    got = P.pack(items, {"length": 4096}, group_rows=700, one=256, order=["f", "r"]).toPandas()
    firsts = got.groupby("sequence_id")["doc_id"].agg(["min", "max"]).sort_index()
    assert firsts["min"].is_monotonic_increasing and (firsts["max"] - firsts["min"]).max() < P.WINDOW
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id")["doc_id"].diff().dropna() > 0).all()
    assert sorted(got["doc_id"]) == list(range(3000)) and got["sequence_id"].floordiv(1 << 32).nunique() > 3
