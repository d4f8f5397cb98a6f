import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from postingflow.llm import alignment as A
from postingflow.llm.queries import ALIGNED, QUERIES
from tests.llm.helpers import CLASH, SCHEMA, odd_documents, stored, with_clashes

PATHS = (*map(P.path, ALIGNED), P.PATTERN)
NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def plain(texts):
    """The columns of each text, token by token, with the libraries' plain calls."""
    a_model = Tokenizer.from_file(PATHS[0])
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=PATHS[2])
    v = A.Vocabularies(*PATHS)
    a_bytes, b_bytes = (table.to_pylist() for table in v.bytes)
    tokens, links = [], []
    for t in texts:
        a = a_model.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_model.encode(t) if t else []
        want = (" " + t).encode() if t else b""
        if b"".join(a_bytes[i] for i in a) != want or b"".join(b_bytes[i] for i in b) != want:
            a, b = [], []
        ea, eb = np.cumsum([len(a_bytes[i]) for i in a]), np.cumsum([len(b_bytes[i]) for i in b])
        met, j = [], 0
        for i in range(len(a)):
            start = ea[i - 1] if i else 0
            while j < len(b) and eb[j] <= start:
                j += 1
            k = j
            while k < len(b) and (eb[k - 1] if k else 0) < ea[i]:
                met.append((a[i], b[k]))
                k += 1
        cuts = sorted(set(ea.tolist()) & set(eb.tolist()))
        groups, p, q = [], 0, 0
        for c in cuts:
            x, y = p, q
            while p < len(a) and ea[p] <= c:
                p += 1
            while q < len(b) and eb[q] <= c:
                q += 1
            groups.append(",".join(map(str, a[x:p])) + "|" + ",".join(map(str, b[y:q])))
        tokens.append((len(a), len(b), len(groups), ";".join(groups)))
        links.append(met)
    count = {}
    for met in links:
        for pair in set(met):
            count[pair] = count.get(pair, 0) + 1
    most = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    return [
        (na, nb, ng, len(met), sum(count[x] == most[x[0]] for x in met), sum(count[x] for x in met),
         hashlib.sha256(text.encode()).hexdigest() if na else "")
        for (na, nb, ng, text), met in zip(tokens, links, strict=True)
    ]


def strange_texts():
    rnd = random.Random(5)
    pool = list("abcdeABZ019 .,|'\n\t-_é É ß ſ İ Σ ς ñ Ḱक़ \u0085​　你好ا") + [
        "▁", "\x00", "\x1c", "\x7f", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "  ", "they're", "😀", "é", "ﬁ", "½", "\r\n", "한국", "ελ", "ход",
    ]
    return ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60))) for _ in range(1500)] + ["", " ", "\n", "▁", "x" * 3000, " " * 2000 + "y"]


def test_ids_and_bytes_against_the_libraries():
    texts = strange_texts()
    v = A.Vocabularies(*PATHS)
    (a, na), (b, nb) = v.encode(texts)
    want = plain(texts)
    assert [(x, y) for x, y in zip(na.tolist(), nb.tolist(), strict=True)] == [w[:2] for w in want]
    assert any(w[0] == 0 for w, t in zip(want, texts, strict=True) if t) and sum(w[0] > 0 for w in want) > 800
    full = Tokenizer.from_file(PATHS[0])
    full.encode_special_tokens = True
    ids = [i for t, n in zip(texts, na, strict=True) if n for i in full.encode(" " + t, add_special_tokens=False).ids]
    assert a.tolist() == ids and len(a) == na.sum() and len(b) == nb.sum()


def test_tame_texts_are_read_alike():
    rnd = random.Random(6)
    chars = [chr(c) for c in range(0x20, 0x4500) if A.TAME.fullmatch(chr(c))] + ["\n", "\t", "\r", "'s", "'ll", "  ", "龥"]
    texts = ["".join(rnd.choice(chars) for _ in range(rnd.randint(1, 50))) for _ in range(4000)]
    v = A.Vocabularies(*PATHS)
    assert [v.quick.encode_ordinary(t) for t in texts] == [e.ids for e in v.full.encode_batch(texts, add_special_tokens=False)]


def test_merge_path_borders():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(rng.integers(1, 60, rng.integers(0, 40))) for _ in range(2))
        work = int(rng.integers(1, 20))
        i, j = A.merge_path(a, b, work)
        order = sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])
        for d, p, q in zip([*range(0, max(len(order), 1), work), len(order)], i, j, strict=True):
            assert (p, q) == (sum(s == 0 for _, s in order[:d]), sum(s == 1 for _, s in order[:d]))


@pytest.mark.parametrize("work, block", [(1 << 16, 1 << 22), (7, 50), (64, 3000)])
def test_against_plain_loops(spark, work, block):
    rows = odd_documents()
    rows += [(1000 + i, t, "en", "s") for i, t in enumerate(strange_texts()[:300] + strange_texts()[-6:])]
    docs = stored(spark, with_clashes(rows), SCHEMA + CLASH).withColumnRenamed("position", "n_links")
    got = A.align(docs, PATHS, work=work, block_tokens=block)
    assert set(NAMES) <= set(got.columns) and got.columns.count("n_links") == 1 and "row" in got.columns and "text" not in got.columns
    want = [(r[0], *w) for r, w in zip(rows, plain([r[1] or "" for r in rows]), strict=True)]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got.select("doc_id", *NAMES).collect()), key=key) == sorted(want, key=key)


def test_empty_table(spark):
    assert A.align(stored(spark, [], SCHEMA), PATHS).count() == 0


def test_registered_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    df = QUERIES["op13_tokenizer_alignment"](spark, sf_dir)
    assert df.columns == ["doc_id", *NAMES] and all(t == "bigint" for c, t in df.dtypes if c != "groups_sha256")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = [(r[0], *w) for r, w in zip(rows, plain([r[1] or "" for r in rows]), strict=True)]
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)
