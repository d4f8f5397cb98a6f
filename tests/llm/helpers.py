"""Small tables for the operator tests."""

import random

from postingflow.session import settle

WORDS = "red green blue stone river cloud paper light seven night ocean maple tiger cabin orbit lemon".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def stored(spark, rows, schema):
    """The rows as a plain read of files."""
    return settle(spark.createDataFrame(rows, schema), "test")


def odd_documents():
    """Nulls, empty and long texts, copies, repeated rows, ids that repeat or are missing."""
    rnd = random.Random(4)
    long = prose(rnd, 9000)
    rows = [(i, prose(rnd, rnd.randint(1, 60)), "en", "s0") for i in range(40)]
    rows += [(100, None, None, None), (101, "", "en", "s1"), (102, "  \n\t", "de", "s1"), (103, long, "en", "s0"), (104, long.upper(), "en", None)]
    rows += [(200 + i, "Same text for many rows é", "fr", "s0") for i in range(30)]
    rows += [(300, "twice", "en", "s2"), (300, "twice", "en", "s2"), (None, "no id", "en", "s2"), (None, "no id", None, "s2")]
    return rows


SCHEMA = "doc_id bigint, text string, lang string, source string"
# Columns whose names the operators use themselves.
CLASH = ", row string, shard string, slot int, bits int, score string, sequence_id string, block int, position int, digest int, kept string"


def with_clashes(rows):
    return [(*r, "r", "x", 1, 2, "s", "q", 3, 4, 5, "k") for r in rows]
