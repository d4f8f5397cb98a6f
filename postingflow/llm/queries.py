"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postingflow.llm import alignment, ann, embedding_dedup, exact_dedup, language_id, mixing, packing, secret_scan, sharding, simhash, sql, toxicity, url_filter, whitening
from postingflow.llm.common import arrow_rows, crc
from postingflow.session import settle

QUERIES, ORACLES = {}, {}
VOCABULARY = "word_bpe_49k.json"
ALIGNED = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")

RULES = (
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
)


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query("op1_secret_scan", sql.SECRETS)
def secrets(spark, sf_dir):
    found = secret_scan.scan_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = [secret_scan.counted(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select(
        "doc_id", *kinds,
        F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"),
        secret_scan.joined(F.col("found")).alias("spans"),
    )


@query("op2_sharding")
def shards(spark, sf_dir):
    dealt = sharding.shard_rows(read(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint") + 1
    return dealt.select(
        "doc_id", size.alias("size"), crc(F.col("text")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def remainder(id_column: str, n: int):
    """CRC-32 of the id as text, modulo n; a null id counts as empty text."""
    return F.pmod(crc(F.col(id_column).cast("string")), F.lit(n))


@query("op3_language_id")
def languages(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", remainder("doc_id", 3) == 1)
    model = language_id.train(docs.where("NOT held_out"))
    return language_id.identify(docs.drop("lang"), model)


@query("op4_simhash_near_dedup")
def near(spark, sf_dir):
    groups = simhash.near_groups(read(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hexed(F.col("mark")).alias("fingerprint"), "component_id")


@query("op5_nearest_neighbours")
def neighbours(spark, sf_dir):
    vectors = ann.prepared(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    index = ann.build(vectors)
    if index is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return ann.nearest(vectors, vectors.where("id % 20 = 0"), index)


def toxic_model(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    learned = labels.where(remainder("doc_id", 5) != 0)
    return toxicity.train(toxicity.labelled_sample(docs.select("doc_id", "text"), learned))


@query("op6_toxicity")
def toxic(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxic_model(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs.withColumn("held_out", remainder("doc_id", 5) == 0), model)


@query("op7_mixing")
def mixed(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source"))


@query("op8_exact_dedup", sql.EXACT)
def exact(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    index = exact_dedup.open_scratch_index(spark, exact_dedup.buckets_for(docs.count()))
    owned = exact_dedup.assign_owners(docs, index)
    index.close()
    return owned.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def packed(docs: DataFrame, mixed: bool = False) -> DataFrame:
    """Pieces with the checksum of their ids; tokenized once, then packed by their lengths.

    With ``mixed``, ``docs`` is a read of a mix's files, whose order the sequences follow.
    """
    order = ["mix_file", "mix_row"] if mixed else []
    texts = docs.select("doc_id", "text")
    texts = mixing.with_turns(texts, *order) if mixed else texts
    made = packing.pieces(texts, public_tokenizers.path(VOCABULARY), checksums=True)
    with arrow_rows(docs.sparkSession, packing.BATCH_ROWS):
        made = settle(made, "pieces")
    return packing.pack_texts(made, order=[*order, "start"] if mixed else None).drop("loss_tokens", *order)


@query("op9_packing")
def pack(spark, sf_dir):
    return packed(read(spark, sf_dir, "documents"))


@query("op10_url_filter")
def urls(spark, sf_dir):
    """Labels are the rules' own verdicts: the trees carry them over to urls no rule fits."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    host, path = url_filter.host_and_path(F.col("url"))
    labelled = pages.withColumn("hit", url_filter.fitting_rule(host, path, RULES)).where("hit IS NOT NULL")
    model = url_filter.train(labelled.withColumn("blocked", (F.col("hit")["verdict"] == "block").cast("int")), "url", "blocked")
    return url_filter.judge(pages, "url", model, RULES)


@query("op11_whitening")
def whitened(spark, sf_dir):
    made = whitening.whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "value")
    return made.select("vec_id", "n", "deviation", "identity_error", each).select(
        "vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", F.col("value.whitened").alias("whitened"),
        F.col("value.explained").alias("explained"), "identity_error",
    )


@query("op12_embedding_near_dedup")
def near_vectors(spark, sf_dir):
    return embedding_dedup.near_copies(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), "vec_id", "embedding", "label").drop("label")


@query("op13_tokenizer_alignment")
def aligned(spark, sf_dir):
    paths = (*map(public_tokenizers.path, ALIGNED), public_tokenizers.PATTERN)
    return alignment.align(read(spark, sf_dir, "documents").select("doc_id", "text"), paths)
