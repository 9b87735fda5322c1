"""One query per operator, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import oracles
from .common import table, tuned

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(tuned(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op2_minhash_near_dedup", oracles.NEAR_DUPLICATES)
def op2(spark, sf_dir):
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


@query("op3_quality_classifier")
def op3(spark, sf_dir):
    from .quality import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_token_records")
def op9(spark, sf_dir):
    import public_tokenizers

    from .records import read_records, write_records

    base, _ = write_records(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_records(spark, base)


@query("op10_language_id")
def op10(spark, sf_dir):
    from .langid import predict, train

    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))


@query("op1_template_decontamination")
def op1(spark, sf_dir):
    from .templates import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_secret_scan")
def op5(spark, sf_dir):
    from .secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


@query("op6_mix_sources")
def op6(spark, sf_dir):
    from .mixing import mix_sources, temperature_weights

    docs = table(spark, sf_dir, "documents")
    return mix_sources(docs, temperature_weights(docs)).select("doc_id", "source", "block", "release", "deadline", "slot", "place")


@query("op7_quote_links", oracles.QUOTES)
def op7(spark, sf_dir):
    from .quotes import link_quotes

    # -1 for a message without a parent
    return link_quotes(table(spark, sf_dir, "conversations")).withColumn("parent_turn", F.coalesce("parent_turn", F.lit(-1)))


@query("op8_embedding_near_dedup", oracles.NEAR_VECTORS)
def op8(spark, sf_dir):
    from .hnsw import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.98)


@query("op4_page_text")
def op4(spark, sf_dir):
    from .pages import extract

    return extract(table(spark, sf_dir, "pages"))


@query("op11_hard_negatives", oracles.HARD_NEGATIVES)
def op11(spark, sf_dir):
    from .negatives import hard_negatives

    return hard_negatives(table(spark, sf_dir, "embeddings"))


@query("op12_nearest_neighbours")
def op12(spark, sf_dir):
    from .vamana import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


@query("op13_align_tokenizers")
def op13(spark, sf_dir):
    import public_tokenizers

    from .align import align_documents

    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
