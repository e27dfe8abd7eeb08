"""Registered queries of the text operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import bpe, chat, decontaminate, langid, multiindex, secrets, sharding, simhash, suffixes, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_sharding": sharding.op1_sharding,
        "op2_embeddings": multiindex.op2_embeddings,
        "op3_secrets": secrets.op3_secrets,
        "op4_chat": chat.op4_chat,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_langid": langid.op6_langid,
        "op7_warc": warc.op7_warc,
        "op8_suffixes": suffixes.op8_suffixes,
        "op9_bpe": bpe.op9_bpe,
        "op10_simhash": simhash.op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    """For the others SQL has no hash, automaton or tiling that they need; tests hold them against brute force."""
    return {"op2_embeddings": multiindex.OP2_SQL, "op4_chat": chat.OP4_SQL, "op7_warc": warc.OP7_SQL}
