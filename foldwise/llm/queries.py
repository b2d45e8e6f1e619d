"""Queries of the ten operators."""

from __future__ import annotations

from foldwise.llm import bpe, chat, decontam, knquality, mainhtml, mixing, neardup, rules, sharding, tokenfile
from foldwise.runtime import table


def op3_sharding(spark, sf_dir):
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def queries():
    return {"op1_chat_format": chat.query, "op2_token_file": tokenfile.query, "op3_sharding": op3_sharding, "op4_near_duplicates": neardup.query, "op5_context_mixing": mixing.query, "op6_decontamination": decontam.query, "op7_quality_rules": rules.query, "op8_main_html": mainhtml.query, "op9_kn_quality": knquality.query, "op10_bpe": bpe.query}


def oracle_sql():
    return {"op1_chat_format": chat.ORACLE, "op3_sharding": sharding.oracle()}
