"""The queries of the corpus operators and the SQL that some of them can be held against."""

from __future__ import annotations

import corpus_pipeline

from . import chat, covertree, decontam, merkle, mixing, paragraphs, pii, quality, repair, sharding, simhash, toxicity, warc

QUERIES = {
    "op1_pii": pii.op1,
    "op2_sharding": sharding.op2,
    "op3_mixing": mixing.op3,
    "op4_quality": quality.op4,
    "op5_simhash": simhash.op5,
    "op6_toxicity": toxicity.op6,
    "op7_decontamination": decontam.op7,
    "op8_embeddings": covertree.op8,
    "op9_chat": chat.op9,
    "op10_paragraphs": paragraphs.op10,
    "op11_repair": repair.op11,
    "op12_warc": warc.op12,
    "op13_manifest": merkle.op13,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {"op7_decontamination": decontam.OP7_SQL, "op8_embeddings": covertree.OP8_SQL, "op11_repair": repair.OP11_SQL, "op12_warc": warc.OP12_SQL, "op13_manifest": merkle.OP13_SQL}
