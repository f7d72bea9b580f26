"""The queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from verdigris.llm.bpe import op5_byte_bpe
from verdigris.llm.chat import OP3_SQL, op3_chat_format
from verdigris.llm.clustering import OP11_SQL, op11_clustering
from verdigris.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from verdigris.llm.mixing import op7_mixing
from verdigris.llm.pii import op10_pii
from verdigris.llm.quality import op2_quality
from verdigris.llm.repeats import op9_repeats
from verdigris.llm.sharding import OP13_SQL, op13_sharding
from verdigris.llm.simhash import op4_simhash
from verdigris.llm.topk import OP1_SQL, op1_topk
from verdigris.llm.urls import OP8_SQL, op8_url_filter
from verdigris.llm.whitening import op12_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_topk": op1_topk,
        "op2_quality": op2_quality,
        "op3_chat_format": op3_chat_format,
        "op4_simhash": op4_simhash,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_mixing": op7_mixing,
        "op8_url_filter": op8_url_filter,
        "op9_repeats": op9_repeats,
        "op10_pii": op10_pii,
        "op11_clustering": op11_clustering,
        "op12_whitening": op12_whitening,
        "op13_sharding": op13_sharding,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    own = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return own | {"op1_topk": OP1_SQL, "op3_chat_format": OP3_SQL, "op6_exact_dedup": OP6_SQL, "op8_url_filter": OP8_SQL, "op11_clustering": OP11_SQL, "op13_sharding": OP13_SQL}
