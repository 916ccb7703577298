"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .brown import op2_brown_lm
from .decontaminate import op8_decontaminate
from .divergence import OP11_SQL, op11_source_divergence
from .language import op4_language_id
from .packing import op6_pack
from .pieces import op12_sentencepiece
from .pii import op5_pii
from .secrets import op7_secret_scan
from .simhash import op10_simhash_dedup
from .tools import OP9_SQL, op9_chat_format
from .topk import OP1_SQL, op1_top_k
from .url_filter import OP3_SQL, op3_url_filter
from .whitening import op13_whiten


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_top_k, op2_brown_lm, op3_url_filter, op4_language_id, op5_pii, op6_pack, op7_secret_scan, op8_decontaminate, op9_chat_format, op10_simhash_dedup, op11_source_divergence, op12_sentencepiece, op13_whiten, pipeline)}
SQL = {"op1_top_k": OP1_SQL, "op3_url_filter": OP3_SQL, "op9_chat_format": OP9_SQL, "op11_source_divergence": OP11_SQL}
