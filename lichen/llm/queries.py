"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lichen.llm._shared import ship
from lichen.llm.chat_format import OP1_SQL, op1_chat_format
from lichen.llm.embedding_dedup import OP7_SQL, op7_embedding_dedup
from lichen.llm.id_files import op6_id_files
from lichen.llm.line_dedup import OP10_SQL, op10_line_dedup
from lichen.llm.minhash_dedup import OP8_SQL, op8_minhash_dedup
from lichen.llm.mixing import op5_source_mix
from lichen.llm.packing import op4_best_fit_packing
from lichen.llm.permutation_index import op2_permutation_index
from lichen.llm.secrets import op3_secret_scan
from lichen.llm.toxicity import op9_toxicity



def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _shipped(f)
    for f in (
        op1_chat_format,
        op2_permutation_index,
        op3_secret_scan,
        op4_best_fit_packing,
        op5_source_mix,
        op6_id_files,
        op7_embedding_dedup,
        op8_minhash_dedup,
        op9_toxicity,
        op10_line_dedup,
    )
}

ORACLE_SQL: dict[str, str] = {"op1_chat_format": OP1_SQL, "op7_embedding_dedup": OP7_SQL, "op8_minhash_dedup": OP8_SQL, "op10_line_dedup": OP10_SQL}
