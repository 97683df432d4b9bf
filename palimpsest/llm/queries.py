"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import codebooks, mixing, negatives
from palimpsest.llm.bpe import op8_byte_bpe
from palimpsest.llm.codebooks import op13_vector_codes
from palimpsest.llm.decontamination import op2_benchmark_decontamination
from palimpsest.llm.licenses import op4_license_scan
from palimpsest.llm.mixing import op12_source_mix
from palimpsest.llm.negatives import op11_hard_negatives
from palimpsest.llm.repeats import op7_suffix_dedup
from palimpsest.llm.secret_scan import op1_secret_scan
from palimpsest.llm.sharding import op5_shard_shuffle
from palimpsest.llm.simhash_dedup import op9_simhash_near_dedup
from palimpsest.llm.sketches import op10_document_fingerprints
from palimpsest.llm.toxicity import op3_toxicity
from palimpsest.llm.wrapper import op6_html_extraction


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_secret_scan, op2_benchmark_decontamination, op3_toxicity, op4_license_scan, op5_shard_shuffle, op6_html_extraction, op7_suffix_dedup, op8_byte_bpe, op9_simhash_near_dedup, op10_document_fingerprints, op11_hard_negatives, op12_source_mix, op13_vector_codes)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op11_hard_negatives": negatives.SQL, "op12_source_mix": mixing.SQL, "op13_vector_codes": codebooks.SQL}
