"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm.decontaminate import op7_seed_alignment
from quern.llm.gru import op2_byte_gru
from quern.llm.hilbert import op3_hilbert_shards
from quern.llm.images import op6_local_descriptors
from quern.llm.lines import op8_minhash_lines
from quern.llm.packing import op4_swap_packing
from quern.llm.quality import op5_bradley_terry
from quern.llm.simhash import op9_simhash_gray
from quern.llm.tagpaths import op1_tag_paths
from quern.llm.toxicity import op10_levenshtein_trie


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_tag_paths": op1_tag_paths,
        "op2_byte_gru": op2_byte_gru,
        "op3_hilbert_shards": op3_hilbert_shards,
        "op4_swap_packing": op4_swap_packing,
        "op5_bradley_terry": op5_bradley_terry,
        "op6_local_descriptors": op6_local_descriptors,
        "op7_seed_alignment": op7_seed_alignment,
        "op8_minhash_lines": op8_minhash_lines,
        "op9_simhash_gray": op9_simhash_gray,
        "op10_levenshtein_trie": op10_levenshtein_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {}
