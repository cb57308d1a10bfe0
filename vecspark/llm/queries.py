"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import functools

from vecspark.llm.bit_sliced import OP3_SQL, op3_top_k
from vecspark.llm.common import ship_package
from vecspark.llm.html_extract import op10_html
from vecspark.llm.minhash import OP8_SQL, op8_minhash
from vecspark.llm.mixing import OP9_SQL, op9_mixing
from vecspark.llm.quality import op5_quality
from vecspark.llm.simhash import op7_simhash
from vecspark.llm.sentencepiece_bpe import op4_sentencepiece
from vecspark.llm.substring_dedup import OP2_SQL, op2_substring
from vecspark.llm.token_files import op6_token_files
from vecspark.llm.toxicity import op1_toxicity


def _shipped(query):
    @functools.wraps(query)
    def run(spark, sf_dir):
        ship_package(spark)
        return query(spark, sf_dir)

    return run


_QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_substring": op2_substring,
    "op3_top_k": op3_top_k,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_quality": op5_quality,
    "op6_token_files": op6_token_files,
    "op7_simhash": op7_simhash,
    "op8_minhash": op8_minhash,
    "op9_mixing": op9_mixing,
    "op10_html": op10_html,
}
QUERIES = {name: _shipped(query) for name, query in _QUERIES.items()}

ORACLE_SQL = {
    "op2_substring": OP2_SQL,
    "op3_top_k": OP3_SQL,
    "op8_minhash": OP8_SQL,
    "op9_mixing": OP9_SQL,
}
