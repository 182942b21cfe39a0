"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from tallyspark.llm.byte_bpe import op4_byte_bpe
from tallyspark.llm.centroids import OP11_SQL, op11_centroid_clustering
from tallyspark.llm.chosen_path import op5_ngram_jaccard
from tallyspark.llm.html_text import op9_html_text
from tallyspark.llm.neural_lm import op8_neural_lm
from tallyspark.llm.packing import op2_best_fit_packing
from tallyspark.llm.quality_rules import OP6_SQL, op6_quality_rules
from tallyspark.llm.secret_scans import op10_secret_scans
from tallyspark.llm.source_mix import op13_source_mix
from tallyspark.llm.token_counts import op1_token_counts
from tallyspark.llm.topk_search import OP3_SQL, op3_topk_search
from tallyspark.llm.vector_codes import OP12_SQL, op12_vector_codes
from tallyspark.llm.warc import OP7_SQL, op7_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_best_fit_packing,
        op3_topk_search,
        op4_byte_bpe,
        op5_ngram_jaccard,
        op6_quality_rules,
        op7_warc,
        op8_neural_lm,
        op9_html_text,
        op10_secret_scans,
        op11_centroid_clustering,
        op12_vector_codes,
        op13_source_mix,
    )
}
SQL = {"op3_topk_search": OP3_SQL, "op6_quality_rules": OP6_SQL, "op7_warc": OP7_SQL, "op11_centroid_clustering": OP11_SQL, "op12_vector_codes": OP12_SQL}
