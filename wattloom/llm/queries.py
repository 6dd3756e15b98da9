"""Registered queries of the text operators and their SQL."""

from __future__ import annotations

from wattloom.llm.embedding_dedup import op3_embedding_dedup
from wattloom.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from wattloom.llm.langid import op2_language_id
from wattloom.llm.license_scan import op13_license_scan
from wattloom.llm.line_dedup import op5_line_dedup
from wattloom.llm.minhash import op1_minhash_dedup
from wattloom.llm.mixing import op7_mix_sources
from wattloom.llm.quality import op8_quality
from wattloom.llm.sentencepiece_sampling import op4_sentencepiece_sampling
from wattloom.llm.spelling import op12_spelling_variants
from wattloom.llm.toxicity import op10_toxicity
from wattloom.llm.url_filter import OP9_SQL, op9_url_filter
from wattloom.llm.whitening import op11_whiten_embeddings

QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_dedup,
        op2_language_id,
        op3_embedding_dedup,
        op4_sentencepiece_sampling,
        op5_line_dedup,
        op6_exact_dedup,
        op7_mix_sources,
        op8_quality,
        op9_url_filter,
        op10_toxicity,
        op11_whiten_embeddings,
        op12_spelling_variants,
        op13_license_scan,
    )
}
#: The others are beyond SQL; tests hold them against brute force.
SQL = {"op6_exact_dedup": OP6_SQL, "op9_url_filter": OP9_SQL}
