"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pagemill.llm.bpe import op9_byte_bpe
from pagemill.llm.decontam import OP10_SQL, op10_benchmark_decontamination
from pagemill.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from pagemill.llm.langid import op6_language_id
from pagemill.llm.licenses import op7_license_scan
from pagemill.llm.merkle import OP11_SQL, op11_merkle_manifest
from pagemill.llm.pii import op2_pii
from pagemill.llm.prefix_trie import OP13_SQL, op13_conversation_trie
from pagemill.llm.simhash import op3_simhash_near_dedup
from pagemill.llm.substring_dedup import OP12_SQL, op12_substring_dedup
from pagemill.llm.token_counts import op1_token_counts
from pagemill.llm.toxicity import op8_toxicity
from pagemill.llm.warc import OP4_SQL, op4_warc

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_pii": op2_pii,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_warc": op4_warc,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_language_id": op6_language_id,
    "op7_license_scan": op7_license_scan,
    "op8_toxicity": op8_toxicity,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLE = {
    "op4_warc": OP4_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op10_benchmark_decontamination": OP10_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_substring_dedup": OP12_SQL,
    "op13_conversation_trie": OP13_SQL,
}
