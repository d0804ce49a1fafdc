"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from callmetrics.llm import q_bpe, q_chat, q_html, q_jaccard, q_lines, q_mix, q_packing, q_quality, q_repair, q_toxic, q_trie, q_vectors, q_warc

QUERIES = {"op3_embedding_dedup": q_vectors.op3_embedding_dedup, "op6_line_dedup": q_lines.op6_line_dedup, "op7_ngram_jaccard": q_jaccard.op7_ngram_jaccard, "op2_warc": q_warc.op2_warc, "op10_toxicity": q_toxic.op10_toxicity, "op9_html_text": q_html.op9_html_text, "op5_quality_rules": q_quality.op5_quality_rules, "op1_mix_sources": q_mix.op1_mix_sources, "op4_bpe": q_bpe.op4_bpe, "op8_chat_format": q_chat.op8_chat_format, "op11_prefix_trie": q_trie.op11_prefix_trie, "op12_structure_repair": q_repair.op12_structure_repair, "op13_packing": q_packing.op13_packing}
SQL = {**q_vectors.SQL, **q_jaccard.SQL, **q_lines.SQL, **q_warc.SQL, **q_quality.SQL, **q_mix.SQL, **q_bpe.SQL, **q_chat.SQL, **q_trie.SQL, **q_repair.SQL}
