"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from hingeworks.llm import alignment, langid, mixing, neighbours, pieces, pii, secretscan, simhash, spelling, tokenbin, toxicity, urls, winnow

QUERIES = {f.__name__: f for f in (langid.op1_language_id, pii.op2_pii_surrogates, simhash.op3_simhash_dedup, winnow.op4_winnowing_fingerprints, neighbours.op5_nearest_neighbours, pieces.op6_sentencepiece, mixing.op7_source_mixing, urls.op8_url_filter, toxicity.op9_toxicity, tokenbin.op10_token_id_output, spelling.op11_spelling_variants, alignment.op12_token_alignment, secretscan.op13_secret_scan)}
ORACLES = {"op7_source_mixing": mixing.ORACLE, "op8_url_filter": urls.ORACLE, "op11_spelling_variants": spelling.ORACLE, "op13_secret_scan": secretscan.ORACLE}
