"""Operators of a training-data pipeline. QUERIES and ORACLES list their registered queries."""

from logloom.llm import centroids, fingerprints, language_id, licenses, main_text, mixing, ngram_join, periodic_runs, sentencepiece_codec, sharding, token_counts, token_files, vector_search

QUERIES = {
    "op1_shards": sharding.op1_shards,
    "op2_language_id": language_id.op2_language_id,
    "op3_token_files": token_files.op3_token_files,
    "op4_fingerprints": fingerprints.op4_fingerprints,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_vector_search": vector_search.op8_vector_search,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_sentencepiece": sentencepiece_codec.op10_sentencepiece,
    "op11_centroids": centroids.op11_centroids,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_main_text": main_text.op13_main_text,
}

#: DuckDB SQL for the same rows, where SQL can express them.
ORACLES = {"op5_mix_sources": mixing.ORACLE, "op6_ngram_join": ngram_join.ORACLE, "op11_centroids": centroids.ORACLE, "op13_main_text": main_text.ORACLE}
