"""Queries of the library and their SQL oracles."""

from __future__ import annotations

from dataclasses import replace

from findwell.plans import queries as q
from findwell.plans.oracles import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]

_NAMED = """tokenize_documents tokenize_pages page_segments meta_segments stem_vocab doc_lengths corpus_size index_meta
postings postings_json vocab_df vocab_stats vocab_ceiling doc_successor term_postings duplicate_groups alias_map alias_conflicts
dedup_postings df_after_dedup url_depth tag_scores idf tfidf query_prepare candidate_difference phrase_runs ngram_boost bigram_boost
search_full_pages result_page_2 result_page_label result_count index_merge index_merge_distinct index_stored index_order index_search corpus_read batch_search skip_sample""".split()

QUERIES = {name: getattr(q, name) for name in _NAMED} | {
    "search_single": q._one("single", "or"),
    "search_or": q._one("or", "or"),
    "search_and2": q._one("and2", "and"),
    "search_and3": q._one("and3", "and"),
    "search_and_missing_term": q._one("missing", "and"),
    "search_all_stopwords": q._one("stop", "and"),
    "max_postings_or": q._one("or", "or", replace(q.CONFIG, most_postings=20)),
    "ngram_boost_compat": q._one("and3", "and", replace(q.CONFIG, compat_labels=True)),
}
