"""Every query by name, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_COVERS: dict[str, list[str]] = {}

#: The survey's operators that queries apply which do not say so themselves.
EARLIER = {
    "agreement": "JOIN-1 AGG-16",
    "article_chunk": "CHK-8 CHK-10",
    "article_evidence": "W-12",
    "bm25": "STR-26 LEX-1",
    "bm25_unseen": "TOP-3",
    "by_id_list": "FLT-14",
    "case_lists": "STR-13",
    "case_number_parse": "STR-11 STR-12",
    "classifier_summary": "AGG-13",
    "compact_text": "STR-4 STR-10",
    "component_parents": "JOIN-18",
    "concept_coverage": "LEX-2",
    "confusion_coverage": "AGG-14",
    "contained_terms": "STR-18",
    "context_window": "STR-20",
    "control_sample": "SMP-3",
    "corpus_hash": "AGG-23",
    "decision_date": "STR-15 STR-16",
    "dedupe_by_number": "W-9",
    "definition_status": "AGG-8",
    "describe_lengths": "AGG-34",
    "dup_text_groups": "AGG-22",
    "duplicate_keys": "V-1",
    "evenly_spaced": "SMP-6 SMP-7",
    "failure_bands": "JOIN-5 W-16 MET-8",
    "favourite_dedupe": "STM-3",
    "first_of_each": "TOP-4",
    "first_section": "CHK-1",
    "full_outer_integrate": "JOIN-3",
    "generation_state": "STM-2",
    "greedy_batches": "SET-8",
    "greedy_pack": "CHK-2 CHK-3 CHK-4",
    "grouped_search": "W-1 TOP-2 VEC-2",
    "hash_sample": "SMP-1",
    "heading_path": "CHK-12",
    "inclusion_cascade": "FLT-2 V-12",
    "ir_metrics_macro": "AGG-9 MET-5",
    "ir_metrics_multi_k": "AGG-10 MET-3",
    "ir_metrics_query": "SET-10 MET-1 MET-2",
    "keyword_counts": "AGG-33",
    "keyword_diagnosis": "MAT-9",
    "knn_topk": "W-6 TOP-1 VEC-1",
    "label_override": "JOIN-8 JOIN-9 JOIN-10",
    "label_precedence": "JOIN-7",
    "label_readiness": "AGG-26",
    "labels_and_ids": "STR-24 STR-32",
    "latency_percentiles": "AGG-19",
    "latest_error_keys": "FLT-13",
    "length_summary_nearest": "AGG-18",
    "length_summary_round": "AGG-17",
    "link_checks": "SET-4 V-2 V-4",
    "longest_spans": "MAT-2",
    "markup_normalise": "STR-2 STR-3",
    "match_keys": "STR-5 STR-6 STR-8",
    "merge_hits": "AGG-3 AGG-4 AGG-5",
    "merge_intervals": "STR-22",
    "metric_delta": "JOIN-19",
    "model_order": "W-15 MET-7",
    "multi_model_pool": "W-4 W-5 SET-1",
    "multi_sense_sample": "SMP-9",
    "multiset_diff": "AGG-21 SET-3",
    "nested_filter": "FLT-8",
    "newest_first": "TOP-6",
    "noise_filter": "FLT-6 FLT-7",
    "null_profile": "AGG-28",
    "numeric_suffix_order": "TOP-5",
    "overlapping_occurrences": "MAT-6",
    "parent_collapse": "JOIN-4 W-2 VEC-3",
    "prefix_parent": "JOIN-14",
    "priority_union": "JOIN-15",
    "ranking_completeness": "V-6",
    "relevance_score": "V-17",
    "rerank_metrics": "AGG-11 MET-4",
    "response_state": "V-22",
    "review_package": "V-7",
    "review_targets": "FLT-11 SMP-2",
    "round_robin": "SMP-4",
    "round_trip_pivot": "AGG-31",
    "run_aggregate": "AGG-29",
    "sense_ranking": "W-10",
    "session_ttl": "STM-1",
    "span_align": "MAT-4",
    "status_cascade": "MAT-11 MAT-12 MAT-13",
    "substring_join": "JOIN-13 MAT-1",
    "summary_warnings": "V-18",
    "term_excerpt": "STR-19",
    "term_stats": "AGG-2 W-11",
    "text_normalise": "STR-1",
    "tiered_cost": "AGG-35",
    "truncate_flag": "STR-21",
    "turn_lines": "STR-9",
    "turn_preview": "PRJ-5",
    "unbalanced_delimiters": "STR-35",
    "unique_rows": "SET-2",
    "unprocessed_anti": "JOIN-12",
    "url_clean": "STR-27 STR-28 STR-29",
    "variant_winners": "AGG-12",
    "verdict_normalise": "V-9",
    "vote_merge": "JOIN-2 MET-9",
    "windowed_excerpt": "STR-23",
    "yearly_counts": "AGG-32",
}


def query(sql: str | None = None, covers: str = ""):
    """Register a query under its function's name, with the survey's operators that it applies."""

    def add(f):
        _QUERIES[f.__name__] = f
        _COVERS[f.__name__] = (covers or EARLIER.get(f.__name__, "")).split()
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL


def covered() -> dict[str, list[str]]:
    """Of each of the survey's operators the queries that apply it."""
    out: dict[str, list[str]] = {}
    for name, ids in _COVERS.items():
        for i in ids:
            out.setdefault(i, []).append(name)
    return out


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["ir_metrics_query"](spark, sf_dir)


def _load() -> None:
    from quern.plans import chunking, decisions, files, labels, matching, rankings, readiness, records, relevance, retrieval, review, sampling, statutes, stats, structure, summaries, targets, terms, text, trials  # noqa: F401


_load()
