"""Table and file schemas."""

from __future__ import annotations

CASES = "id string, category string, log string, expected_root_cause string, expected_keywords array<string>"

RESULTS_CSV = (
    "case_id string, category string, mode string, strategy string, predicted_cause string, "
    "expected_cause string, is_correct boolean, confidence double, latency_ms bigint, "
    "knowledge_used int, tokens_used int"
)

KNOWLEDGE = (
    "id bigint, title string, content string, category string, keywords string, symptoms string, "
    "embedding array<float>, created_at timestamp, updated_at timestamp"
)

HISTORY = (
    "id bigint, session_id string, log_hash string, log_snippet string, retrieved_doc_ids string, "
    "diagnosis_result struct<root_cause:string,analysis_process:string,solution_steps:array<string>,"
    "confidence:double>, model_used string, prompt_strategy string, total_tokens bigint, "
    "latency_ms bigint, created_at timestamp"
)

FEEDBACK = "id bigint, session_id string, feedback smallint, user_comment string, created_at timestamp"

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
