"""Schemas of the record types."""

from __future__ import annotations

_INSTANCE = """
    instance_id string, problem_statement string, category string, repo string, base_commit string,
    version string, code_context string, relevant_files array<string>, gold_patch string,
    test_patch string, pass_to_pass_tests array<string>, fail_to_pass_tests array<string>,
    difficulty string, tags array<string>, created_at string, source string, source_url string,
    hints array<string>, notes string
"""
INSTANCE = " ".join(_INSTANCE.split())

GRADING_INSTANCE = (
    "instance_id string, repo string, base_commit string, patch string, test_patch string, "
    "problem_statement string, hints_text string, created_at string, FAIL_TO_PASS array<string>, "
    "PASS_TO_PASS array<string>, version string, environment_setup_commit string, component string, "
    "difficulty string, related_issues array<string>, related_prs array<string>"
)

PREDICTION = (
    "instance_id string, model_name_or_path string, model_patch string, patch string, "
    "full_output string, run_id string"
)

INFERENCE_RESULT = (
    "instance_id string, model string, raw_response string, extracted_patch string, "
    "input_tokens bigint, output_tokens bigint, cost_usd double, latency_seconds double, "
    "timestamp string, success boolean, error string, "
    "metadata struct<temperature: double, max_tokens: int, prompt_style: string>"
)

TASK = (
    "id bigint, title string, category string, area string, difficulty string, description string, "
    "reproduction string, expected_behavior string, test_file string, files_to_modify array<string>, "
    "hints array<string>, tags array<string>, related_issues array<string>, runtime_version string"
)

REPORT_SUMMARY = (
    "total bigint, resolved bigint, unresolved bigint, errors bigint, skipped bigint, "
    "resolved_rate double, avg_duration double, total_duration double"
)
REPORT_INSTANCE = (
    "instance_id string, status string, patch_applied boolean, tests_passed bigint, "
    "tests_failed bigint, tests_skipped bigint, tests_total bigint, duration double, "
    "error_message string, test_output string"
)
REPORT_METADATA = "timestamp string, config map<string, string>"
REPORT = (
    f"summary struct<{REPORT_SUMMARY}>, metadata struct<{REPORT_METADATA}>, "
    f"instances array<struct<{REPORT_INSTANCE}>>"
)
