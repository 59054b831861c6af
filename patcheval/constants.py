"""Fixed values.

The tables, word lists and patterns in this module are fixed values: results only
agree with other tools for the same data when these are exactly as stated.
"""

# --- status vocabularies (fixed values) --------------------------------------------------
PASSED, FAILED, SKIPPED, ERROR = "passed", "failed", "skipped", "error"
FULL, PARTIAL, NO = "full", "partial", "no"
EVALUATION_STATUSES = ("pending", "running", "resolved", "unresolved", "error", "skipped")
STATUS_RANK = {"resolved": 3, "unresolved": 2, "error": 1, "skipped": 0}
STATUS_MARKER = {
    "resolved": "[PASS]",
    "unresolved": "[FAIL]",
    "error": "[ERR ]",
    "skipped": "[SKIP]",
}
UNKNOWN_MARKER = "[????]"

CATEGORIES = ("bug_fix", "feature", "performance", "refactor", "security", "documentation", "test")
DIFFICULTIES = ("easy", "medium", "hard", "expert")

# --- dataset validation (fixed values) ---------------------------------------------------
REQUIRED_FIELDS = ("instance_id", "problem_statement", "category")
EVALUATION_FIELDS = ("gold_patch", "fail_to_pass_tests")
LIST_FIELDS = ("relevant_files", "pass_to_pass_tests", "fail_to_pass_tests", "tags", "hints")
GRADING_FIELDS = (
    "instance_id",
    "repo",
    "base_commit",
    "problem_statement",
    "FAIL_TO_PASS",
    "PASS_TO_PASS",
)
TASK_REQUIRED = (
    "id",
    "title",
    "category",
    "area",
    "difficulty",
    "description",
    "expected_behavior",
    "test_file",
)
TASK_AREAS = (
    "core_api", "fetch", "websocket", "sqlite", "postgresql", "mysql",
    "build", "test", "pm", "ffi", "shell",
)
TASK_CATEGORIES = ("bug_fix", "feature")
TASK_DIFFICULTIES = ("easy", "medium", "hard")
TASK_TITLE_MAX = 80

# --- test-log glyphs (fixed values) ------------------------------------------------------
PASS_GLYPHS = "✓✔"
FAIL_GLYPHS = "✗✘×"
SKIP_GLYPHS = "○◯"

# --- messages and markers (fixed values) -------------------------------------------------
TRUNCATION_MARK = "\n... [truncated] ...\n"
NO_PREDICTION = "No prediction provided"
NO_PREDICTION_FOR_INSTANCE = "No prediction found for this instance"
TEST_NOT_FOUND = "Test not found in output"
NOT_FOUND = "NOT_FOUND"
NO_CONTEXT = "No additional context provided."
EMPTY_OUTPUT = "Empty output received"

# --- model prices, USD per 1000 tokens, looked up in this order (fixed values) -----------
PRICES = (
    ("gpt-4", 0.03, 0.06),
    ("gpt-4-turbo", 0.01, 0.03),
    ("gpt-4-turbo-preview", 0.01, 0.03),
    ("gpt-4o", 0.005, 0.015),
    ("gpt-4o-mini", 0.00015, 0.0006),
    ("gpt-3.5-turbo", 0.0005, 0.0015),
    ("claude-3-opus", 0.015, 0.075),
    ("claude-3-sonnet", 0.003, 0.015),
    ("claude-3-haiku", 0.00025, 0.00125),
    ("claude-3-5-sonnet", 0.003, 0.015),
    ("claude-opus-4-5-20251101", 0.015, 0.075),
)
DEFAULT_PRICE = (0.01, 0.03)

# --- runtime version by release prefix or month (fixed values) ---------------------------
RUNTIME_VERSIONS = {
    "1.0": "1.0.0",
    "1.1": "1.1.0",
    "1.2": "1.2.0",
    "2023-09": "1.0.0",
    "2023-10": "1.0.7",
    "2023-11": "1.0.14",
    "2023-12": "1.0.18",
    "2026-01": "1.0.25",
    "2026-02": "1.0.29",
    "2026-03": "1.0.35",
    "2026-04": "1.1.0",
    "2026-05": "1.1.7",
    "2026-06": "1.1.12",
    "2026-07": "1.1.17",
    "2026-08": "1.1.21",
    "2026-09": "1.1.26",
    "2026-10": "1.1.30",
    "2026-11": "1.1.34",
    "2026-12": "1.1.38",
    "2025-01": "1.2.0",
    "latest": "latest",
}
DEFAULT_RUNTIME_VERSION = "1.1.0"

# --- component keywords (fixed values) ---------------------------------------------------
COMPONENT_KEYWORDS = {
    "runtime": ("runtime", "jsc", "javascript", "execution"),
    "bundler": ("bundler", "bundle", "esbuild", "build"),
    "transpiler": ("transpile", "transform", "compile", "typescript"),
    "test_runner": ("test", "jest", "expect", "describe", "it"),
    "package_manager": ("install", "npm", "package", "registry", "lockfile"),
    "http_server": ("serve", "http", "server", "request", "response"),
    "websocket": ("websocket", "ws", "socket"),
    "file_system": ("file", "fs", "read", "write", "directory"),
    "shell": ("shell", "spawn", "exec", "process", "$"),
    "ffi": ("ffi", "native", "c", "dlopen"),
    "sqlite": ("sqlite", "database", "sql", "db"),
    "node_compat": ("node:", "require", "commonjs", "module"),
    "web_apis": ("fetch", "blob", "stream", "url", "formdata"),
    "cli": ("cli", "command", "args", "argv"),
    "plugin": ("plugin", "loader", "hook"),
}
OTHER_COMPONENT = "other"

# --- test-file globs (fixed values) ------------------------------------------------------
TEST_FILE_GLOBS = (
    "*.test.ts",
    "*.test.js",
    "*.spec.ts",
    "*.spec.js",
    "test/*.ts",
    "test/*.js",
    "tests/*.ts",
    "tests/*.js",
    "__tests__/*.ts",
    "__tests__/*.js",
)
