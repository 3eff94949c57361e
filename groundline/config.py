"""Settings and word lists that decide results."""

from __future__ import annotations

# ---- fixed values: retrieval -------------------------------------------------
CHUNK_SIZE = 1800
CHUNK_OVERLAP = 250
TOP_K = 4
RESEARCH_TOP_K = 5
MAX_EVIDENCE = 6
CANDIDATE_K = 16
VECTOR_WEIGHT = 0.65
BM25_WEIGHT = 0.35
BM25_K1 = 1.5
BM25_B = 0.75
RERANK_BASE, RERANK_LEXICAL, RERANK_COVERAGE, RERANK_PHRASE = 0.55, 0.25, 0.15, 0.05
LEXICAL_COSINE, LEXICAL_KEYWORD = 0.75, 0.25
SELECT_SCORE, SELECT_OVERLAP, SELECT_ENTITY = 0.55, 0.35, 0.10
MAX_QUERIES_PER_TASK = 4
MIN_ANSWER_CHARS = 12
PDF_MAX_BYTES = 20 * 1024 * 1024
SOURCE_FILE_MAX_BYTES = 1_000_000
EMBEDDING_BATCH = 64
EMBEDDING_MAX_CHARS = 12_000
EMBEDDING_MIN_CHARS = 256
QUERY_MAX_CHARS = 20_000
SESSION_MAX_CHARS = 128
SNAPSHOT_KEEP = 5
MAX_DRAFT_REPAIRS = 1

# ---- fixed values: texts -----------------------------------------------------
INSUFFICIENT_ANSWER = "当前证据不足，无法基于现有证据可靠生成最终回答。"
FALLBACK_ANSWER = "无法基于当前证据可靠生成回答"
QUESTION_MARKER = "Current research question:"

# ---- fixed values: word lists ------------------------------------------------
SELECTOR_STOP_WORDS = [
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for",
    "with", "how", "does", "do", "is", "are", "each", "method",
    "agent", "agents", "use", "using", "what", "which", "their",
]
RESULT_TERMS = [
    "benchmark", "performance", "result", "results", "accuracy",
    "success rate", "score", "evaluation", "experiment", "ablation",
]
AUTHOR_MARKERS = ["university", "institute of technology", "@", "abstract"]
PAPER_TERMS = ["论文", "paper"]
REPOSITORY_TERMS = ["github", "repo", "repository", "代码", "实现", "readme"]
COMPARISON_TERMS = ["比较", "区别", "差异", "相比", " vs ", "versus", "difference", "compare", "comparison"]
MULTI_HOP_TERMS = ["哪些", "分别", "为什么以及如何", "综合分析", "multiple methods"]
DOCUMENTATION_TERMS = ["documentation", "docs", "文档"]
MULTI_SOURCE_TERMS = [
    "两篇论文", "多篇论文", "不同论文", "多个来源", "不同来源",
    "multiple papers", "multiple sources", "different papers",
    "different sources", "cross-document",
]
INSUFFICIENCY_DRAFT = ["不足", "无法", "不充分", "insufficient", "cannot reliably"]
INSUFFICIENCY_VALIDATOR = [
    "不足", "无法", "不充分", "无法回答", "无法基于", "insufficient",
    "cannot reliably", "cannot answer", "not enough evidence",
]
GENERIC_TITLES = ["raw", "document", "content", "untitled"]
SOURCE_TYPES = ["paper", "repository", "documentation", "benchmark", "other"]
SOURCE_NAME_KEYWORDS = {
    "repository": ["github", "repository", "repo/", "repo-"],
    "paper": ["arxiv", "paper", ".pdf"],
    "documentation": ["readme", "documentation", "docs", "manual"],
    "benchmark": ["benchmark", "eval", "leaderboard"],
}
SKIP_DIRECTORIES = [
    ".git", ".hg", ".svn", ".tox", ".venv", "venv", "env", "node_modules",
    "build", "dist", "vendor", "vendors", "site-packages", "__pycache__",
    ".mypy_cache", ".pytest_cache", "coverage", "htmlcov",
]
SKIP_SUFFIXES = [".egg-info", ".min.js"]
DOC_SUFFIXES = [".md", ".markdown", ".rst", ".txt"]
UPLOAD_MIME_TYPES = ["application/pdf", "application/octet-stream"]
REASON_TERMS = {
    "invalid_evidence_reference": [
        "unknown evidence", "lacks matching evidence", "invalid evidence",
        "duplicate evidence_id", "comparison draft must cite",
        "does not separately cover entity", "comparison entity",
    ],
    "schema_error": [
        "json", "validation error", "does not contain a json",
        "model_validate", "claim_id values must be unique",
    ],
    "missing_required_field": ["required", "missing", "field required"],
    "placeholder_output": ["placeholder", "tbd", "ellipsis"],
    "too_short": ["too short", "shorter than"],
    "empty_output": ["empty"],
    "generic_fallback": ["fallback"],
}
VALUE_ERROR_SCHEMA_TERMS = ["chinese", "concatenate", "uncited", "insufficiency"]
GROUNDING_RETRY_TERMS = [
    "lacks matching evidence", "comparison draft",
    "unknown evidence ids", "does not separately cover entity",
]
IDENTIFIER_GLOSSARY_ZH = {
    "run": "执行", "execute": "执行", "result": "结果", "output": "输出",
    "add": "加入", "append": "追加", "message": "消息", "messages": "消息",
    "history": "历史", "loop": "循环", "step": "步骤", "action": "动作",
    "actions": "动作", "query": "查询",
}
PUBLIC_EVENTS = [
    "run.started", "task.started", "task.completed", "artifact.created",
    "retrieval.completed", "draft.completed", "verification.completed",
    "run.completed", "run.failed",
]
COMPLETION_EVENTS = {
    "evidence_pool": "retrieval.completed",
    "research_draft": "draft.completed",
    "evidence_verification": "verification.completed",
}
TASK_LABELS = {
    "memory_context": "Memory Context",
    "analysis": "Task Analysis",
    "evidence": "Evidence Retrieval",
    "draft": "Draft Generation",
    "verification": "Evidence Verification",
    "memory_update": "Memory Update",
}
TASK_CHAIN = [
    ("task:research:memory_context", "MemoryAgent", "conversation_context"),
    ("task:research:analysis", "TaskAnalyzer", "research_task"),
    ("task:research:evidence", "ResearchAgent", "evidence_pool"),
    ("task:research:draft", "DraftAgent", "research_draft"),
    ("task:research:verification", "EvidenceVerifier", "evidence_verification"),
    ("task:research:memory_update", "MemoryAgent", "memory_update"),
]
