"""Fixed values of incident reports: threat classes, cost factors, templates."""

from __future__ import annotations

# Anomaly type to (class id, class name).
THREAT_CLASSES = {
    "DOC_SIZE_SPIKE": ("LLM04", "Model Denial of Service"),
    "SCHEMA_DRIFT": ("LLM05", "Supply Chain Vulnerabilities"),
    "SEMANTIC_VELOCITY_SPIKE": ("LLM03", "Training Data Poisoning"),
    "AI_MEMORY_POISONING": ("LLM01", "Prompt Injection"),
    "ETL_MISCONFIGURATION": ("LLM03", "Training Data Poisoning"),
    "LLM_FLOOD": ("LLM04", "Model Denial of Service"),
    "DATA_POISONING": ("LLM03", "Training Data Poisoning"),
    "CLUSTER_WIDE_EVENT": ("LLM05", "Supply Chain Vulnerabilities"),
    "UNKNOWN": ("LLM05", "Supply Chain Vulnerabilities"),
}

# Cost factor per anomaly type and per collection, default 1.0.
TYPE_MULTIPLIER = {
    "SEMANTIC_VELOCITY_SPIKE": 2.5,
    "SCHEMA_DRIFT": 2.0,
    "DOC_SIZE_SPIKE": 1.5,
    "HIGH_WRITE_RATE": 1.2,
    "HIGH_DELETE_RATE": 1.3,
    "UNKNOWN": 1.0,
}
COLLECTION_TIER = {
    "orders": 3.0,
    "transactions": 3.0,
    "payments": 3.0,
    "sales": 2.5,
    "users": 2.0,
    "movies": 1.5,
    "comments": 1.2,
    "sessions": 1.0,
}

# Cost model.
HOURLY_RATE = 150.0
TRIAGE_HOURS = 3.4
COST_PER_QPS_MINUTE = 0.15
ROWS_PER_QPS = 10_000
MIN_QPS = 0.1
Z_CAP = 300.0
Z_PER_DEGRADATION = 50.0
TRIAGE_MINUTES = 11
DEFAULT_ROWS = 10_000

# Evidence weights.
WEIGHTS = [0.35, 0.30, 0.20, 0.15]

# Root cause per anomaly type.
ROOT_CAUSE = {
    "AI_MEMORY_POISONING": (
        "Prompt-injection content was written into the collection — poisoning the "
        "memory layer that downstream AI agents read (OWASP LLM01)."
    ),
    "SEMANTIC_VELOCITY_SPIKE": (
        "The collection's semantic centroid drifted sharply this hour: documents no "
        "longer match the historical meaning, consistent with data-source contamination "
        "or training-data poisoning (OWASP LLM03)."
    ),
    "SCHEMA_DRIFT": (
        "The live schema diverged from the stored baseline (new/changed fields), "
        "consistent with an upstream writer change or supply-chain drift (OWASP LLM05)."
    ),
    "DOC_SIZE_SPIKE": (
        "A document's size is far above the collection baseline, consistent with "
        "injected payloads or write amplification (OWASP LLM04)."
    ),
    "ETL_MISCONFIGURATION": "Ingestion pipeline wrote semantically alien content into the collection.",
}
SECURITY_TYPES = ["AI_MEMORY_POISONING", "SEMANTIC_VELOCITY_SPIKE"]
PIPELINE_TYPES = ["SCHEMA_DRIFT", "ETL_MISCONFIGURATION"]

# Remediation options per anomaly type, in rank order:
# (title, description, minutes, action, needs approval).
REMEDIATION = {
    "AI_MEMORY_POISONING": [
        (
            "Quarantine the poisoned document",
            "Move the flagged document to a quarantine collection and remove it "
            "from the agent-readable path. Alert the security team.",
            5, "delete-many", True,
        ),
        (
            "Audit recent writes from the same source",
            "Scan the last hour of writes for the same injection signature.",
            15, "find", False,
        ),
        (
            "Add a write-time injection filter",
            "Reject documents matching OWASP LLM01 patterns at ingestion.",
            30, "application-fix", False,
        ),
    ],
    "SEMANTIC_VELOCITY_SPIKE": [
        (
            "Isolate the drifted documents",
            "Freeze the affected collection from agent retrieval until reviewed.",
            10, "application-fix", True,
        ),
        ("Review the ingestion source", "Inspect what wrote the divergent content this hour.", 20, "find", False),
        (
            "Re-embed with a pinned model version",
            "Pin the embedding model to rule out model-mismatch drift.",
            30, "application-fix", False,
        ),
    ],
    "SCHEMA_DRIFT": [
        ("Validate the new schema", "Confirm the added/changed fields are intentional.", 10, "collection-schema", False),
        ("Add a schema-validation rule", "Enforce the expected shape at write time.", 20, "application-fix", True),
    ],
    "DOC_SIZE_SPIKE": [
        (
            "Investigate the oversized document",
            "Inspect the flagged document for injected or corrupt payloads.",
            10, "find", False,
        ),
        ("Add a document-size guard", "Reject writes above a size threshold at ingestion.", 20, "application-fix", True),
    ],
}
DEFAULT_REMEDIATION = [
    ("Investigate the flagged document", "Manually review the anomaly and confirm root cause.", 15, "find", False),
]

# Tools that change data and need an approval first.
DESTRUCTIVE_TOOLS = [
    "create_index", "drop_index", "delete_documents",
    "create-index", "drop-index", "delete-many",
    "drop-collection", "drop-database", "update-many", "insert-many",
]
