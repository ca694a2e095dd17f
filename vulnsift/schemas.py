"""Engine schemas and the fixed values the results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

VULN_FIELDS = (
    "type", "name", "swc_id", "cwe_id", "lines", "line_range",
    "severity", "explanation", "description", "remediation",
)
VULNERABILITY = T.StructType([T.StructField(f, T.StringType(), True) for f in VULN_FIELDS])




# ---------------------------------------------------------------------------
# FIXED VALUES — these must equal the reference's for results to match.
# ---------------------------------------------------------------------------


NO_VULNERABILITY_OUTPUT = (
    "Vulnerability: None\n"
    "Explanation: No vulnerabilities detected in this contract. "
    "The code follows security best practices."
)

SYSTEM_PROMPT = (
    "You are a smart contract security auditor. Analyze Solidity code for vulnerabilities.\n"
    "For each vulnerability found, provide:\n"
    "- Vulnerability type and SWC/CWE identifiers\n"
    "- Affected line numbers\n"
    "- Severity level (Critical/High/Medium/Low/Informational)\n"
    "- Detailed explanation of the vulnerability\n"
    "- Recommended remediation steps"
)

INSTRUCTION = "Analyze the following Solidity smart contract for security vulnerabilities."

# Defaults used when a vulnerability field is absent (SFT record).
SFT_DEFAULTS = {
    "vuln_type": "Unknown",
    "cwe_id": "CWE-Unknown",
    "swc_id": "SWC-Unknown",
    "lines": "Unknown",
    "severity": "Medium",
    "explanation": "Vulnerability detected.",
    "remediation": "Review and fix the vulnerable code pattern.",
}

# The fixed false finding paired with clean contracts in the DPO set.
DPO_FALSE_FINDING = {
    "type": "Reentrancy",
    "swc_id": "SWC-107",
    "cwe_id": "CWE-841",
    "severity": "High",
    "lines": "1-10",
    "explanation": "False positive - no actual vulnerability.",
    "remediation": "No action needed.",
}

# Reasoning-trace generation prompt; {contract_code} and {ground_truth} are filled in.
TRACE_PROMPT = (
    "Analyze this Solidity contract for vulnerabilities. Think through your analysis step by step:\n"
    "\n"
    "1. First, identify the contract's purpose and key functions\n"
    "2. Trace the flow of funds and state changes\n"
    "3. Check for common vulnerability patterns (reentrancy, overflow, access control, etc.)\n"
    "4. For each potential issue, explain WHY it's a vulnerability\n"
    "5. Provide specific line numbers and evidence\n"
    "\n"
    "Contract:\n"
    "{contract_code}\n"
    "\n"
    "Known vulnerability (if any): {ground_truth}\n"
    "\n"
    "Output your analysis in this format:\n"
    "<think>\n"
    "[Your detailed reasoning process - be thorough, explain your logic]\n"
    "</think>\n"
    "\n"
    "Vulnerability: [Type]\n"
    "SWC: [ID]\n"
    "Lines: [X-Y]\n"
    "Severity: [High/Medium/Low]\n"
    "Explanation: [Concise summary]\n"
    "Remediation: [Fix suggestion]"
)

# RL-ZERO zero-shot prompt; {contract_code} is filled in.
RL_ZERO_PROMPT = (
    "Analyze the following Solidity smart contract for security vulnerabilities.\n"
    "Identify any issues and provide:\n"
    "- Vulnerability type\n"
    "- SWC ID\n"
    "- Affected lines\n"
    "- Severity (High/Medium/Low)\n"
    "- Explanation\n"
    "- Remediation\n"
    "\n"
    "Contract:\n"
    "{contract_code}\n"
    "\n"
    "Analysis:"
)

# Directory type -> class, exact lower-case key (loader). Default SWC-000.
TYPE_TO_SWC_EXACT = [
    ("reentrancy", "SWC-107"),
    ("integer_overflow", "SWC-101"),
    ("integer_underflow", "SWC-101"),
    ("access_control", "SWC-115"),
    ("unchecked_call", "SWC-104"),
    ("unchecked_low_level_calls", "SWC-104"),
    ("front_running", "SWC-114"),
    ("time_manipulation", "SWC-116"),
    ("bad_randomness", "SWC-120"),
    ("denial_of_service", "SWC-128"),
    ("short_addresses", "SWC-129"),
    ("tx_origin", "SWC-115"),
]

# Type text -> class, first key (in this order) contained in the lower-cased text
# (evaluator). Default SWC-000.
TYPE_TO_SWC_SUBSTRING = [
    ("reentrancy", "SWC-107"),
    ("reentrant", "SWC-107"),
    ("integer overflow", "SWC-101"),
    ("integer underflow", "SWC-101"),
    ("overflow", "SWC-101"),
    ("underflow", "SWC-101"),
    ("access control", "SWC-115"),
    ("authorization", "SWC-115"),
    ("unchecked", "SWC-104"),
    ("call", "SWC-104"),
    ("front-running", "SWC-114"),
    ("frontrunning", "SWC-114"),
    ("front running", "SWC-114"),
    ("timestamp", "SWC-116"),
    ("block.timestamp", "SWC-116"),
    ("randomness", "SWC-120"),
    ("random", "SWC-120"),
    ("denial", "SWC-128"),
    ("dos", "SWC-128"),
    ("tx.origin", "SWC-115"),
]

UNKNOWN_SWC = "SWC-000"

# Weakness of each class, and the weaknesses above it (public class registry and weakness hierarchy).
CLASS_PARENTS = [
    ("SWC-101", "CWE-190"), ("SWC-104", "CWE-252"), ("SWC-107", "CWE-841"), ("SWC-114", "CWE-362"), ("SWC-115", "CWE-284"),
    ("SWC-116", "CWE-829"), ("SWC-120", "CWE-330"), ("SWC-128", "CWE-400"), ("SWC-129", "CWE-480"),
    ("CWE-190", "CWE-682"), ("CWE-252", "CWE-754"), ("CWE-754", "CWE-703"), ("CWE-841", "CWE-691"), ("CWE-362", "CWE-691"),
    ("CWE-829", "CWE-669"), ("CWE-669", "CWE-664"), ("CWE-400", "CWE-664"), ("CWE-330", "CWE-693"), ("CWE-480", "CWE-670"),
    ("CWE-670", "CWE-691"),
]

# Primary classes: (class, name, cwe, target_f1).
PRIMARY_CLASSES = [
    ("SWC-107", "Reentrancy", "CWE-841", 0.80),
    ("SWC-101", "Integer Overflow/Underflow", "CWE-190", 0.75),
    ("SWC-115", "Access Control", "CWE-284", 0.60),
    ("SWC-104", "Unchecked External Calls", "CWE-252", 0.70),
    ("SWC-114", "Front-Running", "CWE-362", 0.65),
]

# Evaluation targets: (metric, target, higher_better).
EVAL_TARGETS = [
    ("precision", 0.35, True),
    ("recall", 0.70, True),
    ("f1", 0.45, True),
    ("false_positive_rate", 0.65, False),
]

# Milestone gates: (checkpoint, model, min_f1).
MILESTONES = [
    ("day_25", "360M", 0.20),
    ("day_40", "1.5B", 0.35),
    ("day_55", "3B", 0.45),
]

# Data mixture ratios: (mix, component, ratio).
MIXTURE = [
    ("cpt", "general_code", 0.50),
    ("cpt", "solidity_code", 0.30),
    ("cpt", "audit_reports", 0.10),
    ("cpt", "math_reasoning", 0.10),
    ("sft", "labeled_vulns", 0.40),
    ("sft", "synthetic_vulns", 0.25),
    ("sft", "clean_contracts", 0.20),
    ("sft", "general_instructions", 0.10),
    ("sft", "security_docs", 0.05),
]

# Sweep values.
LEARNING_RATES = [1e-5, 5e-5, 1e-4, 5e-4]
SIZE_SWEEP = [50_000, 100_000, 150_000, 200_000]

# Thresholds and defaults.
PASS_RATE_THRESHOLD = 0.625
MAX_WORD_GAP = 100
CHARS_PER_TOKEN = 4
TRAIN_SPLIT = 0.9
SFT_VULN_RATIO = 0.40
SFT_CLEAN_RATIO = 0.20
DPO_CLEAN_SHARE = 0.3
REWARD_WEIGHTS = (0.5, 0.3, 0.2)  # class, line, format
TOOL_WEIGHT = 0.2
FORMAT_FIELD_PATTERNS = [
    r"Vulnerability[:\s]",
    r"SWC[:\s]",
    r"Lines?[:\s]",
    r"Severity[:\s]",
    r"Explanation[:\s]",
]
STAGE_PRIORITY = ["rlvr", "dpo", "sft"]
CHAT_MARKERS = {"system": "<|system|>", "user": "<|user|>", "assistant": "<|assistant|>"}

# Named data mixes of the sweep, and the second ablation grid (token counts in tokens).
DATA_MIXES = [
    ("balanced", "labeled_vulns", 0.40), ("balanced", "synthetic_vulns", 0.25), ("balanced", "clean_contracts", 0.20),
    ("balanced", "general_code", 0.10), ("balanced", "security_docs", 0.05),
    ("vuln_heavy", "labeled_vulns", 0.50), ("vuln_heavy", "synthetic_vulns", 0.30), ("vuln_heavy", "clean_contracts", 0.10),
    ("vuln_heavy", "general_code", 0.05), ("vuln_heavy", "security_docs", 0.05),
    ("clean_heavy", "labeled_vulns", 0.30), ("clean_heavy", "synthetic_vulns", 0.20), ("clean_heavy", "clean_contracts", 0.35),
    ("clean_heavy", "general_code", 0.10), ("clean_heavy", "security_docs", 0.05),
]
GRID_MODEL_SIZES = ["135M", "360M", "500M", "1.5B"]
GRID_TOKEN_COUNTS = [("500M", 5e8), ("2B", 2e9), ("10B", 1e10)]
GRID_LORA_RANKS = [8, 16, 32, 64]
