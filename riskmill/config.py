"""Values that results depend on. Everything here is data, not logic."""

# --- fixed values: names -------------------------------------------------------------------

DUPLICATE_PAYMENT = "DUPLICATE_PAYMENT"
WEBHOOK_INTEGRITY = "WEBHOOK_INTEGRITY"
AMOUNT_CURRENCY = "AMOUNT_CURRENCY"
SUSPICIOUS_CONTENT = "SUSPICIOUS_CONTENT"

EVAL_CLASSES = [DUPLICATE_PAYMENT, WEBHOOK_INTEGRITY, AMOUNT_CURRENCY]
SEVERITY_ORDER = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
UNIT_KINDS = ["CHARGE", "WEBHOOK", "REFUND", "CAPTURE", "OTHER"]
FINDING_STATES = [
    "ADVISORY",
    "QUEUED_FOR_VERIFICATION",
    "VERIFIED",
    "UNVERIFIED",
    "EXCEPTION",
    "DISMISSED",
]
VERIFICATION_STATES = [
    "PENDING",
    "RUNNING",
    "VERIFIED",
    "NOT_REPRODUCED",
    "INCONCLUSIVE",
    "BLOCKED",
    "ERROR",
]
SCAN_TERMINAL_STATES = ["DONE", "FAILED"]

# --- fixed values: source corpus -----------------------------------------------------------

PY_SUFFIXES = ["py"]
JS_SUFFIXES = ["js", "ts", "mjs", "cjs"]
SKIPPED_DIRS = [
    "node_modules",
    ".git",
    "__pycache__",
    ".next",
    "dist",
    "build",
    ".venv",
    "venv",
]
PROVIDER = "razorpay"

# --- fixed values: per class defaults ------------------------------------------------------

CLASS_SEVERITY = {
    WEBHOOK_INTEGRITY: "CRITICAL",
    DUPLICATE_PAYMENT: "HIGH",
    AMOUNT_CURRENCY: "HIGH",
    SUSPICIOUS_CONTENT: "MEDIUM",
}
DEFAULT_SEVERITY = "MEDIUM"

CLASS_EXPOSURE_PAISE = {
    DUPLICATE_PAYMENT: 15000,
    WEBHOOK_INTEGRITY: 50000,
    AMOUNT_CURRENCY: 9900,
}
DEFAULT_EXPOSURE_PAISE = 10000

CLASS_DEFAULT_SCENARIO = {
    DUPLICATE_PAYMENT: "DP-1",
    WEBHOOK_INTEGRITY: "WI-1",
    AMOUNT_CURRENCY: "AC-1",
}
CLASS_VERIFY_SCENARIO = {
    DUPLICATE_PAYMENT: "DP-2",
    WEBHOOK_INTEGRITY: "WI-1",
    AMOUNT_CURRENCY: "AC-1",
}

DECISION_THRESHOLDS = {
    DUPLICATE_PAYMENT: 0.45,
    WEBHOOK_INTEGRITY: 0.45,
    AMOUNT_CURRENCY: 0.45,
}
DEFAULT_THRESHOLD = 0.45
ADVISORY_THRESHOLD = 0.30
VERIFY_THRESHOLD = 0.60

# --- fixed values: scoring -----------------------------------------------------------------

SCORER_VERSION = "heuristic-v1"
SCORING_WEIGHTS = {
    "static_hit": 0.55,
    "static_max_confidence": 0.20,
    "static_n_rules_bonus": 0.05,
    "llm_hit": 0.25,
    "llm_max_confidence": 0.15,
    "llm_n_findings_bonus": 0.03,
    "llm_evidence_lines_bonus": 0.05,
    "both_agree_bonus": 0.15,
}
MAX_EXTRA_RULES = 2
MAX_EXTRA_FINDINGS = 3
EVIDENCE_CAP = 20

# --- fixed values: expected loss, all estimates --------------------------------------------

EXPOSURE_DEFAULTS = {
    "p_incident_given_finding": 0.15,
    "expected_monthly_transactions": 1000,
    "horizon_months": 3,
    "loss_fraction": 1.0,
}
EXPOSURE_BY_CLASS = {
    DUPLICATE_PAYMENT: {"p_incident_given_finding": 0.20, "trigger_fraction": 0.05},
    WEBHOOK_INTEGRITY: {"p_incident_given_finding": 0.10, "trigger_fraction": 0.02},
    AMOUNT_CURRENCY: {"p_incident_given_finding": 0.30, "trigger_fraction": 1.0},
}

REVIEW_MINUTES_PER_FP = 20
HOURLY_COST_USD = 50
FN_LOSS_INR = {
    DUPLICATE_PAYMENT: 1500,
    WEBHOOK_INTEGRITY: 1500,
    AMOUNT_CURRENCY: 75000,
    SUSPICIOUS_CONTENT: 0,
}
FALSE_POSITIVE_COST = 1.0
FALSE_NEGATIVE_COST = 5.0

# --- fixed values: titles ------------------------------------------------------------------

RULE_TITLES = {
    "DP-R1": "Payment captured without a duplicate-charge guard",
    "DP-R2": "Charge retried in a loop without idempotency",
    "DP-R3": "Webhook fulfills the order without an idempotency guard",
    "DP-R4": "Order fulfilled before payment is confirmed captured",
    "WI-R1": "Webhook handler skips signature verification",
    "WI-R2": "Webhook signature compared with a non-constant-time check",
    "WI-R3": "Webhook trusts amount/status from the payload, not the API",
    "WI-R4": "Webhook processed without verifying the event is unique",
    "AC-R1": "Order amount sent in rupees, not paise",
    "AC-R2": "Amount computed with floating-point rupees",
    "AC-R3": "Order amount taken from client input, not the server",
    "AC-R4": "Currency assumed INR without checking the order",
    "SC-R1": "Suspicious payment-handling pattern",
}
CLASS_TITLES = {
    DUPLICATE_PAYMENT: "Possible duplicate payment / double fulfillment",
    WEBHOOK_INTEGRITY: "Possible webhook integrity weakness",
    AMOUNT_CURRENCY: "Possible amount / currency handling error",
    SUSPICIOUS_CONTENT: "Suspicious payment-handling content",
}

# --- fixed values: knowledge base and retrieval --------------------------------------------

SAFE_CLASS_TOKENS = {
    "dp": DUPLICATE_PAYMENT,
    "dup": DUPLICATE_PAYMENT,
    "wi": WEBHOOK_INTEGRITY,
    "webhook": WEBHOOK_INTEGRITY,
    "ac": AMOUNT_CURRENCY,
    "amount": AMOUNT_CURRENCY,
    "paise": AMOUNT_CURRENCY,
}
EXAMPLE_CHARS = 1600
REFERENCE_CHARS = 200
RRF_K0 = 60
HARD_NEGATIVE_BONUS = 0.5 / 60
CANDIDATES = 24
TOP_K = 4
TOP_K_PER_UNIT = 2
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25

# --- fixed values: data set ----------------------------------------------------------------

TRAIN_FRACTION = 0.60
VAL_FRACTION = 0.20
SPLIT_SEED = "42"
PINNED_PREFIX = "ex-"

# --- fixed values: model calls -------------------------------------------------------------

PRICES_USD_PER_1M = {
    "gemini-2.5-flash": (0.075, 0.30),
    "llama-3.3-70b-versatile": (0.05, 0.08),
    "meta-llama/llama-3.3-70b-instruct": (0.00, 0.00),
    "claude-haiku-4-5-20251001": (0.80, 4.00),
    "claude-sonnet-4-6": (3.00, 15.00),
}
QUOTA_WINDOW_SECONDS = 60

# --- fixed values: ledger and audit --------------------------------------------------------

MIN_ORDER_PAISE = 100
SUPPORTED_CURRENCIES = ["INR", "USD", "EUR", "GBP", "SGD", "AED", "MYR"]
MAX_ATTEMPTS = 3
GENESIS_HASH = "0" * 64
REDELIVERY_HORIZON = "24 hours"
