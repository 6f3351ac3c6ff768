"""Fixed domain values: categories, word lists, field labels, thresholds.

Everything in this module is a small constant.  Operators embed these values as
literals in the plan, so no dimension table ever has to be shuffled.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# Fixed values (they must equal the published behaviour for results to agree).
# --------------------------------------------------------------------------

# Order of evaluation of the rule classifier; ties are won by the earlier one.
RULE_CATEGORIES = ["SI_REQUEST", "BL_COMPARISON", "INVOICE_QUERY", "GENERAL", "SPAM"]

# Order used by scoring and reports.
CATEGORIES = ["BL_COMPARISON", "SI_REQUEST", "INVOICE_QUERY", "GENERAL", "SPAM"]

STATUSES = ["OK", "MISMATCH", "NEEDS_REVIEW"]
REVIEW_REASONS = ["wrong_doc_type", "missing_attachment", "unreadable", "missing_value"]
FIELD_STATES = ["MATCHED", "NOT_MATCHED", "REVIEW_NEEDED"]
DECISION_SOURCES = ["attachment_pair", "ml_model", "llm", "keyword_fallback"]

STOPWORDS = """
a about after all am an and any are as at be because been before being between both
but by can could dear did do does doing down during each for from further good had
has have having he hello her here hers hi him his how i if in into is it its
itself just kindly me more most my no nor not of off on once only or other our out
over own please same she should so some such than that the their them then there these they
this those through to too under until up very was we were what when where which while who
why will with would you your bye thanks thank
""".split()

SHORT_WORDS = ["si", "bl", "gr"]

KEYWORDS = {
    "SI_REQUEST": "request si needed shipping instruction revert draft bl available send".split(),
    "BL_COMPARISON": (
        "confirm docs attached si draft bl check details verify matches amend compare aie afemy "
        "afptme afrt"
    ).split(),
    "INVOICE_QUERY": (
        "invoice billing charges missing gr query freight payment cost fee amount breakdown"
    ).split(),
    "GENERAL": (
        "update summary berthing report schedule reminder operations holiday loading completed "
        "vessel pending outstanding approval leave release daily"
    ).split(),
    "SPAM": (
        "won prize claim gift bitcoin guaranteed urgent account survey click winner investment "
        "parcel mailbox storage deactivation crypto weird trick iphone customs congratulations "
        "returns"
    ).split(),
}

PHRASES = {
    "SI_REQUEST": [
        "request si", "si needed", "shipping instruction", "revert with draft bl", "send the si",
    ],
    "BL_COMPARISON": [
        "confirm docs", "attached are the si and draft bl", "check the details", "verify the bl",
        "matches the si", "amend bl", "request bl draft",
    ],
    "INVOICE_QUERY": [
        "invoice query", "local charges", "missing gr", "freight charges", "invoice amount",
    ],
    "GENERAL": [
        "update summary", "berthing report", "operations update", "holiday reminder",
        "pending bl release", "outstanding bl", "time off request", "daily berthing report",
    ],
    "SPAM": [
        "you have won", "claim your", "gift card", "bitcoin investment", "verify account",
        "verify your account", "guaranteed returns", "weird trick", "storage limit",
        "free iphone", "unpaid customs", "monthly draw", "click here",
    ],
}

SUBJECT_KEYWORD_WEIGHT = 2
BODY_KEYWORD_WEIGHT = 1
SUBJECT_PHRASE_WEIGHT = 2
BODY_PHRASE_WEIGHT = 1

# The seven compared fields and the labels documents use for them.
FIELD_ALIASES = {
    "shipper": ["Shipper", "Shipper/Exporter", "Shipper (Principal or Seller)", "SHIPPER"],
    "consignee": [
        "Consignee", "Consignee (Non-Negotiable)", "CONSIGNEE", "To the Order of",
    ],
    "notify_party": [
        "Notify Party", "Notify", "Notify Party/Intermediate Consignee", "NOTIFY PARTY",
    ],
    "port_of_loading": [
        "Port of Loading", "Port of Loading (POL)", "Load Port", "POL", "PORT OF LOADING",
    ],
    "port_of_discharge": [
        "Port of Discharge", "Port of Discharge (POD)", "Discharge Port", "POD",
        "PORT OF DISCHARGE",
    ],
    "container_count": [
        "No. of Containers", "Total Containers", "No. of Containers or Packages",
        "Container Count",
    ],
    "gross_weight_kg": [
        "Gross Weight (KG)", "Gross Wt (kgs)", "Gross Weight毛重(KGS)", "GROSS WEIGHT",
    ],
}
FIELDS = list(FIELD_ALIASES)
COUNT_FIELD = "container_count"
WEIGHT_FIELD = "gross_weight_kg"

LABEL_SYNONYMS = {
    "containers": "container",
    "kgs": "kg",
    "no": "number",
    "packages": "package",
    "wt": "weight",
}
LABEL_CONNECTORS = ["a", "and", "of", "or", "the"]

MIN_LABEL_SCORE = 30.0
MIN_LABEL_MARGIN = 10.0
EXACT_SCORE = 100.0
SHARED_WORD_POINTS = 15.0
DIFFERENT_WORD_POINTS = 5.0
SHARED_ACRONYM_POINTS = 30.0
INITIAL_POINTS = 5.0

WRONG_DOCUMENT_MARKERS = ["commercial invoice", "packing list", "certificate of origin"]
MISSING_WORDS = ["tba", "tbc", "n/a", "na", "nil", "none"]

ATTACHMENT_PHRASES = [
    "compare the si and draft bl",
    "attached si and draft bl",
    "attachments dropped",
    "attachment dropped",
    "draft bl is still missing",
    "missing attachment",
]

TEXT_FORMATS = ["txt"]
OFFICE_FORMATS = ["docx", "xlsx"]
GLYPH_FORMATS = ["pdf"]

MODEL_THRESHOLD = 0.45
LOW_CONFIDENCE_PERCENT = 60.0
SCORE_WEIGHTS = {"stage1": 0.30, "stage3": 0.20, "end_to_end": 0.50}

SPAM_MARKERS = ["casino", "crypto investment", "unsubscribed", "lottery"]
SHIPPING_MARKERS = ["shipping", "lading", "container", "booking"]
SI_MARKERS = ["si", "shipping_instruction", "shipping instruction", "draft_si"]
BL_MARKERS = ["bl", "bill_of_lading", "bill of lading", "draft_bl", "draft bl", "lading"]
COMPARE_MARKERS = [
    "compare", "discrepancy", "si vs bl", "bl vs si", "audit", "check bl", "si_vs_bl",
    "bl_comparison",
]
SI_FALLBACK_MARKERS = ["shipping instruction", "submit si", "si details", "draft si"]
INVOICE_SUBJECT_MARKERS = ["invoice", "billing", "payment"]

EXTRACTION_KEYS = [
    "shipper", "consignee", "notify_party", "vessel", "voyage", "port_of_loading",
    "port_of_discharge", "container_number", "seal_number", "cargo_description",
    "gross_weight", "measurement",
]

APPROVE_NOTE = "Manually approved by supervisor"
ESCALATE_NOTE = "Escalated externally to forwarder"

# Text features of the trained classifier.
CHAR_GRAM_SIZES = (3, 4, 5)
BODY_CHAR_TERMS = 30000
LOGISTIC_C = 20.0
LOGISTIC_ITERATIONS = 3000
