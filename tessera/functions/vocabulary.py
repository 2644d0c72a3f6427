"""Word lists, tables, patterns and constants that results depend on. They are data, not logic."""

from __future__ import annotations

# Stopwords of search tokens, and of the extractive answer's words.
STOPWORDS = (
    "a an and are as at be but by can do does for from has have how i in is it its me my not of on or that the this to up was we what "
    "when where which who why will with you your"
).split()
ANSWER_STOPWORDS = [*STOPWORDS, "while", "still", "should"]

# Scoring and selection.
K1, B = 1.5, 0.75
RRF_K, POOL, TOP_K = 60, 50, 5
DENSE_FLOOR = 0.05
RERANK_BLEND = 1.0
MMR_LAMBDA = 0.7
EMBEDDING_DIM, NGRAM_LOW, NGRAM_HIGH = 384, 3, 5
MIN_BODY_CHARS, MAX_CHUNK_CHARS, STEP_GROUP, MIN_STEPS = 30, 1800, 4, 5
CITATION_COVERAGE, CITATIONS, GUARDRAIL_WINDOW = 0.6, 2, 8
PROMPT_BLOCKS, PROMPT_CHARS = 8, 1400
SEMANTIC_CACHE = 0.93
GATES = {"recall": 0.75, "citation_precision": 0.80, "groundedness": 0.60, "violation_rate": 0.0}

# Field slang (substring of the lower-cased question) and the manual terms that it adds, in this order.
SLANG = {
    "not cooling": ["cooling capacity", "low capacity", "evaporator", "superheat"],
    "no cooling": ["cooling capacity", "low capacity", "evaporator", "superheat"],
    "not heating": ["heating capacity", "low capacity", "flow temperature"],
    "no heat": ["heating capacity", "low capacity"],
    "warm air": ["low capacity", "air temperature"],
    "icing": ["coil frost", "icing", "defrost", "evaporator"],
    "iced up": ["coil frost", "icing", "defrost"],
    "icing up": ["coil frost", "icing", "defrost"],
    "freezing up": ["coil frost", "icing", "defrost"],
    "frost on": ["coil frost", "defrost"],
    "tripping": ["breaker", "overcurrent", "trip", "electrical"],
    "trips": ["trip", "overcurrent", "breaker"],
    "keeps cutting out": ["trip", "lockout", "fault code"],
    "leaking water": ["condensate", "drain", "tray", "leak"],
    "water under": ["condensate", "tray", "drain", "overflow"],
    "water pooling": ["condensate", "tray", "drain", "overflow"],
    "dripping": ["condensate", "drain", "tray"],
    "noisy": ["noise", "vibration", "fan", "bearing"],
    "rattling": ["noise", "vibration", "fan", "debris"],
    "humming": ["noise", "inverter", "compressor"],
    "won't start": ["no power", "start", "contactor", "controller"],
    "wont start": ["no power", "start", "contactor"],
    "not starting": ["no power", "start", "contactor"],
    "no display": ["no power", "display", "supply"],
    "smells": ["burning odor", "electrical", "overheat"],
    "burning smell": ["burning odor", "electrical", "overheat"],
    "how much": ["factory charge", "charge weight"],
    "how many": ["factory charge", "charge weight"],
    "how do i": ["step", "procedure"],
    "how do you": ["step", "procedure"],
    "how to": ["step", "procedure"],
    "what size": ["specifications", "nominal"],
}

# Words (whole) and the terms that they add.
SYNONYMS = {
    "capacity": ["capacity", "output", "delta-t", "specifications", "nominal"],
    "wire": ["wiring", "conductor", "terminal", "cable"],
    "gauge": ["conductor", "cross-section", "mm²"],
    "part": ["spare", "order", "part number", "bom"],
    "fix": ["corrective action", "repair"],
    "reset": ["clear", "reset", "lockout"],
    "error": ["fault code"],
    "alarm": ["fault code"],
    "code": ["fault code"],
    "clean": ["cleaning", "rinse", "coil cleaning"],
    "flush": ["flush", "condensate tray", "drain"],
    "rated": ["nominal", "specifications"],
    "torque": ["torque", "nm"],
    "braze": ["brazing", "nitrogen purge", "torch", "joint"],
    "weld": ["brazing", "open flame"],
}

# Intents, the first that has a substring in the lower-cased question; a known code comes before all.
INTENTS = {
    "parts": ["part number", "part", "spare", "order ", "bom", "kit"],
    "wiring": ["wire", "wiring", "terminal", "gauge", "mm²", "torque", "modbus", "rs-485", "conductor"],
    "procedure": ["how do i", "how to", "steps", "procedure", "clean", "replace", "check", "verify", "flush", "top up"],
    "specs": ["specification", "rated", "charge weight", "capacity of", "what size"],
}

# Safety topics by substring of the lower-cased text.
SAFETY_TOPICS = {
    "refrigerant": [
        "braz", "solder", "nitrogen purge", "recover", "recovery", "recharge", "evacuate", "evacuation", "leak seal",
        "charging the system", "charge the system", "open the circuit", "refrigerant work", "refrigerant handling",
    ],
    "pressurized": [
        "pressurised system", "pressurized system", "pressure test", "pressure decay", "relief valve", "burst disc", "bursting disc",
        "schrader", "overpressure", "pressurise the refrigerant", "pressurize the refrigerant",
    ],
    "energized-electrical": [
        "live wire", "live circuit", "mains", "energiz", "energis", "loto", "lock out", "lockout", "lock-out", "capacitor",
        "discharge the", "busbar", "bus bar", "insulation resistance", "megger", "earth fault", "ground fault", "electrocut",
        "hot work", "panel live",
    ],
    "gas": ["gas leak", "combustion", "burner gas", "gas valve", "carbon monoxide"],
}
# A designation with a work verb is topic "refrigerant" too, unless the text asks for a quantity.
DESIGNATIONS = ["r32", "r-32", "r410", "r-410", "r134a", "r-134a", "r513a", "r-513a", "refrigerant"]
WORK_VERBS = [
    "braz", "solder", "weld", "grind", "recover", "repair", "replace", "evacuate", "top up", "top-up", "recharge", "refill",
    "purge", "open", "vent", "drain", "disconnect", "charge ", "charging", "test", "weigh in",
]
QUANTITY_QUESTION = r"\bhow\s+(much|many|long)[^.;]{0,60}\b(r[- ]?\d+\w*|refrigerant|gas)\b"

# Words in a heading that make its section a safety section.
SAFETY_HEADINGS = ["safety", "refrigerant", "loto", "lockout", "hazard", "danger"]

# Patterns of lines and codes.
HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
TABLE_ROW = r"^\s*\|.*\|\s*$"
TABLE_RULE = r"^\s*\|[\s:|-]+\|\s*$"
IMAGE = r"!\[(.*?)\]\((.*?)\)"
WARNING = r"(?i)^\s*>?\s*(?:⚠|‼|❗)?\s*(?:\*\*)?(DANGER|WARNING|CAUTION|NOTICE)(?:\*\*)?\s*[:!-]\s*(.*)"
CAPTION = r"(?i)^(?:\*\*)?\s*Table:\s*(.+?)(?:\*\*)?\s*$"
BOILERPLATE = [r"(?i)^\s*page\s+\d+(\s+of\s+\d+)?\s*$", r"(?i)^\s*(revision|rev\.?)\s+[\d.]+.*$", r"^\s*©.*$", r"^\s*\*{3,}\s*$", r"^\s*-{5,}\s*$"]
CODE_COLUMN = r"(?i)\bcode\b|fault"
CELL_CODE = r"\b([A-Z]{1,3}\s?-?\d{2,3})\b"
QUERY_CODE = r"\b([A-Z])\s?-?(\d{2,3})\b"
ANCHOR_CODE = r"\bE\s?-?(\d{2,3})\b"
STEP = r"^\s*(\d+)[.)]\s+(.+)$"
CHUNK_WARNING = r"(?i)(DANGER|WARNING)\s*[:!-]"
NEGATION = r"(?i)\b(not|never|no|cannot|can't|don't|do not|unsafe|prohibited)\b"

# Texts of answers.
NOT_COVERED = "The indexed documentation does not cover this question. Please consult the full service manual or contact technical support."
ANSWER_HEADER = "Based on the service documentation:"
EXACT_HEADER = "Exact match from the fault-code table:"
ESCALATION = [
    "I can't give procedural guidance for this. The question involves ",
    "safety-critical work",
    ", which is safety-critical, and no section tagged as safety documentation supports an answer here. "
    "Stop and contact a certified HVAC technician; a supervisor has been flagged to review this request.",
    ' The nearest safety documentation is "',
    " No matching safety section is currently indexed for this unit.",
]

# Questions that ask for a procedure.
PROCEDURAL_ASK = r"(?i)\b(how (do|to|should|can)|can i|steps|procedure|what should i do|is it (safe|ok|okay)|safe to|allowable|correct way)\b"
