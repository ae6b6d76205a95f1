"""Tokenising, redaction and signature matching as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Redaction patterns, applied in this order, and injection signatures.
PII_PATTERNS = {
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "CREDIT_CARD": r"\b(?:\d{4}[- ]?){3}\d{4}\b",
    "API_KEY": r"\b(?:sk-[a-zA-Z0-9]{32,}|AKIA[0-9A-Z]{16})\b",
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,7}\b",
    "PHONE": r"\b(?:\+?1[-.]?)?\(?[2-9]\d{2}\)?[-.]?\d{3}[-.]?\d{4}\b",
}
# What a text must contain before a pattern can match: a linear scan instead of backtracking.
NEEDED = {
    "SSN": r"\d{4}",
    "CREDIT_CARD": r"\d{4}",
    "API_KEY": r"(?i)sk-|akia",
    "EMAIL": r"@",
    "PHONE": r"\d{4}",
}
INJECTION_SIGNATURES = (
    r"ignore\s+(all\s+)?(previous|prior)\s+instructions?",
    r"system\s*:?\s*override",
    r"you\s+are\s+now\s+(a\s+)?(developer|admin|god\s+mode|unrestricted)",
    r"bypass\s+security\s+protocols?",
    r"reveal\s+(all\s+)?(api\s+keys?|passwords?|secrets?)",
    r"jailbreak",
    r"disregard\s+(the\s+above|(all\s+)?(previous|prior)\s+instructions?)",
)
TOKEN_PATTERN = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Lower-case word tokens of any script, in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def redaction(text: Column) -> Column:
    """STRUCT<text, matches, kinds>: the patterns applied in order, each on the text the
    previous one left.

    Each step is a lambda over a one-element array, which binds the running text to a name:
    written as nested calls, every step would evaluate all earlier ones several times.
    """
    none = F.array().cast("array<string>")
    state = F.array(F.struct(text.alias("text"), F.lit(0).alias("matches"), none.alias("kinds")))
    for kind in PII_PATTERNS:
        state = F.transform(F.transform(state, _counted(kind)), _replaced(kind))
    return state[0]


def _counted(kind: str):
    def step(s: Column) -> Column:
        possible = F.coalesce(s["text"].rlike(NEEDED[kind]), F.lit(False))
        matches = F.regexp_count(s["text"], F.lit(f"(?i){PII_PATTERNS[kind]}"))
        found = F.when(possible, matches).otherwise(0)
        return F.struct(
            s["text"].alias("text"),
            s["matches"].alias("matches"),
            s["kinds"].alias("kinds"),
            found.alias("n"),
        )

    return step


def _replaced(kind: str):
    def step(s: Column) -> Column:
        clean = F.regexp_replace(s["text"], f"(?i){PII_PATTERNS[kind]}", f"<REDACTED_{kind}>")
        hit = s["n"] > 0
        kinds = F.when(hit, F.array_append(s["kinds"], F.lit(kind))).otherwise(s["kinds"])
        return F.struct(
            F.when(hit, clean).otherwise(s["text"]).alias("text"),
            (s["matches"] + s["n"]).alias("matches"),
            kinds.alias("kinds"),
        )

    return step


def injection_reason(text: Column) -> Column:
    """Reason of the first matching signature; null for clean text.

    White space and word borders are Unicode ones: a no-break space does not hide a signature.
    """
    hits = [
        F.when(text.rlike(f"(?iU){sig}"), F.lit(f"Adversarial signature detected: '{sig}'"))
        for sig in INJECTION_SIGNATURES
    ]
    return F.coalesce(*hits)
