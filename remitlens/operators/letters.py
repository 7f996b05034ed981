"""Denial letters: classification, retrieval query, guardrail, appeal packet."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LetterRule:
    tokens: tuple[str, ...]
    reason: str
    confidence: float
    code: str
    rationale: str


# Letter classes in order of precedence (fixed values).
LETTER_RULES = [
    LetterRule(
        ("mue", "units exceeded", "medically unlikely"),
        "Medically Unlikely Edit (MUE) exceeded",
        0.9,
        "D-MUE-001",
        "Claim suggests unit/day limits exceeded for billed HCPCS/CPT.",
    ),
    LetterRule(
        ("prior authorization", "missing auth", "no authorization"),
        "Missing prior authorization",
        0.88,
        "D-AUTH-002",
        "Narrative indicates missing or invalid authorization for billed services.",
    ),
    LetterRule(
        ("medical necessity", "not reasonable and necessary", "ncd", "lcd"),
        "Medical necessity documentation insufficient",
        0.84,
        "D-MN-003",
        "Coverage language suggests documentation did not meet LCD/NCD requirements.",
    ),
    LetterRule(
        ("non-covered", "noncovered", "carc co-4"),
        "Non-covered service or coding mismatch",
        0.82,
        "D-COVERAGE-004",
        "Denial appears to involve non-covered service definitions or coding mismatches.",
    ),
]
NO_RULE = LetterRule(
    (),
    "Insufficient claim evidence - manual review needed",
    0.6,
    "D-REVIEW-000",
    "No strong denial pattern found in uploaded text; fallback classification applied.",
)
PREVIEW_CHARS = 350

# Field names that must not appear in a letter (fixed values).
FORBIDDEN_FIELDS = [
    "denial_risk_score",
    "denial_risk_pct",
    "denial_source",
    "stage1_decision",
    "caveat_notes",
]
REDACTED = "[redacted]"
GUARDRAIL_REASON = (
    "Output guardrail triggered: removed forbidden structured fields from draft: "
)

# Wording of the template letter and checklist (fixed values).
LETTER_TEMPLATE = (
    "Subject: Request for Reconsideration of Medicare Denial\n\n"
    "To Claims Review Department,\n\n"
    "We are requesting reconsideration for denial code %s regarding %s. "
    "The submitted claim documentation supports medical necessity and coverage criteria under "
    "applicable Medicare policy.\n\n"
    "Clinical/administrative rationale: %s\n\n"
    "Requested action: Reprocess and overturn the denial based on attached records and policy "
    "support.\n\n"
    "Sincerely,\nProvider Appeals Team"
)
CHECKLIST_ALWAYS = [
    "Attach physician signed clinical summary with diagnosis-to-procedure linkage.",
    "Attach supporting records (labs/imaging/progress notes) for dates of service.",
    "Include claim identifiers, denial code, and requested action in cover note.",
]
CHECKLIST_BY_REASON = [
    (("authorization",),
     "Attach prior authorization number, approval window, and referral records."),
    (("medical necessity",),
     "Map chart evidence directly to LCD/NCD medical necessity criteria."),
    (("non-covered", "coding"),
     "Include corrected coding rationale (HCPCS/CPT/diagnosis alignment and modifiers)."),
    (("mue",),
     "Justify units with operative/procedure detail and same-day service documentation."),
]
CHECKLIST_CONTEXT = "Reference patient-specific timeline and prior treatment context in appeal body."
CHECKLIST_POLICY = "Cite relevant policy excerpt IDs and quote key coverage language."
DEFAULT_QUERY = "medicare denial appeal"
FALLBACK_REASON = "Requested provider unavailable; used template fallback."


def _mentions(haystack: Column, tokens: tuple[str, ...], whole_words: bool) -> Column:
    if whole_words:
        words = "|".join(re.escape(t) for t in tokens)
        return haystack.rlike(rf"(?U)\b(?:{words})\b")
    return reduce(lambda a, b: a | b, [F.contains(haystack, F.lit(t)) for t in tokens])


def classify(
    text: Column, rules: list[LetterRule] = LETTER_RULES, whole_words: bool = False
) -> Column:
    """Struct with the first matching rule. Tokens match inside words unless
    ``whole_words`` is set."""
    haystack = F.lower(text)

    def outcome(rule: LetterRule) -> Column:
        return F.struct(
            F.lit("D").alias("denial_type"),
            F.lit(rule.reason).alias("denial_reason"),
            F.lit(rule.confidence).alias("confidence"),
            F.lit(rule.code).alias("denial_code"),
            F.lit(rule.rationale).alias("rationale"),
        )

    chosen = outcome(NO_RULE)
    for rule in reversed(rules):
        chosen = F.when(_mentions(haystack, rule.tokens, whole_words), outcome(rule)).otherwise(
            chosen
        )
    return chosen


def classify_letters(
    letters: DataFrame,
    text: str = "extracted_text",
    rules: list[LetterRule] = LETTER_RULES,
    whole_words: bool = False,
) -> DataFrame:
    return letters.withColumn("c", classify(F.col(text), rules, whole_words)).select(
        *letters.columns,
        "c.*",
        F.substring(text, 1, PREVIEW_CHARS).alias("extracted_text_preview"),
    )


def _joined(pieces: list[Column], separator: str = " ") -> Column:
    """Trimmed pieces that are not blank (NULL counts as blank)."""
    return F.concat_ws(separator, *[F.nullif(F.trim(p), F.lit("")) for p in pieces])


def retrieval_query(context_summary: Column) -> Column:
    """Structured keys first, then the free text of the denial."""
    names = ["denial_source", "drg_code", "carc_code", "denial_reason", "rationale",
             "patient_context"]
    return _joined([*[F.col(n) for n in names], context_summary])


def or_default_query(query: Column, default: str = DEFAULT_QUERY) -> Column:
    return F.coalesce(F.nullif(query, F.lit("")), F.lit(default))


def auto_context(
    patient_context: Column, preview: Column | None = None, preview_chars: int = 300
) -> Column:
    def segment(label: str, value: Column) -> Column:
        return F.concat(F.lit(label), F.coalesce(value, F.lit("")))

    parts = [
        segment("Denial type: ", F.col("denial_type")),
        segment("Denial reason: ", F.col("denial_reason")),
        segment("Denial code: ", F.col("denial_code")),
        segment("Key rationale: ", F.col("rationale")),
        F.when(
            F.trim(patient_context) != "",
            segment("Additional patient/claim context: ", F.trim(patient_context)),
        ),
    ]
    if preview is not None:
        parts.append(
            F.when(
                F.trim(preview) != "",
                segment("Extracted denial letter preview: ", F.substring(preview, 1, preview_chars)),
            )
        )
    return F.concat_ws(" | ", *parts)


def claim_row_context(df: DataFrame) -> Column:
    """One line on an uploaded claim row; a missing column reads as empty."""

    def cell(name: str, default: str = "") -> Column:
        if name not in df.columns:
            return F.lit(default)
        return F.coalesce(F.col(name).cast("string"), F.lit(default))

    def join(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def coded(label: str, prefix: str) -> Column:
        return join(label, cell(f"{prefix}_code"), " ", cell(f"{prefix}_description"))

    return F.concat_ws(
        " | ",
        join("Claim ID: ", cell("claim_id", "N/A")),
        join("DRG: ", cell("drg_code", "N/A"), " (", cell("drg_description"), ")"),
        coded("Primary Dx: ", "primary_diagnosis"),
        coded("Secondary Dx: ", "secondary_diagnosis"),
        coded("Tertiary Dx: ", "tertiary_diagnosis"),
        join("CARC/RARC: ", cell("carc_code"), "/", cell("rarc_code")),
        join("LOS days: ", cell("length_of_stay_days")),
        join("Caveat: ", cell("caveat_notes")),
    )


_WORD = r"[\p{L}\p{N}_]"


def _field_pattern(fields: list[str]) -> str:
    """Whole field names in any case. The leading character test lets the engine
    pass over ordinary text cheaply."""
    first = "".join(sorted({c for f in fields for c in (f[0].lower(), f[0].upper())}))
    names = "|".join(re.escape(f) for f in fields)
    return rf"(?=[{first}])(?<!{_WORD})((?i:{names}))(?!{_WORD})"


def redact(text: Column, fields: list[str] = FORBIDDEN_FIELDS) -> Column:
    return F.regexp_replace(text, _field_pattern(fields), REDACTED)


def redaction_reason(text: Column, fields: list[str] = FORBIDDEN_FIELDS) -> Column:
    """Names found in the text, sorted; '' when there are none."""
    hits = F.regexp_extract_all(text, F.lit(_field_pattern(fields)), F.lit(1))
    found = F.array_sort(F.array_distinct(F.transform(hits, F.lower)))
    return F.when(
        F.size(found) > 0, F.concat(F.lit(GUARDRAIL_REASON), F.array_join(found, ", "))
    ).otherwise("")


def has_false_positive_caveat(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?i)\bfalse[\s-]*positive\b"), F.lit(False))


def evidence_checklist(patient_context: Column, policy_excerpts: Column) -> Column:
    reason = F.lower("denial_reason")
    items = [F.lit(text) for text in CHECKLIST_ALWAYS]
    for words, text in CHECKLIST_BY_REASON:
        items.append(F.when(_mentions(reason, words, whole_words=False), text))
    items.append(F.when(F.trim(patient_context) != "", CHECKLIST_CONTEXT))
    items.append(F.when(F.trim(policy_excerpts) != "", CHECKLIST_POLICY))
    return F.array_compact(F.array(*items))


def template_letter() -> Column:
    return F.format_string(
        LETTER_TEMPLATE,
        F.coalesce("denial_code", F.lit("N/A")),
        F.coalesce("denial_reason", F.lit("this claim")),
        F.coalesce("rationale", F.lit("See attached records.")),
    )


CONTEXT_COLUMNS = ["patient_context", "denial_source", "drg_code", "carc_code", "caveat_notes"]


def appeal_requests(
    letters: DataFrame,
    text: str = "extracted_text",
    rules: list[LetterRule] = LETTER_RULES,
) -> DataFrame:
    """Classified letters with the context summary and retrieval query of each.

    Where a letter came without patient context, its own summary stands in.
    """
    filled = letters.withColumns(
        {
            n: F.coalesce(n, F.lit("")) if n in letters.columns else F.lit("")
            for n in CONTEXT_COLUMNS
        }
    )
    classified = classify_letters(filled, text, rules)
    own = auto_context(F.col("patient_context"), F.col("extracted_text_preview"))
    given = classified.withColumn("given_context", F.col("patient_context")).withColumn(
        "patient_context",
        F.when(F.col("patient_context") != "", F.col("patient_context")).otherwise(own),
    )
    summed = given.withColumn("context_summary", auto_context(F.col("patient_context")))
    return summed.withColumn(
        "retrieval_query", or_default_query(retrieval_query(F.col("context_summary")))
    )


def appeal_packets(requests: DataFrame) -> DataFrame:
    """Letter, checklist and snapshot per request; ``requests`` carries the
    ``policy_excerpts`` block retrieved for it."""
    given = F.trim("given_context") != ""
    letter = template_letter()
    context = F.when(given, F.col("given_context")).otherwise(F.col("context_summary"))
    snapshot = F.create_map(
        F.lit("primary_reason_source"), F.lit("denial_letter"),
        F.lit("supporting_context_source"), F.when(given, "csv_context").otherwise("none"),
        F.lit("retrieval_query"), F.col("retrieval_query"),
        F.lit("denial_source"), F.col("denial_source"),
        F.lit("drg_code"), F.col("drg_code"),
        F.lit("carc_code"), F.col("carc_code"),
        F.lit("caveat_notes"), F.col("caveat_notes"),
        F.lit("caveat_warning"),
        has_false_positive_caveat(F.col("caveat_notes")).cast("string"),
        F.lit("primary_denial_reason"), F.col("denial_reason"),
        F.lit("primary_denial_code"), F.col("denial_code"),
    )
    return requests.withColumns(
        {
            "appeal_letter": redact(letter),
            "guardrail_reason": redaction_reason(letter),
            "evidence_checklist": evidence_checklist(context, F.col("policy_excerpts")),
            "generator": F.lit("template"),
            "fallback_reason": F.lit(FALLBACK_REASON),
            "context_snapshot": snapshot,
        }
    )
