"""Payer calls: phase of each turn, hints, recent turns and summaries.

A turn maps every phase it may find to the phase that follows, so a turn is a
small array, and arrays compose. A call is folded in two levels of blocks: the
turns of a block are composed to one array, the blocks are folded to the phase
each of them starts in, and the turns are then replayed inside their block. No
task ever holds more than a block of a call, however long the call is.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remitlens.operators.letters import _joined
from remitlens.sources.documents import collapse_space

BLOCK = 512
RECENT = 6


@dataclass(frozen=True)
class Step:
    """From one of the phases (any, if empty) to ``to`` when the text matches."""

    sources: tuple[str, ...]
    pattern: str
    to: str


@dataclass(frozen=True)
class CallFlow:
    """``steps``: the first that applies wins. ``overrides`` are then tried in
    order against the phase held before the turn and replace the outcome."""

    phases: tuple[str, ...]
    steps: tuple[Step, ...]
    overrides: tuple[Step, ...]
    hints: dict[str, str] = field(default_factory=dict)

    def number(self, phase: str) -> int:
        return self.phases.index(phase) + 1


_END = r"goodbye|end\s*call|hang\s*up"
_TRANSFER = r"transfer|press\s*0|speak.*(rep|agent)"
_NPI = r"npi|provider\s*id|authenticate"
_TO_AGENT = r"transfer|rep|agent|press\s*0|speak"

# Phases, transitions and hints of a claim-status call (fixed values).
STATUS_CALL = CallFlow(
    phases=(
        "IVR_GREETING", "IVR_AUTH_NPI", "IVR_CLAIM_LOOKUP", "IVR_STATUS_CODES",
        "TRANSFER_TO_REP", "REP_DETAIL", "REP_DOCUMENTATION", "REP_REFERENCE", "CALL_CLOSE",
    ),
    steps=(
        Step(("IVR_GREETING",), _NPI, "IVR_AUTH_NPI"),
        Step(("IVR_AUTH_NPI",), r"claim|control\s*number|icn", "IVR_CLAIM_LOOKUP"),
        Step(("IVR_AUTH_NPI", "IVR_CLAIM_LOOKUP"), r"status|denied|carc|rarc|denial", "IVR_STATUS_CODES"),
        Step(("IVR_STATUS_CODES",), _TO_AGENT, "TRANSFER_TO_REP"),
        Step(
            ("TRANSFER_TO_REP", "IVR_STATUS_CODES"),
            r"how\s*can\s*i\s*help|sarah|department|service\s*line|detail|which\s*line",
            "REP_DETAIL",
        ),
        Step(("REP_DETAIL",), r"document|submit|what.*need|appeal|written", "REP_DOCUMENTATION"),
        Step(("REP_DOCUMENTATION",), r"reference|rn-|call\s*ref|confirmation", "REP_REFERENCE"),
        Step((), _END + r"|that.*all", "CALL_CLOSE"),
    ),
    overrides=(
        Step(
            ("IVR_GREETING", "IVR_AUTH_NPI", "IVR_CLAIM_LOOKUP", "IVR_STATUS_CODES"),
            _TRANSFER,
            "TRANSFER_TO_REP",
        ),
        Step((), _END, "CALL_CLOSE"),
    ),
    hints={
        "IVR_GREETING": "The payer IVR has greeted you. You should wait for the authentication prompt.",
        "IVR_AUTH_NPI": "The IVR is asking for your NPI. Provide your 10-digit NPI to authenticate.",
        "IVR_CLAIM_LOOKUP": "The IVR wants the claim control number. Provide the 15-digit claim ID.",
        "IVR_STATUS_CODES": (
            "The IVR has returned CARC/RARC denial codes. You should note these codes "
            "and request to speak with a representative (press 0) for detailed information."
        ),
        "TRANSFER_TO_REP": (
            "You are being transferred to a live claims representative. "
            "Introduce your issue: identify the claim, beneficiary, and denial codes. "
            "Ask which service lines were affected."
        ),
        "REP_DETAIL": (
            "You are speaking with a representative. Ask about the specific denial reason, "
            "which service lines are affected, and why the LOS was considered inconsistent."
        ),
        "REP_DOCUMENTATION": (
            "Ask the representative what documentation is needed for a written appeal. "
            "Confirm the filing deadline (120 days)."
        ),
        "REP_REFERENCE": (
            "The representative has given the info you need. Request a call reference number "
            "for this inquiry and confirm it."
        ),
        "CALL_CLOSE": (
            "The call is wrapping up. Thank the representative and confirm you have "
            "the reference number, denial codes, and documentation requirements."
        ),
    },
)

# Phases, transitions and hints of an appeal-receipt call (fixed values).
APPEAL_CALL = CallFlow(
    phases=(
        "IVR_GREETING", "IVR_AUTH_NPI", "TRANSFER_TO_REP", "REP_CONFIRM_RECEIPT",
        "REP_CLINICAL_REVIEW", "REP_TRACKING", "REP_TIMELINE", "CALL_CLOSE",
    ),
    steps=(
        Step(("IVR_GREETING",), _NPI, "IVR_AUTH_NPI"),
        Step(("IVR_AUTH_NPI",), _TO_AGENT, "TRANSFER_TO_REP"),
        Step(
            ("TRANSFER_TO_REP", "IVR_AUTH_NPI"),
            r"how\s*can\s*i\s*help|mark|appeal|fax|receipt|confirm",
            "REP_CONFIRM_RECEIPT",
        ),
        Step(
            ("REP_CONFIRM_RECEIPT",),
            r"clinical|justification|medical\s*necessity|document|review",
            "REP_CLINICAL_REVIEW",
        ),
        Step(
            ("REP_CLINICAL_REVIEW", "REP_CONFIRM_RECEIPT"),
            r"track|rn-|assign|appeal.*number|reference",
            "REP_TRACKING",
        ),
        Step(("REP_TRACKING",), r"timeline|how\s*long|30\s*day|when|review|status", "REP_TIMELINE"),
        Step((), _END + r"|that.*all", "CALL_CLOSE"),
    ),
    overrides=(
        Step(("IVR_GREETING", "IVR_AUTH_NPI"), _TRANSFER, "TRANSFER_TO_REP"),
        Step((), _END, "CALL_CLOSE"),
    ),
    hints={
        "IVR_GREETING": "The payer appeals IVR has greeted you. Wait for the authentication prompt.",
        "IVR_AUTH_NPI": "Provide your 10-digit NPI to authenticate with the appeals line.",
        "TRANSFER_TO_REP": (
            "Request transfer to a live appeals representative (press 0). "
            "Appeals cannot be submitted via IVR — this call confirms receipt of a written appeal."
        ),
        "REP_CONFIRM_RECEIPT": (
            "You are speaking with an appeals rep. State the claim number, beneficiary ID, "
            "prior call reference, and that you faxed a written appeal. "
            "Ask the rep to confirm the fax was received."
        ),
        "REP_CLINICAL_REVIEW": (
            "The representative is reviewing documents. If asked, provide clinical justification "
            "based on patient evidence: ventilator duration, diagnoses, comorbidity impact on LOS. "
            "NEVER reference model predictions, denial scores, or classifier outputs."
        ),
        "REP_TRACKING": (
            "The representative should assign an appeal tracking number. "
            "Confirm the tracking number and ask about the review timeline."
        ),
        "REP_TIMELINE": (
            "Confirm the review period (30 days for Medicare redetermination), "
            "determination method (written by mail), and how to check status later."
        ),
        "CALL_CLOSE": "Wrap up the call. Confirm the tracking number and timeline.",
    },
)

FLOWS = {"2": STATUS_CALL, "3": APPEAL_CALL}


def normalise_scenario(scenario: Column) -> Column:
    text = F.trim(scenario.cast("string"))
    return F.when(text.isin("2", "3"), text).otherwise("2")


def turn_maps(turns: DataFrame, flow: CallFlow, payer: str = "payer") -> DataFrame:
    """(call_id, turn, map): ``map[i]`` is the phase number after phase i. Each
    pattern is tested once per turn by the native regular-expression engine."""
    patterns = list(dict.fromkeys(s.pattern for s in (*flow.steps, *flow.overrides)))
    line = F.lower(collapse_space(F.coalesce(payer, F.lit(""))))
    tested = turns.select("call_id", "turn", line.alias("line")).select(
        "call_id", "turn", *[F.col("line").rlike(p).alias(f"m{i}") for i, p in enumerate(patterns)]
    )

    def matched(step: Step) -> Column:
        return F.col(f"m{patterns.index(step.pattern)}")

    def after(phase: str) -> Column:
        result = F.lit(flow.number(phase))
        for step in reversed(flow.steps):
            if not step.sources or phase in step.sources:
                result = F.when(matched(step), flow.number(step.to)).otherwise(result)
        for step in flow.overrides:
            if not step.sources or phase in step.sources:
                result = F.when(matched(step), flow.number(step.to)).otherwise(result)
        return result

    return tested.select("call_id", "turn", F.array(*[after(p) for p in flow.phases]).alias("map"))


def _fold(steps: DataFrame, keys: list[str], start: Column) -> DataFrame:
    """Replay the sorted ``steps`` array; one row per step with phases around it."""
    empty = F.array().cast("array<struct<pos:bigint,before:int,after:int>>")

    def advance(acc, step):
        after = F.element_at(step["map"], acc["cur"])
        seen = F.struct(
            step["pos"].alias("pos"), acc["cur"].alias("before"), after.alias("after")
        )
        return F.struct(after.alias("cur"), F.concat(acc["out"], F.array(seen)).alias("out"))

    folded = F.aggregate(
        "steps", F.struct(start.alias("cur"), empty.alias("out")), advance, lambda acc: acc["out"]
    )
    return steps.select(*keys, F.explode(folded).alias("s")).select(*keys, "s.*")


def prefix_phases(maps: DataFrame, width: int, block: int = BLOCK, levels: int = 2) -> DataFrame:
    """(call_id, pos, before, after) for maps (call_id, pos, map), from phase 1."""

    def gathered(df: DataFrame, keys: list[str]) -> DataFrame:
        return df.groupBy(*keys).agg(
            F.array_sort(F.collect_list(F.struct("pos", "map"))).alias("steps")
        )

    if levels == 0:
        return _fold(gathered(maps, ["call_id"]), ["call_id"], F.lit(1))
    placed = maps.withColumn("block", F.expr(f"pos div {block}"))
    blocks = gathered(placed, ["call_id", "block"])
    identity = F.array(*[F.lit(i + 1) for i in range(width)])
    composed = F.aggregate(
        "steps",
        identity,
        lambda acc, step: F.transform(acc, lambda phase: F.element_at(step["map"], phase)),
    )
    starts = prefix_phases(
        blocks.select("call_id", F.col("block").alias("pos"), composed.alias("map")),
        width,
        block,
        levels - 1,
    ).select("call_id", F.col("pos").alias("block"), F.col("before").alias("start"))
    located = blocks.join(starts, ["call_id", "block"])
    return _fold(located, ["call_id"], F.col("start"))


def call_phases(turns: DataFrame, flow: CallFlow, payer: str = "payer") -> DataFrame:
    """(call_id, turn, state): the phase after each payer turn."""
    maps = turn_maps(turns, flow, payer).select(
        "call_id", F.col("turn").cast("bigint").alias("pos"), "map"
    )
    names = F.array(*[F.lit(p) for p in flow.phases])
    return prefix_phases(maps, len(flow.phases)).select(
        "call_id", F.col("pos").alias("turn"), F.element_at(names, F.col("after")).alias("state")
    )


def phase_hint(state: Column, flow: CallFlow) -> Column:
    hint = F.lit("Continue the conversation naturally.")
    for phase, text in flow.hints.items():
        hint = F.when(state == phase, text).otherwise(hint)
    return F.format_string("[Call Phase: %s] %s", state, hint)


def transcript(turns: DataFrame, flow: CallFlow, at: str | None = None) -> DataFrame:
    """Log rows (call_id, turn, state, payer, provider, timestamp) to append."""
    when = F.col(at) if at else F.current_timestamp()
    stamped = turns.select(
        "call_id",
        F.col("turn").cast("bigint").alias("turn"),
        "payer",
        "provider",
        F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
    )
    return call_phases(turns, flow).join(stamped, ["call_id", "turn"]).select(
        "call_id", "turn", "state", "payer", "provider", "timestamp"
    )


def recent_turns(log: DataFrame, n: int = RECENT) -> DataFrame:
    """The last ``n`` turns of each call as PAYER/PROVIDER lines."""
    last = Window.partitionBy("call_id").orderBy(F.desc("turn"))
    kept = log.withColumn("back", F.row_number().over(last)).where(F.col("back") <= n)
    return kept.groupBy("call_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("turn", turn_lines().alias("lines")))),
                lambda t: t["lines"],
            ),
            "\n",
        ).alias("recent")
    )


def turn_lines() -> Column:
    return F.concat(
        F.lit("PAYER: "), F.coalesce("payer", F.lit("")),
        F.lit("\nPROVIDER: "), F.coalesce("provider", F.lit("")),
    )


def turn_places(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """``log`` with each turn's ``place`` in its call, from 0, whatever the turn numbers.

    Turns are counted per block of numbers, then the sizes of the blocks before are
    added, so no call is sorted as a whole.
    """
    rough = log.withColumn("rough", F.floor(F.col("turn") / block))
    sizes = rough.groupBy("call_id", "rough").agg(F.count("*").alias("size"))
    before = Window.partitionBy("call_id").orderBy("rough").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("call_id", "rough", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("call_id", "rough").orderBy("turn"))
    return (
        rough.withColumn("nth", within)
        .join(offsets, ["call_id", "rough"])
        .withColumn("place", F.col("offset") + F.col("nth") - 1)
        .drop("rough", "nth", "offset")
    )


def prior_context(log: DataFrame, n: int = RECENT, block: int = BLOCK) -> DataFrame:
    """Each turn with the lines of the ``n`` turns before it. Turn numbers may have
    gaps. The window runs per block of places; the last turns of a block are lent
    to the next one, so no call is sorted as a whole."""
    block = max(block, n)
    own = turn_places(log, block).select(
        "call_id", "turn", "place", turn_lines().alias("lines"), F.floor(F.col("place") / block).alias("block"),
        F.lit(True).alias("own"),
    )
    lent = own.where(F.col("place") % block >= block - n).withColumns(
        {"block": F.col("block") + 1, "own": F.lit(False)}
    )
    before = Window.partitionBy("call_id", "block").orderBy("place").rowsBetween(-n, -1)
    return (
        own.unionByName(lent)
        .withColumn("prior", F.array_join(F.collect_list("lines").over(before), "\n"))
        .where("own")
        .select("call_id", "turn", "prior")
    )


# Keyword rules of the call summary (fixed values).
STATUS_RULES = [
    (("denied", "denial"), "denied_or_pending_appeal"),
    (("appeal tracking", "tracking number", "rn-"), "appeal_tracking_confirmed"),
    (("approved", "paid"), "approved"),
]
STATUS_DEFAULT = "in_progress"
MISSING_RULES = [
    (("carc",), "Confirm CARC denial code"),
    (("rarc",), "Confirm RARC denial code"),
    (("reference", "rn-"), "Obtain payer call reference number"),
    (("document", "records"), "Confirm required supporting documentation list"),
]
NEXT_ACTIONS = [
    "Document call details in RCM note",
    "Attach payer reference/tracking IDs to the claim file",
    "Collect missing clinical or coding documentation before follow-up",
]


def call_summary(
    log: DataFrame,
    status_rules: list[tuple[tuple[str, ...], str]] = STATUS_RULES,
    missing_rules: list[tuple[tuple[str, ...], str]] = MISSING_RULES,
) -> DataFrame:
    """Status, open questions, last phase and recent turns per call.

    A keyword never spans two turns, so the tests are made per turn and combined
    with OR; the call's text is not put together.
    """
    line = F.lower(
        F.concat(
            F.lit("["), F.col("state"), F.lit("] PAYER: "), F.coalesce("payer", F.lit("")),
            F.lit(" | PROVIDER: "), F.coalesce("provider", F.lit("")),
        )
    )
    words = list(
        dict.fromkeys(w for tokens, _ in (*status_rules, *missing_rules) for w in tokens)
    )
    tested = log.select("call_id", "turn", "state", line.alias("line")).select(
        "call_id", "turn", "state",
        *[F.contains("line", F.lit(w)).alias(f"w{i}") for i, w in enumerate(words)],
    )
    seen = tested.groupBy("call_id").agg(
        F.count("*").alias("turns"),
        F.max_by("state", "turn").alias("current_state"),
        *[F.bool_or(f"w{i}").alias(f"w{i}") for i in range(len(words))],
    )

    def any_of(tokens: tuple[str, ...]) -> Column:
        result = F.lit(False)
        for t in tokens:
            result = result | F.col(f"w{words.index(t)}")
        return result

    status = F.lit(STATUS_DEFAULT)
    for tokens, value in status_rules:  # a later rule overrules an earlier one
        status = F.when(any_of(tokens), value).otherwise(status)
    missing = F.array_compact(
        F.array(*[F.when(~any_of(tokens), text) for tokens, text in missing_rules])
    )
    summary = seen.select(
        "call_id",
        "turns",
        "current_state",
        status.alias("status_case"),
        missing.alias("missing_information"),
        F.array(*[F.lit(a) for a in NEXT_ACTIONS]).alias("next_actions"),
    )
    return summary.join(recent_turns(log), "call_id", "left")


# Keys that must not reach a prompt (fixed values).
PROMPT_FORBIDDEN = [
    "classifier",
    "denial_risk_score",
    "denial_risk_pct",
    "denial_source",
    "stage1_decision",
    "caveat_notes",
]
CALL_QUERY_DEFAULT = "medicare denial call"


def call_query(payer: Column, context: Column) -> Column:
    """Retrieval query of a turn from the nested claim context and the payer's words."""
    query = _joined(
        [
            context["classifier"]["denial_source"],
            context["claim"]["drg_code"],
            context["ivr_status"]["carc_code"],
            context["claim"]["drg_description"],
            payer,
        ]
    )
    return F.coalesce(F.nullif(query, F.lit("")), F.lit(CALL_QUERY_DEFAULT))


def public_context(context: Column, forbidden: list[str] = PROMPT_FORBIDDEN) -> Column:
    """JSON of a claim context (a map of texts) without the internal keys."""
    return F.to_json(F.map_filter(context, lambda k, _: ~k.isin(*forbidden)))


DEFAULT_TEMPLATE = (
    "CLAIM CONTEXT:\n{claim_context}\n\nCURRENT CALL PHASE:\n{state_context}\n\n"
    "RELEVANT MEDICARE POLICY EXCERPTS:\n{policy_excerpts}\n"
)


def prompt_rows(turns: DataFrame, flow: CallFlow, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """One prompt per turn. ``turns`` has call_id, turn, state, payer, prior,
    context (a map of texts) and policy_excerpts; the template is data."""
    text = F.lit(template)
    for name, value in (
        ("claim_context", public_context(F.col("context"))),
        ("state_context", phase_hint(F.col("state"), flow)),
        (
            "policy_excerpts",
            F.coalesce(
                F.nullif("policy_excerpts", F.lit("")),
                F.lit("(No policy excerpts retrieved for this turn.)"),
            ),
        ),
    ):
        text = F.replace(text, F.lit("{" + name + "}"), value)
    prompt = F.concat(
        F.lit("SYSTEM INSTRUCTIONS:\n"), text,
        F.lit("\n\nRECENT TRANSCRIPT:\n"), F.coalesce("prior", F.lit("")),
        F.lit("\n\nLATEST PAYER MESSAGE:\n"), F.col("payer"),
        F.lit("\n\nReturn only the provider-side response to say next."),
    )
    return turns.select("call_id", "turn", prompt.alias("prompt"))
