"""Text expressions: redaction, claims, checks, prompts and lenient JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnledger.schemas import SLOT_ORDER

# Redaction patterns and their replacements, in the order they apply.
PHONE = (r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b", "[PHONE_NUMBER]")
EMAIL = (r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "[EMAIL_ADDRESS]")
CARD = (r"\b(?:\d[ -]*?){13,16}\b", "[CREDIT_CARD_NUMBER]")
REDACTIONS = {"phone": PHONE, "email": EMAIL, "card": CARD}

# The order reference inside an utterance.
ORDER_ID = r"#?\s*(\d{3,6})"

# Keyword of an utterance and the token a good reply contains.
REPLY_KEYWORDS = (("cancel", "cancel"), ("return", "return"), ("address", "address"), ("tracking", "track"))
REPLY_DEFAULT = "order"

INJECTION_PATTERNS = (
    r"(ignore|disregard|forget)\s+(all\s+|any\s+)?(the\s+)?(previous|prior|above)\s+instructions",
    r"reveal\s+(your\s+|the\s+)?(system\s+)?prompt",
    r"you\s+are\s+now\s+(a|an|the)\s+",
)

# What an injected instruction tries to do, by family; looked for in folded text.
INJECTION_FAMILIES = {
    "override": r"\b(ignore|disregard|forget|override|bypass)\b.{0,30}\b(instructions?|rules|guidelines|polic(y|ies)|guardrails)\b",
    "disclosure": r"\b(reveal|show|print|repeat|output|leak)\b.{0,30}\b(system prompt|prompt|hidden instructions?|initial instructions?)\b",
    "persona": r"\byou are now (a|an|the)\b|\b(pretend to be|act as|roleplay as)\b|\b(developer|jailbreak|unrestricted) mode\b",
    "forged_turn": r"(^|\n) ?(system|assistant|developer) ?:|<\|?(system|im_start|endoftext)\|?>|\[/?inst\]|### ?(instruction|system)",
    "tool_abuse": r"\b(call|invoke|run|execute)\b.{0,20}\b(tool|function|command)\b.{0,40}\b(refund|discount|delete|transfer|admin)\b",
}
# Characters that show nothing and split words for a pattern.
UNSEEN = r"[\u00AD\u200B-\u200F\u202A-\u202E\u2060-\u2064\uFEFF]"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def not_blank(col: str | Column) -> Column:
    return F.length(F.trim(F.coalesce(_c(col), F.lit("")))) > 0


def iso_millis(ts: str | Column) -> Column:
    """UTC ISO-8601 text; microseconds are cut, not rounded."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def redact(text: str | Column) -> Column:
    """``struct<text, redacted, method, phone_hits, email_hits, card_hits>``.

    Each pattern sees the text the earlier ones left behind. Null and empty text
    passes through untouched.
    """
    raw = _c(text)
    current = raw
    hits = {}
    for name, (pattern, mark) in REDACTIONS.items():
        unicode_pattern = f"(?U){pattern}"
        hits[name] = F.regexp_count(current, F.lit(unicode_pattern))
        current = F.regexp_replace(current, unicode_pattern, mark)
    empty = raw.isNull() | (raw == "")
    return F.struct(
        current.alias("text"),
        F.coalesce(current != raw, F.lit(False)).alias("redacted"),
        F.when(empty, "noop").otherwise("regex_fallback").alias("method"),
        *[F.coalesce(h, F.lit(0)).cast("long").alias(f"{name}_hits") for name, h in hits.items()],
    )


def claims(text: str | Column, minimum: int = 12) -> Column:
    """Sentences of a reply that are long enough to state something."""
    pieces = F.split(strip(text), r"(?<=[.!?])\s+")
    return F.filter(F.transform(pieces, strip), lambda s: F.length(s) >= minimum)


def strip(text: str | Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(_c(text), r"^\s+|\s+$", "")


def contains_all(text: str | Column, needles: str | Column) -> Column:
    body = F.lower(F.coalesce(_c(text), F.lit("")))
    return F.forall(F.coalesce(_c(needles), F.array().cast("array<string>")), lambda s: F.contains(body, F.lower(s)))


def contains_none(text: str | Column, needles: str | Column) -> Column:
    body = F.lower(F.coalesce(_c(text), F.lit("")))
    return F.forall(F.coalesce(_c(needles), F.array().cast("array<string>")), lambda s: ~F.contains(body, F.lower(s)))


def order_reference(utterance: str | Column, strict: bool = False) -> Column:
    """The first order reference as ``#digits``; null when there is none.

    ``strict`` accepts only a whole number of three to six digits after a ``#`` or
    the word "order", which keeps model numbers and longer digit runs out.
    """
    pattern = r"(?i)(?:#\s*|\border\s+(?:number\s+)?)(\d{3,6})(?!\d)" if strict else ORDER_ID
    digits = F.regexp_extract(_c(utterance), pattern, 1)
    return F.when(digits != "", F.concat(F.lit("#"), digits))


def normalise_order_id(raw: str | Column) -> Column:
    """``4521`` becomes ``#4521``; anything else is left as it came."""
    return F.when(_c(raw).rlike(r"^\d+$"), F.concat(F.lit("#"), _c(raw))).otherwise(_c(raw))


def reply_token(utterance: str | Column) -> Column:
    body = F.lower(_c(utterance))
    rule = F
    for keyword, token in REPLY_KEYWORDS:
        rule = rule.when(F.contains(body, F.lit(keyword)), token)
    return rule.otherwise(REPLY_DEFAULT)


def injection_like(text: str | Column) -> Column:
    return F.coalesce(_c(text), F.lit("")).rlike("(?i)" + "|".join(f"(?:{p})" for p in INJECTION_PATTERNS))


def folded(text: str | Column) -> Column:
    """Lower case without unseen characters, with single blanks; line breaks stay."""
    seen = F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), UNSEEN, "")
    return F.regexp_replace(F.regexp_replace(seen, r"[ \t\r\f\u00A0]+", " "), r"\n+", "\n")


def injection_families(text: str | Column) -> Column:
    """The families of injected instructions in a text, in their order; none for null."""
    body = folded(text)
    found = [F.when(body.rlike(pattern), F.lit(name)) for name, pattern in INJECTION_FAMILIES.items()]
    return F.array_compact(F.array(*found))


def render(template: str | Column, **values: str | Column) -> Column:
    """Fill ``{{KEY}}`` markers of a prompt template with columns."""
    out = F.lit(template) if isinstance(template, str) else template
    for key, value in values.items():
        out = F.replace(out, F.lit("{{" + key + "}}"), F.coalesce(_c(value), F.lit("")))
    return out


def lenient_json(text: str | Column) -> Column:
    """The JSON object inside model output as text, or null when there is none.

    Code fences are removed first; when the rest does not parse, the widest
    ``{...}`` span is tried.
    """
    body = strip(text)
    fenced = body.startswith("```")
    inner = F.regexp_replace(body, "^`+|`+$", "")
    inner = strip(F.regexp_replace(inner, "^(?i:json)", ""))
    candidate = F.when(fenced, inner).otherwise(body)
    span = F.regexp_extract(candidate, r"(?s)\{.*\}", 0)
    return F.when(_is_object(candidate), candidate).when(_is_object(span), span)


def _is_object(text: Column) -> Column:
    kind = F.schema_of_variant(F.try_parse_json(text))
    return F.coalesce(kind.startswith("OBJECT"), F.lit(False))


def model_class(model: str | Column) -> Column:
    return F.when(F.contains(F.lower(_c(model)), F.lit("flash")), "flash").otherwise("pro")


def first_missing_slot(columns: dict[str, Column]) -> Column:
    rule = F
    for slot in SLOT_ORDER:
        rule = rule.when(F.coalesce(columns[slot], F.lit("")) == "", slot)
    return rule.otherwise(F.lit(None).cast("string"))


def words(text: str | Column) -> Column:
    """Lower-cased letter and digit runs."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def unroll(array: str | Column) -> Column:
    """One row per element, for arrays that are costly to build.

    A plain ``explode`` makes the optimizer add size and null checks below the
    generator, which build the array again; the outer form does not. Empty arrays give
    one null row, so callers filter or join on the element.
    """
    return F.explode_outer(_c(array))
