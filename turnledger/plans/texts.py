"""Text jobs over turns, replies and documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.functions import text as fx
from turnledger.functions.scoring import ratio
from turnledger.operators import ordered

PAGE_TURNS = 256

# Phrases a good reply must not contain, and the id prefix per journey.
EVASIONS = ("I don't know", "cannot help")
ID_PREFIX = {"order_status": "ord", "product_qa": "pqa", "service_request": "svc"}


def pii_redaction(rows: DataFrame, key: str, text: str) -> DataFrame:
    return rows.select(key, fx.redact(text).alias("r")).select(key, "r.*")


def claims(turns: DataFrame, minimum: int = 12) -> DataFrame:
    """One row per claim of every agent turn."""
    stated = turns.where(F.col("role") == "agent").select(
        "trace_id", "turn", F.posexplode_outer(fx.claims("text", minimum)).alias("claim_no", "claim")
    )
    return stated.where(F.col("claim").isNotNull())


def content_checks(queries: DataFrame, responses: DataFrame) -> DataFrame:
    rows = queries.join(responses, "trace_id", "left")
    return rows.select(
        "query_id",
        fx.contains_all("response_text", "must_contain").alias("must_contain_ok"),
        fx.contains_none("response_text", "must_not_contain").alias("must_not_contain_ok"),
    )


def injection_flags(messages: DataFrame) -> DataFrame:
    """Messages per channel that look like instructions to the agent."""
    flagged = fx.injection_like("utterance")
    return messages.groupBy("modality").agg(
        F.count("*").alias("messages"),
        F.count_if(flagged).alias("flagged"),
        ratio(F.count_if(flagged), F.count("*")).alias("flag_rate"),
    )


def injection_families(messages: DataFrame) -> DataFrame:
    """Messages per channel and family of injected instruction, with their share of the channel.

    Each message counts once in every family it shows; ``any`` counts it once.
    """
    found = fx.injection_families("utterance")
    rows = messages.select("modality", F.when(F.size(found) > 0, F.concat(found, F.array(F.lit("any")))).alias("found"))
    # one pass: a channel has a row per set of families, then a row per family
    sets = rows.groupBy("modality", "found").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("modality"))
    each = sets.select("modality", "found", "n", total.alias("messages")).select(
        "modality", "messages", "n", F.explode("found").alias("family")
    )
    counted = each.groupBy("modality", "family", "messages").agg(F.sum("n").alias("flagged"))
    return counted.select("modality", "family", "flagged", ratio(F.col("flagged"), F.col("messages")).alias("share"))


def _lines(turn_structs: Column) -> Column:
    return F.array_join(F.transform(turn_structs, lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n")


def transcript(turns: DataFrame, page_turns: int = PAGE_TURNS) -> DataFrame:
    """``role: text`` lines in turn order, in pages of ``page_turns`` turns."""
    page = ordered.page_slice("turn", page_turns).alias("page")
    return (
        turns.groupBy("trace_id", page)
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
        .select("trace_id", "page", F.size("t").cast("long").alias("turns"), _lines(F.col("t")).alias("transcript"))
    )


ROUTER_TEMPLATE = "HISTORY:\n{{HISTORY}}\nUTTERANCE: {{UTTERANCE}}"
NO_HISTORY = "(no prior turns)"


def router_prompts(
    turns: DataFrame, template: str = ROUTER_TEMPLATE, max_turns: int | None = None, page_turns: int = PAGE_TURNS
) -> DataFrame:
    """The routing prompt of every customer turn, with all turns before it or the last
    ``max_turns``.

    Every turn is rendered: whether a turn is routed or handed to a person is for the
    policy to say. Turns are gathered inside pages, and what stands before a page is one text
    per page, so a long conversation spreads over tasks. Without a bound its output is
    quadratic in its turns by nature.
    """
    line = F.struct("role", "text")
    if max_turns is None:
        paged = turns.withColumn("__page", ordered.page_slice("turn", page_turns))
        here = Window.partitionBy("trace_id", "__page").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
        across = Window.partitionBy("trace_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
        earlier = transcript(turns, page_turns).select(
            "trace_id",
            F.col("page").alias("__page"),
            F.array_join(F.collect_list(F.nullif("transcript", F.lit(""))).over(across), "\n").alias("__earlier"),
        )
        inside = paged.withColumn("__inside", _lines(F.collect_list(line).over(here)))
        parts = [F.nullif(F.col(c), F.lit("")) for c in ("__earlier", "__inside")]
        told = inside.join(earlier, ["trace_id", "__page"]).withColumn("history", F.concat_ws("\n", *parts))
    else:
        last = Window.partitionBy("trace_id").orderBy("turn").rowsBetween(-max_turns, -1)
        told = turns.withColumn("history", _lines(F.collect_list(line).over(last)))
    return told.where(F.col("role") == "customer").select(
        "trace_id",
        "turn",
        fx.render(
            template,
            HISTORY=F.when(F.col("history") == "", NO_HISTORY).otherwise(F.col("history")),
            UTTERANCE="text",
        ).alias("prompt"),
    )


# --- slots --------------------------------------------------------------------


def slots_by_rule(utterance: Column) -> dict[str, Column]:
    """Rule version of the slot extractor; a hook may supply the columns instead."""

    def says(pattern: str) -> Column:
        return utterance.rlike(f"(?i){pattern}")

    def first(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(utterance, f"(?i)({pattern})", 1), F.lit(""))

    return {
        "service_type": F.when(says("install"), "installation")
        .when(says("fix|broken|repair"), "repair")
        .when(says("estimate|advice"), "consultation"),
        "preferred_date": first(r"\b(?:next )?(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b"),
        "address": first(r"\[STREET_ADDRESS\]|\b[0-9]+ [a-z]+ (?:street|avenue|road|lane)\b"),
    }


def slot_state(turns: DataFrame, extract: Callable[[Column], dict[str, Column]] = slots_by_rule) -> DataFrame:
    """Known slots after every turn, each carried forward from where it was said."""
    found = turns.select("trace_id", "turn", *[c.alias(n) for n, c in extract(F.col("utterance")).items()])
    slots = [c for c in found.columns if c not in ("trace_id", "turn")]
    known = ordered.carry_forward(found, ["trace_id"], ordered.page_slice("turn", 4096), ["turn"], slots)
    return known.withColumn("missing_slot", fx.first_missing_slot({s: F.col(s) for s in slots}))


# --- labelled set ---------------------------------------------------------------


def label_set(groups: list[tuple[str, DataFrame]]) -> DataFrame:
    """Number, label and concatenate the utterance groups, in order.

    Numbers run per journey along ``seq``; they are counted in slices of 4,096, so the
    largest group is not numbered by one task.
    """
    parts = None
    for journey, rows in groups:
        part = rows.withColumn("journey", F.lit(journey))
        parts = part if parts is None else parts.unionByName(part)
    numbered = ordered.positions(parts, ["journey"], ordered.page_slice("seq", 4096), ["seq"], "number")
    prefix = F
    for journey, short in ID_PREFIX.items():
        prefix = prefix.when(F.col("journey") == journey, short)
    none = F.array().cast("array<string>")
    is_order, is_qa = F.col("journey") == "order_status", F.col("journey") == "product_qa"
    evasions = F.array(*[F.lit(e) for e in EVASIONS])
    return numbered.select(
        F.format_string("%s_%03d", prefix, F.col("number")).alias("query_id"),
        "journey",
        "utterance",
        F.col("journey").alias("expected_intent"),
        "expected_outcome",
        F.when(is_order, F.array(fx.reply_token("utterance"))).otherwise(none).alias("must_contain"),
        F.when(is_order | (is_qa & (F.col("expected_outcome") == "Contained")), evasions)
        .when(is_qa, none)
        .otherwise(F.array(F.lit(EVASIONS[0])))
        .alias("must_not_contain"),
        (F.col("journey") != "service_request").alias("requires_grounding"),
    )


def label_summary(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("journey").agg(
        F.count("*").alias("queries"),
        F.count_if(F.col("expected_outcome") == "Refused").alias("refusals"),
        F.count_if("requires_grounding").alias("grounded"),
    )


def expect_sizes(labelled: DataFrame, sizes: dict[str, int]) -> None:
    """Fail when a group has not the size it must have."""
    found = {r["journey"]: r["queries"] for r in label_summary(labelled).collect()}
    wrong = {j: (found.get(j, 0), n) for j, n in sizes.items() if found.get(j, 0) != n}
    if wrong:
        raise ValueError(f"unexpected group sizes (found, expected): {wrong}")
