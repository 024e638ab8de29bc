"""Judges, graders and other model hooks as column-in, columns-out steps.

A hook is a plain function over a pandas batch, run by ``mapInPandas``: Spark splits
the rows, a batch that fails is retried row by row, and a row that still fails gets
the failure sentinel instead of failing the job. The built-in rule judge needs no
Python worker at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnledger.functions.scoring import derived_outcome, judge_fields, normal_outcome, routed
from turnledger.functions.text import not_blank, render
from turnledger.schemas import DEFAULT_POLICY

Hook = Callable[[pd.DataFrame], pd.DataFrame]

INPUT_COLUMNS = ("utterance", "response_text", "expected_outcome", "journey")
VERDICT = "task_success string, tone_appropriate string, hallucinated string, judge_cost_usd decimal(18,6)"
NO_VERDICT = {
    "task_success": "error",
    "tone_appropriate": "unknown",
    "hallucinated": "unknown",
    "judge_cost_usd": Decimal(0),
}
# A blank reply is not sent: it has failed.
BLANK_VERDICT = {**NO_VERDICT, "task_success": "failed"}


def run_hook(
    rows: DataFrame, fn: Hook, inputs: Sequence[str], outputs: str, sentinel: Mapping[str, object], batch_rows: int = 256
) -> DataFrame:
    """Add the ``outputs`` columns that ``fn`` computes from the ``inputs`` of a batch.

    ``fn`` must be picklable and return one row per row, in order.
    """
    added = T.StructType.fromDDL(outputs)
    schema = T.StructType(rows.schema.fields + added.fields)
    inputs, names = list(inputs), added.fieldNames()

    def safe(part: pd.DataFrame) -> pd.DataFrame:
        try:
            out = fn(part[inputs]).reset_index(drop=True)
            if len(out) != len(part):
                raise ValueError("a hook must return one row per row")
            return out[names]
        except Exception:
            if len(part) == 1:
                return pd.DataFrame([dict(sentinel)])[names]
        alone = [safe(part.iloc[[i]].reset_index(drop=True)) for i in range(len(part))]
        return pd.concat(alone, ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), batch_rows):
                part = batch.iloc[start : start + batch_rows].reset_index(drop=True)
                yield pd.concat([part, safe(part)], axis=1)

    return rows.mapInPandas(run, schema)


def recorded_judge(rows: DataFrame, texts: DataFrame, key: str = "trace_id") -> DataFrame:
    """Attach verdicts a judge already returned as text (``judge_text``,
    ``judge_cost_micro``). Rows with a blank reply fail without a verdict being read."""
    parsed = texts.select(key, judge_fields(F.col("judge_text")).alias("j"), "judge_cost_micro")
    joined = rows.join(parsed, key, "left")
    asked = not_blank("response_text")

    def pick(name: str, missing: str, blank: str) -> Column:
        return F.when(asked, F.coalesce(F.col(f"j.{name}"), F.lit(missing))).otherwise(blank).alias(name)

    answered = F.coalesce(F.col("j.parsed"), F.lit(False))
    return joined.select(
        *rows.columns,
        pick("task_success", "error", "failed"),
        pick("tone_appropriate", "unknown", "unknown"),
        pick("hallucinated", "unknown", "unknown"),
        F.when(asked & answered, F.col("judge_cost_micro"))
        .otherwise(0)
        .cast("long")
        .alias("judge_cost_micro"),
    )


def rule_judge(rows: DataFrame) -> DataFrame:
    """Deterministic stand-in for the judge's rubric, as plain columns.

    A reply resolves the request when what happened is what was expected, is partial
    when it asks back, and fails otherwise. Refusals and questions never count as
    hallucinations; a reply marked ungrounded does.
    """
    text = F.coalesce("response_text", F.lit(""))
    actual = derived_outcome(text, F.col("escalate"))
    asks = F.trim(text).endswith("?") & (actual != "refused")
    asked = not_blank("response_text")
    success = (
        F.when(~asked, "failed")
        .when(asks, "partial")
        .when(actual == normal_outcome(F.col("expected_outcome")), "resolved")
        .otherwise("failed")
    )
    made_up = (
        F.when(~asked, "unknown").when((actual == "refused") | asks | F.coalesce("grounded", F.lit(False)), "no").otherwise("yes")
    )
    return rows.select(
        "*",
        success.alias("task_success"),
        F.when(asked, "yes").otherwise("unknown").alias("tone_appropriate"),
        made_up.alias("hallucinated"),
        F.lit(0).cast("long").alias("judge_cost_micro"),
    )


def judge_with(rows: DataFrame, fn: Hook, batch_rows: int = 256) -> DataFrame:
    """Score rows with a user-supplied batch judge over the four input columns.

    Rows are read once. Blank replies are never sent; a failed row gets error, unknown,
    unknown and cost 0.
    """
    names = list(NO_VERDICT)

    def tidy(batch: pd.DataFrame) -> pd.DataFrame:
        asked = batch["__asked"].astype(bool)
        verdicts = pd.DataFrame([dict(BLANK_VERDICT)] * len(batch), columns=names)
        if asked.any():
            out = fn(batch.loc[asked, list(INPUT_COLUMNS)].reset_index(drop=True))
            if len(out) != asked.sum():
                raise ValueError("a hook must return one row per row")
            for n in names:
                if n != "judge_cost_usd":
                    verdicts.loc[asked, n] = out[n].astype(str).str.strip().str.lower().to_numpy()
            costs = iter(out["judge_cost_usd"])
            verdicts["judge_cost_usd"] = [
                Decimal(str(round(float(next(costs)), 6))) if a else cost
                for a, cost in zip(asked, verdicts["judge_cost_usd"], strict=True)
            ]
        return verdicts

    marked = rows.withColumn("__asked", not_blank("response_text"))
    return run_hook(marked, tidy, (*INPUT_COLUMNS, "__asked"), VERDICT, NO_VERDICT, batch_rows).drop("__asked")


def classify_with(turns: DataFrame, fn: Hook, inputs: Sequence[str] = ("text",)) -> DataFrame:
    """Route turns with a user-supplied classifier that returns ``intent`` and
    ``confidence``; its output is normalised, and a failed row routes nowhere."""
    raw = run_hook(turns, fn, inputs, "intent string, confidence double", {"intent": None, "confidence": 0.0})
    return raw.select(*turns.columns, routed(F.col("intent"), F.col("confidence")).alias("route"))


def verify_with(
    claims: DataFrame, fn: Hook, keys: Sequence[str] = ("trace_id", "turn"), threshold: float = DEFAULT_POLICY.grounding_threshold
) -> DataFrame:
    """Ground claims with a user-supplied scorer over (claim, context) that returns
    ``grounded``. A claim that could not be checked counts as not grounded."""
    checked = run_hook(claims, fn, ("claim", "context"), "grounded boolean", {"grounded": False})
    score = F.count_if("grounded") / F.count("*")
    return checked.groupBy(*keys).agg(
        F.count("*").alias("claims"),
        score.alias("score"),
        F.when(score >= threshold, "pass").otherwise("fail").alias("verdict"),
    )


def keyword_judge(batch: pd.DataFrame) -> pd.DataFrame:
    """A tiny batch judge for tests and dry runs: looks at the reply text only."""
    reply = batch["response_text"].str.strip()
    return pd.DataFrame(
        {
            "task_success": reply.str.startswith("resp").map({True: "resolved", False: "partial"}),
            "tone_appropriate": "yes",
            "hallucinated": "no",
            "judge_cost_usd": 0.0002,
        }
    )


JUDGE_TEMPLATE = (
    "CUSTOMER: {{UTTERANCE}}\nREPLY: {{RESPONSE}}\nEXPECTED: {{EXPECTED_OUTCOME}}\nJOURNEY: {{JOURNEY}}"
)


def judge_prompts(rows: DataFrame, template: str = JUDGE_TEMPLATE) -> DataFrame:
    """The prompt column an external judge would be sent, for non-blank replies."""
    return rows.where(not_blank("response_text")).select(
        "query_id",
        render(
            template,
            UTTERANCE="utterance",
            RESPONSE="response_text",
            EXPECTED_OUTCOME="expected_outcome",
            JOURNEY="journey",
        ).alias("prompt"),
    )


def judge_parse(texts: DataFrame) -> DataFrame:
    """Verdict fields of raw judge output; unreadable output becomes the sentinel."""
    return texts.select("trace_id", judge_fields(F.col("judge_text")).alias("j")).select("trace_id", "j.*")
