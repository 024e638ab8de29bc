"""One DuckDB statement per registered query."""

from __future__ import annotations

import math

from oracles.views import REFUSAL, RUN_METRICS, with_views
from turnledger.schemas import PAYLOAD

_CUST = "'Cust #' || customer_id || ' · ' || upper(tier[1]) || tier[2:]"


GROWTH = (1 + 0.01) / (1 - 0.01)


def _iso(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


_KINDS = "('user_message', 'stt', 'intent_routing', 'retrieval', 'synthesis', 'grounding_verification', 'tts', 'agent_response')"
_SHOWN = (
    "CASE event_type WHEN 'intent_routing' THEN 'router' WHEN 'grounding_verification' THEN 'verification' ELSE event_type END"
)
_SKIPPED = "coalesce(json_extract_string(md, '$.skipped') = 'true', false)"


def _md(name: str) -> str:
    return f"json_extract_string(md, '$.{name}')"


def _mark(modality: str) -> str:
    covering = "('all')" if modality == "all" else f"('{modality}', 'all')"
    return (
        f"coalesce((SELECT max(created_at) FROM v_runs WHERE source = 'production' AND sample_modality IN {covering}), "
        "TIMESTAMP '2024-01-31 00:00:00' - to_hours({hours}))"
    )


def _sample(modality: str, n: int, sample_first: bool, since: str | None = None) -> str:
    user = "('user_message')" if sample_first else "('user_message', 'live_user_transcript')"
    agent = "('agent_response')" if sample_first else "('agent_response', 'live_assistant_text')"
    cond = "" if modality == "all" else f" AND c.modality = '{modality}'"
    blank = "" if sample_first else " AND trim(coalesce(u.t, '')) <> ''"
    return f"""
drawn AS (SELECT c.*, u.t AS utterance FROM v_conv c
  LEFT JOIN (SELECT trace_id, arg_min(input_text, ts) AS t FROM v_events WHERE event_type IN {user} GROUP BY 1) u USING (trace_id)
  WHERE c.created_at > {since or _mark(modality).format(hours=24)}{cond}{blank}
  ORDER BY md5(c.trace_id || '0'), c.trace_id LIMIT {n}),
sampled AS (SELECT d.trace_id, d.modality, d.journey, d.outcome, d.utterance, coalesce(a.t, '') AS response_text,
    coalesce(r.conf, 0.0) AS confidence, coalesce(r.verdict = 'pass', false) AS grounded, d.outcome = 'escalated' AS escalate,
    d.latency_p50_ms AS latency_ms, d.cost_micro, {_iso('d.created_at')} AS created_at
  FROM drawn d
  LEFT JOIN (SELECT trace_id, arg_max(output_text, ts) AS t FROM v_events WHERE event_type IN {agent} GROUP BY 1) a USING (trace_id)
  LEFT JOIN (SELECT trace_id, max(CASE WHEN event_type = 'intent_routing' THEN CAST({_md('confidence')} AS DOUBLE) END) AS conf,
                    arg_max(CASE WHEN event_type = 'grounding_verification' THEN {_md('verdict')} END,
                            CASE WHEN event_type = 'grounding_verification' THEN seq END) AS verdict
             FROM v_events GROUP BY 1) r USING (trace_id)
  WHERE trim(coalesce(d.utterance, '')) <> '')"""


def _rank(p: float, col: str, alias: str) -> str:
    return f"min({col}) FILTER (WHERE rn = CAST(round_even({p}::DOUBLE * (n - 1), 0) AS BIGINT) + 1) AS {alias}"


def _production_run(sample: str, run_id: str) -> str:
    return f"""WITH {sample},
judged AS (SELECT *, trim(response_text) <> '' AS asked, ends_with(trim(response_text), '?') AND trim(response_text) <> '{REFUSAL}' AS asks,
    CASE WHEN trim(response_text) = '{REFUSAL}' THEN 'refused' WHEN escalate THEN 'escalated' ELSE 'contained' END AS actual FROM sampled),
res AS (SELECT '{run_id}' AS run_id, journey, outcome AS derived_outcome, outcome AS expected_outcome, latency_ms, cost_micro,
    NULL::BOOLEAN AS intent_correct, NULL::BOOLEAN AS hit,
    CASE WHEN NOT asked THEN 'failed' WHEN asks THEN 'partial' WHEN actual = outcome THEN 'resolved' ELSE 'failed' END AS task_success,
    CASE WHEN NOT asked THEN 'unknown' WHEN actual = 'refused' OR asks OR grounded THEN 'no' ELSE 'yes' END AS hallucinated FROM judged)
SELECT run_id, sample_size, containment_rate, CAST(NULL AS DOUBLE) AS refusal_precision, CAST(NULL AS DOUBLE) AS intent_accuracy, CAST(NULL AS DOUBLE) AS retrieval_hit_rate,
  hallucination_rate, nullif(task_success_order_status, 0.0) AS task_success_order_status, nullif(task_success_product_qa, 0.0) AS task_success_product_qa,
  nullif(task_success_service_request, 0.0) AS task_success_service_request, latency_p50_ms, latency_p95_ms, cost_per_call_usd,
  queries_order_status, queries_product_qa, queries_service_request, 'production' AS source, 'all' AS sample_modality
FROM ({RUN_METRICS.format(source='res')})"""


_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"

_SCORED = f"""
docs AS (SELECT doc_id AS passage_id, {_WORDS.format('text')} AS w FROM documents),
qs AS (SELECT item_id AS query_id, list_distinct({_WORDS.format('text')}) AS w FROM benchmark),
terms AS (SELECT query_id, len(w) AS qw, unnest(w) AS term FROM qs),
sized AS (SELECT passage_id, len(w) AS dl, len(list_distinct(w)) AS dw FROM docs),
tf AS (SELECT passage_id, term, count(*) AS tf FROM (SELECT passage_id, unnest(w) AS term FROM docs) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
st AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM sized),
scored AS MATERIALIZED (SELECT query_id, passage_id,
    round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * (1.2::DOUBLE + 1) / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS bm25,
    round(count(*) / sqrt(any_value(qw)::DOUBLE * any_value(dw)::DOUBLE), 6) AS semantic, round(count(*) / any_value(qw), 6) AS coverage
  FROM tf JOIN terms USING (term) JOIN df USING (term) JOIN sized USING (passage_id) CROSS JOIN st GROUP BY 1, 2)"""

_RELEVANT = (
    "relevant AS (SELECT b.item_id AS query_id, d.doc_id AS passage_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
)

_ROUTER_TEXT = "'HISTORY:' || chr(10) || {h} || chr(10) || 'UTTERANCE: ' || text"

_ORDER_ID = "regexp_extract(utterance, '#?\\s*(\\d{3,6})', 1)"

_CALLER = "CASE WHEN is_anon THEN {a} ELSE {b} END"


def _decided(policies: str) -> str:
    ok1 = "coalesce(v1 = 'pass' AND s1 >= g, false)"
    ok2 = "coalesce(v2 = 'pass' AND s2 >= g, false)"
    return f"""
SELECT *, CASE WHEN reason = 'grounding_failed' OR (reason IS NULL AND intent = 'out_of_scope') THEN 'refused'
               WHEN reason IS NOT NULL THEN 'escalated' ELSE 'contained' END AS replayed_outcome,
       CASE WHEN reason = 'explicit_request' OR intent = 'escalation' THEN 'escalate' ELSE intent END AS response_intent
FROM (SELECT *, CASE WHEN conf < r THEN 'low_confidence' WHEN intent = 'escalation' THEN 'explicit_request' WHEN intent = 'out_of_scope' THEN NULL
        WHEN turns > 12 THEN 'turn_cap' WHEN tool_error THEN 'tool_error' WHEN {ok1} OR {ok2} THEN NULL ELSE 'grounding_failed' END AS reason
      FROM v_policy, (VALUES {policies}) AS p(r, g))"""


_SLOT = {
    "service_type": "CASE WHEN regexp_matches(utterance, '(?i)install') THEN 'installation' WHEN regexp_matches(utterance, '(?i)fix|broken|repair') THEN 'repair' "
    "WHEN regexp_matches(utterance, '(?i)estimate|advice') THEN 'consultation' END",
    "preferred_date": "nullif(regexp_extract(utterance, '(?i)(\\b(?:next )?(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)\\b)', 1), '')",
    "address": "nullif(regexp_extract(utterance, '(?i)(\\[STREET_ADDRESS\\]|\\b[0-9]+ [a-z]+ (?:street|avenue|road|lane)\\b)', 1), '')",
}

_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"

_PHONE = "'\\b\\d{3}[-.\\s]?\\d{3}[-.\\s]?\\d{4}\\b'"
_EMAIL = "'\\b[\\w.+-]+@[\\w-]+\\.[\\w.-]+\\b'"
_CARD = "'\\b(?:\\d[ -]*?){13,16}\\b'"

def _live(source: str) -> str:
    return f"""
m AS (SELECT *, count(*) FILTER (WHERE kind = 'turn_complete') OVER (PARTITION BY trace_id ORDER BY seq) - CASE WHEN kind = 'turn_complete' THEN 1 ELSE 0 END AS segment,
             count(*) FILTER (WHERE kind = 'interrupted') OVER (PARTITION BY trace_id ORDER BY seq) - CASE WHEN kind = 'interrupted' THEN 1 ELSE 0 END AS era FROM {source}),
u AS (SELECT trace_id, segment, bool_or(kind = 'turn_complete') AS complete,
             {_STRIP.format("coalesce(string_agg(text, '' ORDER BY seq) FILTER (WHERE kind = 'user_fragment'), '')")} AS user_text FROM m GROUP BY 1, 2),
t AS (SELECT *, count(*) FILTER (WHERE user_text <> '') OVER (PARTITION BY trace_id ORDER BY segment) AS turn FROM u WHERE complete),
a AS (SELECT trace_id, segment, era, bool_or(kind = 'interrupted') AS cut,
             {_STRIP.format("coalesce(string_agg(text, '' ORDER BY seq) FILTER (WHERE kind = 'assistant_fragment'), '')")} AS agent_text FROM m GROUP BY 1, 2, 3)"""


_LIVE = _live("v_live")

# Fragments up to the ceiling, and to the close where there is one.
_BOUNDED = f"""
timed AS (SELECT *, ts <= min(ts) OVER (PARTITION BY trace_id) + INTERVAL 600 SECOND AS in_time FROM v_live),
marked AS (SELECT *, in_time AND seq <= coalesce(min(seq) FILTER (WHERE in_time AND kind = 'session_close') OVER (PARTITION BY trace_id), seq) AS inside FROM timed),
inside AS (SELECT trace_id, seq, ts, kind, text FROM marked WHERE inside),
{_live("inside")},
closes AS (SELECT k.trace_id, 'live_session_close' AS event_type, (epoch_us(max(ts) FILTER (WHERE inside)) - epoch_us(min(ts))) // 1000 AS duration_ms,
  greatest(1, coalesce(max(s.turn), 0)) AS turns,
  bool_or(inside AND kind = 'tool_call' AND text = 'escalate_to_human') AS escalated,
  count(*) FILTER (WHERE inside AND kind = 'interrupted') AS interruptions, count(*) FILTER (WHERE inside AND kind = 'tool_call') AS tool_calls,
  (epoch_us(min(ts) FILTER (WHERE inside AND kind = 'assistant_fragment')) - epoch_us(min(ts))) // 1000 AS first_audio_ms,
  count(*) FILTER (WHERE NOT inside) AS late_fragments, max(ts) FILTER (WHERE inside) AS closed_at
  FROM marked k LEFT JOIN (SELECT trace_id, max(turn) AS turn FROM t GROUP BY 1) s USING (trace_id) GROUP BY 1)"""


def _redact(col: str) -> tuple[str, str, str]:
    p1 = f"regexp_replace({col}, {_PHONE}, '[PHONE_NUMBER]', 'g')"
    p2 = f"regexp_replace({p1}, {_EMAIL}, '[EMAIL_ADDRESS]', 'g')"
    return p1, p2, f"regexp_replace({p2}, {_CARD}, '[CREDIT_CARD_NUMBER]', 'g')"


_P1, _P2, _P3 = _redact("text")

_LIVE_TURNS = f"""SELECT trace_id, segment, turn, 'live_user_transcript' AS event_type, {_redact('user_text')[2]} AS text, {_redact('user_text')[2]} <> user_text AS pii_redacted, NULL::VARCHAR AS preview FROM t WHERE user_text <> ''
UNION ALL SELECT a.trace_id, a.segment, t.turn, 'live_assistant_text', a.agent_text, false, NULL FROM a JOIN t ON t.trace_id = a.trace_id AND t.segment = a.segment WHERE NOT a.cut AND a.agent_text <> ''
UNION ALL SELECT trace_id, segment, NULL, 'live_interruption', agent_text, false, substring(agent_text, 1, 200) FROM a WHERE cut"""

_BODIES = {
    "trace_list": f"""SELECT trace_id, {_iso('created_at')} AS started_at, modality, {_CUST} AS customer_label, journey AS intent, journey, outcome,
  turns AS turn_count, latency_p50_ms AS total_latency_ms, cost_usd AS total_cost_usd
FROM (SELECT * FROM v_conv ORDER BY created_at DESC, trace_id LIMIT 200)""",
    "conversation_rollup": f"""SELECT trace_id, arg_max(modality, created_at) AS modality, any_value(customer_id) AS customer_id, any_value(tier) AS tier,
  arg_max(journey, created_at) AS journey, arg_max(outcome, created_at) AS outcome, arg_max(latency_p50_ms, created_at) AS latency_p50_ms,
  CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(cost_micro) AS BIGINT) AS cost_micro, {_iso('min(created_at)')} AS created_at
FROM v_summary_log GROUP BY trace_id""",
    "trace_events": f"""SELECT event_id, trace_id, {_SHOWN} AS event_type, {_iso('ts')} AS "timestamp", latency_ms,
  coalesce(CAST({_md('input_tokens')} AS BIGINT), 0) AS llm_input_tokens, coalesce(CAST({_md('output_tokens')} AS BIGINT), 0) AS llm_output_tokens,
  CAST(coalesce(TRY_CAST({_md('cost_usd')} AS DECIMAL(18,6)), 0) AS DOUBLE) AS llm_cost_usd,
  CASE WHEN event_type = 'user_message' THEN coalesce(input_text, '') WHEN event_type IN ('stt', 'synthesis', 'agent_response') THEN coalesce(output_text, '') END AS text,
  CASE event_type WHEN 'intent_routing' THEN coalesce({_md('model')}, 'gemini-2.0-flash') WHEN 'synthesis' THEN coalesce({_md('model')}, 'gemini-2.0-pro')
       WHEN 'grounding_verification' THEN coalesce({_md('model')}, 'gemini-2.0-pro') END AS model,
  CASE WHEN event_type IN ('intent_routing', 'stt') THEN coalesce(CAST({_md('confidence')} AS DOUBLE), 0.0) END AS confidence,
  CASE WHEN event_type = 'intent_routing' THEN coalesce({_md('intent')}, 'ambiguous') END AS intent,
  CASE WHEN event_type = 'intent_routing' THEN CAST(json_array_length(md, '$.candidates') AS INTEGER) END AS candidate_count,
  CASE WHEN event_type IN ('synthesis', 'grounding_verification') THEN coalesce(CAST({_md('attempt')} AS BIGINT), 1) END AS attempt,
  CASE WHEN event_type = 'grounding_verification' THEN coalesce({_md('verdict')}, 'pass') END AS verdict,
  CASE WHEN event_type = 'grounding_verification' THEN coalesce(CAST({_md('score')} AS DOUBLE), 0.0) END AS score,
  CASE WHEN event_type = 'retrieval' THEN CAST({_md('k')} AS BIGINT) END AS k,
  CASE WHEN event_type = 'retrieval' THEN CAST(json_array_length(md, '$.passages') AS INTEGER) END AS passage_count,
  CASE WHEN event_type = 'intent_routing' THEN CAST({_md('confidence')} AS DOUBLE) < CAST({_md('threshold')} AS DOUBLE) END AS below_threshold,
  CASE WHEN event_type = 'grounding_verification' THEN CAST({_md('attempt')} AS BIGINT) > 1 END AS is_retry,
  CASE WHEN event_type = 'retrieval' THEN {{HIT}} END AS hit
FROM v_events WHERE event_type IN {_KINDS} AND NOT {_SKIPPED}""",
    "trace_events_full": f"""SELECT {_SHOWN} AS event_type, count(*) AS events,
  CAST(sum(coalesce(CAST({_md('input_tokens')} AS BIGINT), 0)) AS BIGINT) AS llm_input_tokens, CAST(sum(latency_ms) AS BIGINT) AS latency_ms
FROM v_events WHERE event_type <> 'debug_probe' AND NOT {_SKIPPED} GROUP BY 1""",
    "trace_detail": f"""WITH e AS (SELECT trace_id, {_SHOWN} AS et, ts, row_number() OVER (PARTITION BY trace_id ORDER BY ts, event_id) AS pos FROM v_events
  WHERE event_type IN {_KINDS} AND NOT {_SKIPPED})
SELECT c.trace_id, c.modality, {_CUST.replace('customer_id', 'any_value(c.customer_id)').replace('tier', 'any_value(c.tier)')} AS customer_label, any_value(c.outcome) AS outcome,
  {_iso('any_value(c.created_at)')} AS started_at, {_iso('coalesce(max(e.ts), any_value(c.created_at))')} AS ended_at, count(e.pos) AS event_count,
  CAST(0 AS BIGINT) AS page, coalesce(string_agg(e.et || '@' || {_iso('e.ts')}, '|' ORDER BY e.pos), '') AS events
FROM v_conv c LEFT JOIN e USING (trace_id) GROUP BY c.trace_id, c.modality""",
    "trace_timeline": """SELECT trace_id, event_id, event_type, latency_ms,
  (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY trace_id))) // 1000 AS offset_ms,
  (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY trace_id ORDER BY ts, event_id))) // 1000 AS gap_ms
FROM v_events""",
    "trace_cost": f"""SELECT trace_id, CAST(sum(coalesce(TRY_CAST({_md('cost_usd')} AS DECIMAL(18,6)), 0)) AS DOUBLE) AS cost_usd,
  count(TRY_CAST({_md('cost_usd')} AS DOUBLE)) AS costed_events FROM v_events GROUP BY 1""",
    "retrieval_hits": "SELECT trace_id, bool_or(h) AS hit, count(*) AS retrievals FROM (SELECT trace_id, {HIT} AS h FROM v_events WHERE event_type = 'retrieval') GROUP BY 1",
    "contract_violations": """SELECT 'conversations' AS table_name, r.rule, r.v AS violations FROM (SELECT
    count(*) FILTER (WHERE NOT regexp_matches(trace_id, '(?i)^trc_[a-z0-9_]+$')) AS a, count(*) FILTER (WHERE modality NOT IN ('voice', 'chat')) AS b,
    count(*) FILTER (WHERE journey NOT IN ('order_status', 'product_qa', 'service_request', 'escalate', 'out_of_scope')) AS c,
    count(*) FILTER (WHERE outcome NOT IN ('contained', 'escalated', 'refused', 'in_progress')) AS d,
    count(*) FILTER (WHERE tier NOT IN ('bronze', 'silver', 'gold')) AS e, count(*) FILTER (WHERE (customer_id IS NULL) <> (tier IS NULL)) AS f,
    count(*) FILTER (WHERE turns < 1) AS g, count(*) FILTER (WHERE latency_p50_ms <= 0) AS h FROM v_conv) x,
  LATERAL (VALUES ('trace_id_pattern', x.a), ('modality_enum', x.b), ('journey_enum', x.c), ('outcome_enum', x.d), ('tier_enum', x.e),
    ('anonymous_without_tier', x.f), ('turns_positive', x.g), ('latency_positive', x.h)) AS r(rule, v)
UNION ALL SELECT 'conversation_traces', r.rule, r.v FROM (SELECT count(*) FILTER (WHERE NOT regexp_matches(trace_id, '(?i)^trc_[a-z0-9_]+$')) AS a,
    count(*) FILTER (WHERE event_type = 'debug_probe') AS b, count(*) FILTER (WHERE NOT json_valid(metadata)) AS c,
    count(*) FILTER (WHERE event_type = 'user_message' AND trim(coalesce(input_text, '')) = '') AS d FROM v_events) x,
  LATERAL (VALUES ('trace_id_pattern', x.a), ('event_type_enum', x.b), ('metadata_json', x.c), ('blank_user_message', x.d)) AS r(rule, v)
UNION ALL SELECT 'conversations', 'trace_id_unique', count(*) FROM (SELECT trace_id FROM v_conv GROUP BY 1 HAVING count(*) > 1)""",
    "quarantined_events": """SELECT event_id, trace_id, event_type, array_to_string(list_filter([
    CASE WHEN NOT regexp_matches(trace_id, '(?i)^trc_[a-z0-9_]+$') THEN 'trace_id_pattern' END, CASE WHEN event_type = 'debug_probe' THEN 'event_type_enum' END,
    CASE WHEN NOT json_valid(metadata) THEN 'metadata_json' END,
    CASE WHEN event_type = 'user_message' AND trim(coalesce(input_text, '')) = '' THEN 'blank_user_message' END], lambda x: x IS NOT NULL), ',') AS violations
FROM v_events WHERE violations <> ''""",
    "undeclared_fields": f"""SELECT event_type, field, count(*) AS events
FROM (SELECT event_type, unnest(json_keys(CASE WHEN json_valid(md) AND json_type(md) = 'OBJECT' THEN md END)) AS field FROM v_events)
WHERE field NOT IN ({', '.join(f"'{n}'" for n in PAYLOAD)}) GROUP BY 1, 2""",
    "load_counts": """SELECT 'conversations' AS table_name, count(*) AS row_count FROM v_conv
UNION ALL SELECT 'conversation_traces', count(*) FROM v_events UNION ALL SELECT 'customers_context', count(*) FROM v_customers
UNION ALL SELECT 'orders', count(*) FROM v_orders UNION ALL SELECT 'eval_runs', count(*) FROM v_runs""",
    "customer_list": f"SELECT customer_id, tier, {_CUST} AS display_label, lifetime_value, open_orders FROM v_customers",
    "recent_orders": f"""SELECT customer_id, CAST(rn AS INTEGER) AS recency, order_id, status, {_iso('order_date')} AS ordered_at
FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY order_date DESC, order_key DESC) AS rn FROM v_orders) WHERE rn <= 3""",
    "order_lookup": f"""SELECT r.request_id, r.order_id, o.status IS NOT NULL AS found, o.customer_id AS owner_id, o.status, {_iso('o.order_date')} AS ordered_at
FROM (SELECT request_id, '#' || {_ORDER_ID} AS order_id FROM v_requests WHERE {_ORDER_ID} <> '') r LEFT JOIN v_orders o USING (order_id)""",
    "order_lookup_strict": f"""SELECT r.request_id, r.order_id, o.status IS NOT NULL AS found, o.customer_id AS owner_id, o.status, {_iso('o.order_date')} AS ordered_at
FROM (SELECT request_id, '#' || x AS order_id FROM (SELECT request_id, regexp_extract(utterance, '(?i)(?:#\\s*|\\border\\s+(?:number\\s+)?)(\\d{{3,6}})(?:\\D|$)', 1) AS x FROM v_requests) WHERE x <> '') r
LEFT JOIN v_orders o USING (order_id)""",
    "customer_context": f"""SELECT c.customer_id, c.tier, 'Cust #' || c.customer_id || ' · ' || upper(c.tier[1]) || c.tier[2:] AS display_label, c.lifetime_value, c.open_orders,
  coalesce(o.n, 0) AS orders, {_iso('o.last_at')} AS last_order_at, coalesce(k.n, 0) AS prior_contacts, k.recent_journey
FROM v_customers c LEFT JOIN (SELECT customer_id, count(*) AS n, max(order_date) AS last_at FROM v_orders GROUP BY 1) o USING (customer_id)
LEFT JOIN (SELECT customer_id, count(*) AS n, arg_max(journey, (created_at, trace_id)) AS recent_journey FROM v_conv WHERE customer_id IS NOT NULL GROUP BY 1) k USING (customer_id)""",
    "customer_attach": """SELECT v.trace_id, v.customer_id, coalesce(c.tier, 'anonymous') AS tier,
  'Cust #' || v.customer_id || ' · ' || upper(c.tier[1]) || c.tier[2:] AS customer_label, c.tier IS NULL AS is_anonymous
FROM v_conv v LEFT JOIN v_customers c USING (customer_id)""",
    "order_status_context": f"""WITH b AS (SELECT *, 'order_id=' || order_id || ', sku=' || sku || ', product_name=' || product_name || ', quantity=' || quantity || ', status=' || status
    || ', order_date=' || strftime(order_date, '%Y-%m-%d %H:%M:%S+00:00') || coalesce(', eta=' || strftime(eta, '%Y-%m-%d %H:%M:%S+00:00'), '') || coalesce(', tracking_no=' || tracking_no, '') AS block FROM v_order_items),
l AS (SELECT customer_id, string_agg('- ' || block, chr(10) ORDER BY rn) AS lines FROM (SELECT customer_id, block, row_number() OVER (PARTITION BY customer_id ORDER BY order_date DESC, order_key DESC) AS rn FROM b) WHERE rn <= 3 GROUP BY 1),
r AS (SELECT request_id, customer_id, CASE WHEN {_ORDER_ID} <> '' THEN '#' || {_ORDER_ID} END AS order_id FROM v_requests),
j AS (SELECT r.*, b.block, b.customer_id AS owner_id, r.customer_id IS NULL AS is_anon,
        coalesce('Recent orders for this customer (most recent first):' || chr(10) || l.lines, '(no orders found for this customer)') AS listing
      FROM r LEFT JOIN b USING (order_id) LEFT JOIN l ON l.customer_id = r.customer_id)
SELECT request_id, customer_id, order_id, CASE WHEN is_anon AND order_id IS NULL THEN 'ask' WHEN is_anon THEN 'by_order_id' ELSE 'recent_for_customer' END AS lookup_mode,
  block IS NOT NULL AS found, coalesce(owner_id = customer_id, false) AS own_order, is_anon AND order_id IS NULL AS awaiting_slot,
  CASE WHEN is_anon AND order_id IS NULL THEN '(no caller identified, no order number provided)'
       WHEN is_anon AND block IS NULL THEN 'The caller asked about order ' || order_id || ', but no order with that ID exists in our system.'
       WHEN is_anon OR owner_id = customer_id THEN 'Recent orders for this customer (most recent first):' || chr(10) || '- ' || block
       WHEN order_id IS NOT NULL THEN 'The customer asked about order ' || order_id || ', but no order with that ID belongs to this customer.' || chr(10) || listing
       ELSE listing END AS context FROM j""",
    "golden_results": "SELECT * EXCLUDE (cost_micro), CAST(CAST(cost_micro / 1e6 AS DECIMAL(18,6)) AS DOUBLE) AS cost_usd FROM v_golden",
    "golden_eval": RUN_METRICS.format(source="v_golden"),
    "task_success": """SELECT run_id, journey, count(*) AS query_count,
  sum(CASE task_success WHEN 'resolved' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) / count(*) AS task_success FROM v_results GROUP BY 1, 2""",
    "latency_percentiles": f"""SELECT journey, any_value(n) AS measured, {_rank(0.5, 'latency_p50_ms', 'latency_p50_ms')}, {_rank(0.95, 'latency_p50_ms', 'latency_p95_ms')}
FROM (SELECT journey, latency_p50_ms, row_number() OVER (PARTITION BY journey ORDER BY latency_p50_ms) AS rn, count(*) OVER (PARTITION BY journey) AS n FROM v_conv WHERE latency_p50_ms > 0) GROUP BY 1""",
    "judge_rates": """SELECT run_id, coalesce(count(*) FILTER (WHERE tone_appropriate = 'yes') / nullif(count(*) FILTER (WHERE tone_appropriate IN ('yes', 'no')), 0), 0.0) AS tone_rate,
  count(*) FILTER (WHERE grounded) / count(*) AS grounded_rate, count(*) FILTER (WHERE outcome_correct) / count(*) AS outcome_correct_rate,
  count(*) FILTER (WHERE must_contain_ok AND must_not_contain_ok) / count(*) AS content_ok_rate, count(error) AS errors FROM v_golden GROUP BY 1""",
    "intent_confusion": "SELECT expected_intent, response_intent, count(*) AS queries FROM v_results GROUP BY 1, 2",
    "content_checks": """SELECT query_id, len(list_filter(must_contain, lambda s: NOT contains(lower(coalesce(response_text, '')), lower(s)))) = 0 AS must_contain_ok,
  len(list_filter(must_not_contain, lambda s: contains(lower(coalesce(response_text, '')), lower(s)))) = 0 AS must_not_contain_ok
FROM v_queries LEFT JOIN v_responses USING (trace_id)""",
    "judge_prompts": """SELECT query_id, 'CUSTOMER: ' || utterance || chr(10) || 'REPLY: ' || response_text || chr(10) || 'EXPECTED: ' || expected_outcome || chr(10) || 'JOURNEY: ' || journey AS prompt
FROM v_queries JOIN v_responses USING (trace_id) WHERE trim(response_text) <> ''""",
    "judge_parse": "SELECT trace_id, task_success, tone_appropriate, hallucinated, parsed FROM v_judged",
    "judge_hook": """SELECT journey, CASE WHEN trim(response_text) = '' THEN 'failed' WHEN starts_with(trim(response_text), 'resp') THEN 'resolved' ELSE 'partial' END AS task_success,
  CASE WHEN trim(response_text) = '' THEN 'unknown' ELSE 'no' END AS hallucinated, count(*) AS queries,
  CAST(sum(CASE WHEN trim(response_text) = '' THEN 0 ELSE CAST(0.0002 AS DECIMAL(18,6)) END) AS DOUBLE) AS judge_cost_usd
FROM v_queries JOIN v_responses USING (trace_id) GROUP BY 1, 2, 3""",
    "production_sample": f"WITH {_sample('voice', 50, False)} SELECT * FROM sampled",
    "production_sample_first": f"WITH {_sample('voice', 50, True)} SELECT * FROM sampled",
    "production_eval": _production_run(_sample("all", 50, False), "evr_prod"),
    "batch_preview": " UNION ALL ".join(
        f"SELECT '{m}' AS modality, {_iso(_mark(m).format(hours=168))} AS since_at, "
        f"(SELECT count(*) FROM v_conv WHERE created_at > {_mark(m).format(hours=168)}{'' if m == 'all' else chr(32) + 'AND modality = ' + chr(39) + m + chr(39)}) AS new_count"
        for m in ("voice", "chat", "all")
    ),
    "stratified_sample": """SELECT modality, journey, CAST(rn AS INTEGER) AS sample_rank, trace_id, outcome
FROM (SELECT *, row_number() OVER (PARTITION BY modality, journey ORDER BY md5(trace_id || '0'), trace_id) AS rn FROM v_conv) WHERE rn <= 5""",
    "eval_run_list": "SELECT * EXCLUDE (created_at) FROM v_listed",
    "latest_run": """SELECT run_id, source, run_timestamp, containment_rate, (SELECT max(run_id) FROM v_listed) AS greatest_run_id
FROM v_listed ORDER BY source = 'golden' DESC, created_at DESC, run_id DESC LIMIT 1""",
    "eval_metrics_long": "SELECT * EXCLUDE (created_at) FROM v_long",
    "metric_trend": """SELECT metric_name, journey, run_id, metric_value, CAST(row_number() OVER o AS INTEGER) AS run_number, count(*) OVER w AS runs,
  round(metric_value - lag(metric_value) OVER o, 9) AS delta,
  round((metric_value - min(metric_value) OVER w) / coalesce(nullif(max(metric_value) OVER w - min(metric_value) OVER w, 0.0), 1.0), 9) AS point,
  last_value(metric_value) OVER a >= first_value(metric_value) OVER a AS rising
FROM v_long WHERE source = 'golden'
WINDOW w AS (PARTITION BY metric_name, journey), o AS (PARTITION BY metric_name, journey ORDER BY created_at, run_id),
  a AS (PARTITION BY metric_name, journey ORDER BY created_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "run_compare": """WITH pair AS (SELECT run_id, row_number() OVER (ORDER BY created_at DESC, run_id DESC) AS rn FROM v_listed WHERE source = 'golden')
SELECT metric_name, journey, max(metric_value) FILTER (WHERE rn = 2) AS base_value, max(metric_value) FILTER (WHERE rn = 1) AS new_value,
  round(max(metric_value) FILTER (WHERE rn = 1) - max(metric_value) FILTER (WHERE rn = 2), 9) AS change
FROM v_long JOIN pair USING (run_id) WHERE rn <= 2 GROUP BY 1, 2""",
    "metric_gate": """WITH s AS (SELECT run_id, metric_name, journey, metric_value, lag(metric_value) OVER (PARTITION BY metric_name, journey ORDER BY created_at, run_id) AS previous FROM v_long WHERE source = 'golden'),
t AS (SELECT r.run_id, x.* FROM (SELECT DISTINCT run_id FROM s) r, (VALUES ('intent_accuracy', NULL, '>=', 0.85::DOUBLE), ('retrieval_hit_rate_at_5', NULL, '>=', 0.8),
  ('hallucination_rate_post_verifier', NULL, '<=', 0.05), ('containment', NULL, '>=', 0.6), ('task_success', 'order_status', '>=', 0.85), ('task_success', 'product_qa', '>=', 0.7),
  ('task_success', 'service_request', '>=', 0.5), ('latency_p95_ms', NULL, '<=', 4000.0)) AS x(metric_name, journey, direction, bound))
SELECT t.run_id, t.metric_name, t.journey, t.direction, t.bound, s.metric_value, s.previous AS previous_value,
  CASE WHEN s.metric_value IS NULL THEN 'n/a' WHEN (t.direction = '>=' AND s.metric_value >= t.bound) OR (t.direction = '<=' AND s.metric_value <= t.bound) THEN 'pass' ELSE 'fail' END AS status,
  coalesce(CASE WHEN t.direction = '>=' THEN s.metric_value < s.previous - abs(s.previous) * 0.02::DOUBLE ELSE s.metric_value > s.previous + abs(s.previous) * 0.02::DOUBLE END, false) AS regressed
FROM t LEFT JOIN s ON s.run_id = t.run_id AND s.metric_name = t.metric_name AND s.journey IS NOT DISTINCT FROM t.journey""",
    "failure_clusters": """SELECT run_id, cluster, list_position(['wrong_intent', 'retrieval_miss', 'hallucination', 'refused_correctly', 'refused_incorrectly', 'incomplete', 'other'], cluster)::BIGINT AS priority,
  count(*) AS failures, CAST(sum(count(*)) OVER (PARTITION BY run_id) AS BIGINT) AS total_failures, count(*) / sum(count(*)) OVER (PARTITION BY run_id) AS share
FROM v_failures GROUP BY run_id, cluster""",
    "failure_examples": """SELECT cluster, CAST(rn AS INTEGER) AS example_rank, query_id, utterance, response_text, expected_outcome, derived_outcome, task_success, hallucinated, intent_correct
FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY query_id) AS rn FROM v_failures) WHERE rn <= 5""",
    "cluster_readout": "SELECT * REPLACE (array_to_string(sample_trace_ids, ',') AS sample_trace_ids) FROM v_readout",
    "cluster_drill": """SELECT r.cluster_id, r.failure_type, c.trace_id, c.modality, c.journey, c.outcome
FROM (SELECT cluster_id, failure_type, unnest(sample_trace_ids) AS trace_id FROM v_readout) r JOIN v_conv c USING (trace_id)""",
    "policy_replay": f"""SELECT trace_id, outcome, replayed_outcome, coalesce(reason, 'none') AS reason, response_intent,
  CASE WHEN response_intent IN ('order_status', 'product_qa', 'service_request') THEN response_intent ELSE 'out_of_scope' END AS replayed_journey
FROM ({_decided('(0.6::DOUBLE, 0.8::DOUBLE)')})""",
    "policy_sweep": f"""SELECT r AS router_threshold, g AS grounding_threshold, count(*) AS traces, count(*) FILTER (WHERE replayed_outcome = 'contained') / count(*) AS contained_rate,
  count(*) FILTER (WHERE replayed_outcome = 'escalated') / count(*) AS escalated_rate, count(*) FILTER (WHERE replayed_outcome = 'refused') / count(*) AS refused_rate
FROM ({_decided(', '.join(f'({r}::DOUBLE, {g}::DOUBLE)' for r in (0.5, 0.6, 0.7, 0.8) for g in (0.7, 0.8, 0.95)))}) GROUP BY 1, 2""",
    "verifier_rates": f"""SELECT attempt, count(*) AS checks, count(*) FILTER (WHERE rej) AS rejections, count(*) FILTER (WHERE rej) / count(*) AS rejection_rate,
  count(*) FILTER (WHERE rej AND verdict = 'pass') AS overridden
FROM (SELECT CAST({_md('attempt')} AS BIGINT) AS attempt, {_md('verdict')} AS verdict, NOT ({_md('verdict')} = 'pass' AND CAST({_md('score')} AS DOUBLE) >= 0.8) AS rej
      FROM v_events WHERE event_type = 'grounding_verification') GROUP BY 1""",
    "escalation_reasons": f"""SELECT coalesce({_md('reason')}, 'unknown') AS reason, count(*) AS escalations, count(*) / sum(count(*)) OVER () AS share,
  count(*) / (SELECT count(*) FROM v_conv) AS rate FROM v_events WHERE event_type = 'escalation' GROUP BY 1""",
    "failure_bursts": """WITH e AS (SELECT *, count(*) FILTER (WHERE NOT failed) OVER (PARTITION BY service ORDER BY us, event_id) AS era FROM v_signals)
SELECT service, event_id, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS "timestamp", failures_in_window
FROM (SELECT *, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY service, era ORDER BY us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS BIGINT) AS failures_in_window FROM e)
WHERE failed AND failures_in_window >= 3""",
    "cost_ledger": f"""SELECT {_md('model')} AS model, event_type AS stage, count(*) AS calls, CAST(sum(CAST({_md('input_tokens')} AS BIGINT)) AS BIGINT) AS input_tokens,
  CAST(sum(CAST({_md('output_tokens')} AS BIGINT)) AS BIGINT) AS output_tokens,
  CAST(sum(coalesce(TRY_CAST({_md('cost_usd')} AS DECIMAL(18,6)), 0)) AS DOUBLE) AS recorded_cost_usd,
  CAST(sum(CAST((CASE WHEN contains({_md('model')}, 'flash') THEN CAST({_md('input_tokens')} AS BIGINT) * 300 + CAST({_md('output_tokens')} AS BIGINT) * 2500
      ELSE CAST({_md('input_tokens')} AS BIGINT) * 1250 + CAST({_md('output_tokens')} AS BIGINT) * 10000 END) AS DECIMAL(18,0))) AS DOUBLE) / 1e9 AS list_cost_usd
FROM v_events WHERE event_type IN ('intent_routing', 'synthesis', 'grounding_verification') GROUP BY 1, 2""",
    "outcome_matrix": "SELECT modality, outcome, count(*) AS conversations FROM v_conv GROUP BY 1, 2",
    "outcome_windows": """SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M:%S') AS window_start, modality, count(*) AS conversations,
  count(*) FILTER (WHERE outcome = 'contained') AS contained, count(*) FILTER (WHERE outcome = 'escalated') AS escalated, count(*) FILTER (WHERE outcome = 'refused') AS refused,
  count(*) FILTER (WHERE outcome = 'refused') / count(*) AS refusal_rate FROM v_conv GROUP BY 1, 2""",
    "refusal_spikes": """WITH w AS (SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M:%S') AS window_start, modality, count(*) AS conversations,
  count(*) FILTER (WHERE outcome = 'refused') AS refused FROM v_conv GROUP BY 1, 2),
u AS (SELECT modality, count(*) FILTER (WHERE outcome = 'refused') / count(*) AS usual_rate FROM v_conv GROUP BY 1)
SELECT window_start, modality, conversations, refused, refused / conversations AS refusal_rate, usual_rate
FROM w JOIN u USING (modality) WHERE refused >= 5 AND refused / conversations > 2 * usual_rate""",
    "refusal_alerts": f"""WITH RECURSIVE w AS (SELECT date_trunc('hour', created_at) AS ts, epoch(date_trunc('hour', created_at)) AS start, modality, count(*) AS conversations,
  count(*) FILTER (WHERE outcome = 'refused') AS refused FROM v_conv GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY modality ORDER BY start) AS rn FROM w),
f AS (SELECT ts, start, modality, conversations, refused, rn, 0::DOUBLE AS r, 0::DOUBLE AS c FROM o WHERE rn = 1
  UNION ALL SELECT o.ts, o.start, o.modality, o.conversations, o.refused, o.rn, (f.r + f.refused) * pow(0.5::DOUBLE, (o.start - f.start) / 3600 / 24),
    (f.c + f.conversations) * pow(0.5::DOUBLE, (o.start - f.start) / 3600 / 24) FROM f JOIN o ON o.modality = f.modality AND o.rn = f.rn + 1)
SELECT {_iso('ts')} AS window_start, modality, conversations, refused, round(refused / conversations, 9) AS refusal_rate, round(r / c, 9) AS usual_rate
FROM f WHERE c >= 20 AND refused >= 5 AND refused / conversations > 2 * (r / c)""",
    "latency_rolling": f"""WITH b AS (SELECT date_trunc('hour', created_at) AS h, modality, CAST(ceil(ln(latency_p50_ms::DOUBLE) / {math.log(GROWTH)!r}::DOUBLE) AS INTEGER) AS bucket, count(*) AS n
  FROM v_conv WHERE latency_p50_ms > 0 GROUP BY 1, 2, 3),
k AS (SELECT DISTINCT h, modality FROM b),
m AS (SELECT k.h, k.modality, bucket, sum(n) AS n FROM k JOIN b ON b.modality = k.modality AND b.h <= k.h AND b.h > k.h - INTERVAL 24 HOUR GROUP BY 1, 2, 3),
c AS (SELECT *, sum(n) OVER (PARTITION BY h, modality ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY h, modality) AS total FROM m)
SELECT {_iso('h')} AS window_start, modality, CAST(sum(n) AS BIGINT) AS measured,
  {", ".join(f"round(2 * pow({GROWTH!r}::DOUBLE, min(bucket) FILTER (WHERE upto >= round_even({p}::DOUBLE * (total - 1), 0) + 1)) / ({GROWTH!r}::DOUBLE + 1), 3) AS {n}" for n, p in (("latency_p50_ms", 0.5), ("latency_p95_ms", 0.95)))}
FROM c GROUP BY 1, 2""",
    "conversation_kpis": """SELECT modality, count(*) AS conversations, count(*) FILTER (WHERE outcome = 'contained') / count(*) AS containment_rate,
  count(*) FILTER (WHERE outcome = 'escalated') / count(*) AS escalation_rate, count(*) FILTER (WHERE outcome = 'refused') / count(*) AS refusal_rate,
  sum(turns) FILTER (WHERE outcome = 'contained') / count(*) FILTER (WHERE outcome = 'contained') AS turns_to_resolution,
  count(*) FILTER (WHERE customer_id IS NULL) AS anonymous FROM v_conv GROUP BY 1""",
    "daily_cost": """SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS conversations, CAST(sum(cost_micro) AS BIGINT) AS cost_micro, sum(cost_micro) / 1e6 AS cost_usd FROM v_conv GROUP BY 1""",
    "business_readout": """WITH ch AS (SELECT channel, count(*) AS n, count(*) FILTER (WHERE outcome = 'contained') / count(*) AS containment
  FROM (SELECT modality AS channel, outcome FROM v_conv UNION ALL SELECT 'all', outcome FROM v_conv) GROUP BY 1),
p AS (SELECT * FROM (VALUES ('voice', 60000000, 6), ('chat', 40000000, 4), ('all', 100000000, 6)) AS t(channel, volume, minutes)),
x AS (SELECT ch.*, CAST(floor(containment * volume + 0.5::DOUBLE) AS BIGINT) AS contained_calls, 0.85::DOUBLE * minutes AS agent_cost_per_call,
  coalesce((SELECT cost_per_call_usd FROM v_runs ORDER BY created_at DESC, run_id DESC LIMIT 1), 0.0014::DOUBLE) AS llm_cost_per_call FROM ch JOIN p USING (channel))
SELECT *, round(contained_calls * (agent_cost_per_call - llm_cost_per_call), 2) AS displaced_cost_usd FROM x""",
    "containment_sensitivity": """WITH ch AS (SELECT channel, count(*) FILTER (WHERE outcome = 'contained') / count(*) AS containment
  FROM (SELECT modality AS channel, outcome FROM v_conv UNION ALL SELECT 'all', outcome FROM v_conv) GROUP BY 1),
p AS (SELECT * FROM (VALUES ('voice', 60000000, 6), ('chat', 40000000, 4), ('all', 100000000, 6)) AS t(channel, volume, minutes)),
x AS (SELECT channel, points, containment, volume * points / 100.0::DOUBLE AS calls, volume * points / 100.0::DOUBLE * minutes AS mins FROM ch JOIN p USING (channel), (SELECT unnest(generate_series(-5, 5)) AS points))
SELECT channel, points, round(containment + points / 100.0::DOUBLE, 6) AS containment, round(calls / 365.0::DOUBLE, 2) AS contacts_per_day, round(mins / 365.0::DOUBLE, 2) AS minutes_per_day,
  round(mins * 0.85::DOUBLE / 365.0::DOUBLE, 2) AS usd_per_day, round(mins * 0.85::DOUBLE, 2) AS usd_per_year FROM x""",
    "intent_drift": """WITH x AS (SELECT journey AS intent, count(*) FILTER (WHERE created_at < TIMESTAMP '2024-01-16') AS before, count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-01-16') AS after FROM v_conv GROUP BY 1),
y AS (SELECT *, before / sum(before) OVER () AS p, after / sum(after) OVER () AS q FROM x)
SELECT intent, before, after, p, q, CASE WHEN p > 0 AND q > 0 THEN round((q - p) * ln(q / p), 9) END AS psi_part FROM y""",
    "pii_redaction": f"""SELECT doc_id AS passage_id, {_P3} AS text, {_P3} <> text AS redacted, CASE WHEN text IS NULL OR text = '' THEN 'noop' ELSE 'regex_fallback' END AS method,
  len(regexp_extract_all(text, {_PHONE})) AS phone_hits, len(regexp_extract_all({_P1}, {_EMAIL})) AS email_hits, len(regexp_extract_all({_P2}, {_CARD})) AS card_hits FROM documents""",
    "claims": f"""WITH s AS (SELECT trace_id, turn, list_filter(list_transform(string_split(regexp_replace({_STRIP.format('text')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
    lambda x: {_STRIP.format('x')}), lambda x: length(x) >= 12) AS c FROM v_turns WHERE role = 'agent')
SELECT trace_id, turn, i - 1 AS claim_no, c[i] AS claim FROM (SELECT *, unnest(generate_series(1, len(c))) AS i FROM s)""",
    "injection_families": """WITH f AS (SELECT modality, regexp_replace(lower(utterance), '\\s+', ' ', 'g') AS u FROM v_messages),
t AS (SELECT modality, count(*) AS n FROM f GROUP BY 1),
h AS (SELECT modality, 'override' AS family FROM f WHERE regexp_matches(u, 'ignore.{0,30}instructions')
  UNION ALL SELECT modality, 'disclosure' FROM f WHERE regexp_matches(u, 'reveal.{0,30}prompt')
  UNION ALL SELECT modality, 'any' FROM f WHERE regexp_matches(u, 'ignore.{0,30}instructions|reveal.{0,30}prompt'))
SELECT modality, family, count(*) AS flagged, count(*) / any_value(n) AS share FROM h JOIN t USING (modality) GROUP BY 1, 2""",
    "injection_flags": """SELECT modality, count(*) AS messages, count(*) FILTER (WHERE f) AS flagged, count(*) FILTER (WHERE f) / count(*) AS flag_rate
FROM (SELECT modality, regexp_matches(utterance, '(?i)((ignore|disregard|forget)\\s+(all\\s+|any\\s+)?(the\\s+)?(previous|prior|above)\\s+instructions|reveal\\s+(your\\s+|the\\s+)?(system\\s+)?prompt|you\\s+are\\s+now\\s+(a|an|the)\\s+)') AS f FROM v_messages) GROUP BY 1""",
    "transcript": """SELECT trace_id, turn // 256 AS page, count(*) AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM v_turns GROUP BY 1, 2""",
    "router_prompts": f"""SELECT trace_id, turn, {_ROUTER_TEXT.format(h="coalesce(h, '(no prior turns)')")} AS prompt
FROM (SELECT *, string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY trace_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM v_turns) WHERE role = 'customer'""",
    "slot_state": f"""WITH f AS (SELECT trace_id, turn, {', '.join(f'{sql} AS {n}' for n, sql in _SLOT.items())} FROM v_service_turns),
k AS (SELECT trace_id, turn, {', '.join(f'last_value({n} IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {n}' for n in _SLOT)} FROM f)
SELECT *, CASE WHEN service_type IS NULL THEN 'service_type' WHEN preferred_date IS NULL THEN 'preferred_date' WHEN address IS NULL THEN 'address' END AS missing_slot FROM k""",
    "label_set": """WITH g AS (SELECT 'order_status' AS journey, 'ord' AS px, CAST(substring(request_id, 5) AS BIGINT) AS seq, utterance, 'Contained' AS expected_outcome FROM v_requests
UNION ALL SELECT 'product_qa', 'pqa', item_id, text, CASE WHEN item_id % 5 < 2 THEN 'Refused' ELSE 'Contained' END FROM benchmark
UNION ALL SELECT 'service_request', 'svc', seq, utterance, 'Contained' FROM v_service_turns)
SELECT px || '_' || CASE WHEN rn < 1000 THEN lpad(CAST(rn AS VARCHAR), 3, '0') ELSE CAST(rn AS VARCHAR) END AS query_id, journey, utterance, journey AS expected_intent, expected_outcome,
  CASE WHEN journey <> 'order_status' THEN '' WHEN contains(lower(utterance), 'cancel') THEN 'cancel' WHEN contains(lower(utterance), 'return') THEN 'return'
       WHEN contains(lower(utterance), 'address') THEN 'address' WHEN contains(lower(utterance), 'tracking') THEN 'track' ELSE 'order' END AS must_contain,
  CASE WHEN journey = 'order_status' OR (journey = 'product_qa' AND expected_outcome = 'Contained') THEN 'I don''t know|cannot help' WHEN journey = 'product_qa' THEN '' ELSE 'I don''t know' END AS must_not_contain,
  journey <> 'service_request' AS requires_grounding
FROM (SELECT *, row_number() OVER (PARTITION BY journey ORDER BY seq) AS rn FROM g)""",
    "label_summary": """SELECT 'order_status' AS journey, count(*) AS queries, CAST(0 AS BIGINT) AS refusals, count(*) AS grounded FROM v_requests
UNION ALL SELECT 'product_qa', count(*), count(*) FILTER (WHERE item_id % 5 < 2), count(*) FROM benchmark
UNION ALL SELECT 'service_request', count(*), 0, 0 FROM v_service_turns""",
    "bm25_search": f"""WITH {_SCORED} SELECT query_id, passage_id, bm25, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, passage_id) AS rank FROM scored) WHERE rank <= 10""",
    "passage_context": f"""WITH {_SCORED},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, passage_id) AS rank FROM scored)
SELECT query_id, count(*) AS passages, 'Knowledge base passages (authoritative):' || chr(10) || string_agg('[' || rank || '] source=' || coalesce(d.source, '') || ' score='
  || CAST(CAST(CAST(bm25 AS DECIMAL(18,6)) AS DECIMAL(18,2)) AS VARCHAR) || chr(10) || '    ' || coalesce(d.text, ''), chr(10) ORDER BY rank) AS context
FROM r JOIN documents d ON d.doc_id = r.passage_id WHERE rank <= 3 GROUP BY 1""",
    "hybrid_search": f"""WITH {_SCORED},
r AS (SELECT query_id, passage_id, coverage, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, passage_id) AS bm25_rank,
  row_number() OVER (PARTITION BY query_id ORDER BY semantic DESC, passage_id) AS semantic_rank FROM scored),
f AS (SELECT query_id, passage_id, bm25_rank, semantic_rank, round(1.0::DOUBLE / (60 + bm25_rank) + 1.0::DOUBLE / (60 + semantic_rank), 9) AS fused_score, coverage AS rerank_score FROM r),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, passage_id) AS fused_rank FROM f) WHERE fused_rank <= 20)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_rank) AS rank FROM h) WHERE rank <= 5""",
    "retrieval_quality": f"""WITH {_SCORED}, {_RELEVANT},
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, passage_id) AS rank FROM scored),
j AS (SELECT r.query_id, min(rk.rank) FILTER (WHERE rk.rank <= 10) AS rank FROM relevant r LEFT JOIN rk USING (query_id, passage_id) GROUP BY 1)
SELECT count(*) AS queries, round(sum(coalesce(1.0::DOUBLE / rank, 0)) / count(*), 9) AS mrr, count(*) FILTER (WHERE rank <= 1) / count(*) AS hit_at_1,
  count(*) FILTER (WHERE rank <= 5) / count(*) AS hit_at_5, count(*) FILTER (WHERE rank <= 10) / count(*) AS hit_at_10 FROM j""",
    "relevance_pairs": f"WITH {_RELEVANT} SELECT * FROM relevant",
    "vector_search": """WITH x AS (SELECT vec_id, label, unnest(generate_series(1, len(embedding))) AS i, embedding FROM embeddings),
y AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS v FROM x),
c AS (SELECT label AS query_id, i, avg(v) AS c FROM y GROUP BY 1, 2),
s AS (SELECT query_id, vec_id, round(sum(v * c) / (sqrt(sum(v * v)) * sqrt(sum(c * c))), 6) AS similarity FROM y JOIN c ON c.i = y.i GROUP BY 1, 2)
SELECT query_id, vec_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "grounding_check": f"""WITH s AS (SELECT trace_id, turn, list_filter(list_transform(string_split(regexp_replace({_STRIP.format('text')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
    lambda x: {_STRIP.format('x')}), lambda x: length(x) >= 12) AS c FROM v_turns WHERE role = 'agent'),
cl AS (SELECT trace_id, turn, i, unnest(list_distinct({_WORDS.format('c[i]')})) AS word FROM (SELECT *, unnest(generate_series(1, len(c))) AS i FROM s)),
ctx AS (SELECT DISTINCT trace_id, unnest({_WORDS.format('text')}) AS word FROM v_turns WHERE role = 'context'),
g AS (SELECT cl.trace_id, turn, i, count(ctx.word) >= 0.6::DOUBLE * count(*) AS ok FROM cl LEFT JOIN ctx ON ctx.trace_id = cl.trace_id AND ctx.word = cl.word GROUP BY 1, 2, 3),
t AS (SELECT trace_id, turn, count(*) FILTER (WHERE ok) AS supported FROM g GROUP BY 1, 2)
SELECT s.trace_id, s.turn, len(s.c) AS claims, coalesce(t.supported, 0) AS supported, CASE WHEN len(s.c) = 0 THEN 1.0::DOUBLE ELSE coalesce(t.supported, 0) / len(s.c) END AS score,
  CASE WHEN len(s.c) = 0 OR coalesce(t.supported, 0) / len(s.c) >= 0.8 THEN 'pass' ELSE 'fail' END AS verdict
FROM s LEFT JOIN t ON t.trace_id = s.trace_id AND t.turn = s.turn""",
    "live_turns": f"""WITH {_LIVE}
{_LIVE_TURNS}""",
    "live_session_kpis": f"""WITH {_LIVE},
s AS (SELECT l.trace_id, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS duration_ms,
  greatest(1, coalesce((SELECT max(turn) FROM t WHERE t.trace_id = l.trace_id), 0)) AS turns,
  count(*) FILTER (WHERE kind = 'interrupted') AS cuts, count(*) FILTER (WHERE kind = 'tool_call') AS tools FROM v_live l GROUP BY 1),
r AS (SELECT duration_ms, row_number() OVER (ORDER BY duration_ms) AS rn, count(*) OVER () AS n FROM s)
SELECT count(*) AS sessions, sum(turns) / count(*) AS turns_per_session, count(*) FILTER (WHERE cuts > 0) / count(*) AS barge_in_rate, CAST(sum(tools) AS BIGINT) AS tool_calls,
  count(*) FILTER (WHERE duration_ms > 600000) AS over_ceiling,
  (SELECT {_rank(0.5, 'duration_ms', 'x')[:-5]} FROM r) AS duration_p50_ms, (SELECT {_rank(0.95, 'duration_ms', 'x')[:-5]} FROM r) AS duration_p95_ms FROM s""",
    "live_session_close": f"""WITH {_BOUNDED}
SELECT * EXCLUDE (closed_at), CASE WHEN escalated THEN 'escalated' ELSE 'contained' END AS outcome, {_iso('closed_at')} AS closed_at FROM closes""",
    "live_session_summaries": f"""WITH {_BOUNDED}
SELECT trace_id, 'voice' AS modality, NULL::VARCHAR AS customer_id, NULL::VARCHAR AS tier, NULL::VARCHAR AS journey,
  CASE WHEN escalated THEN 'escalated' ELSE 'contained' END AS outcome, turns, duration_ms AS latency_p50_ms, 0::BIGINT AS cost_micro, {_iso('closed_at')} AS created_at FROM closes""",
    "live_tool_mix": f"""WITH {_BOUNDED}
SELECT text AS tool_name, count(*) AS calls, count(DISTINCT trace_id) AS sessions, count(*) / (SELECT count(*) FROM inside WHERE kind = 'tool_call') AS share
FROM inside WHERE kind = 'tool_call' GROUP BY 1""",
    "log_store": """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date, event_type, count(*) AS events, count(DISTINCT trace_id) AS traces,
  CAST(sum(latency_ms) AS BIGINT) AS latency_ms, count(*) FILTER (WHERE pii_redacted) AS redacted,
  CAST(sum(coalesce(length(input_text), 0) + coalesce(length(output_text), 0) + coalesce(length(metadata), 0)) AS BIGINT) AS chars
FROM v_events GROUP BY 1, 2
UNION ALL SELECT NULL, '(set aside)', count(*), NULL, NULL, NULL, NULL FROM v_events WHERE latency_ms % 8 = 1""",
    "outcome_stream": """SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M:%S') AS window_start, modality, count(*) AS conversations,
  count(*) FILTER (WHERE outcome = 'contained') AS contained, count(*) FILTER (WHERE outcome = 'escalated') AS escalated, count(*) FILTER (WHERE outcome = 'refused') AS refused,
  count(*) FILTER (WHERE outcome = 'refused') / count(*) AS refusal_rate FROM v_conv
WHERE date_trunc('hour', created_at) + INTERVAL 1 HOUR <= (SELECT max(created_at) FROM v_conv) - INTERVAL 10 MINUTE GROUP BY 1, 2""",
    "evaluation_stream": f"""SELECT * EXCLUDE (queries_order_status, queries_product_qa, queries_service_request), 'unknown' AS git_sha,
  (SELECT {_iso('max(created_at)')} FROM v_conv) AS created_at
FROM ({_production_run(_sample("all", 10**15, False, "TIMESTAMP '1970-01-01 00:00:00'"), "evr_stream_00000000")})""",
    "live_turn_stream": f"""WITH {_BOUNDED},
s AS ({_LIVE_TURNS})
SELECT *, NULL::BIGINT AS duration_ms, NULL::VARCHAR AS outcome, NULL::VARCHAR AS closed_at FROM s
UNION ALL SELECT trace_id, NULL, turns, event_type, NULL, false, NULL, duration_ms, CASE WHEN escalated THEN 'escalated' ELSE 'contained' END, {_iso('closed_at')}
FROM closes JOIN (SELECT trace_id, min(ts) AS first_at FROM v_live GROUP BY 1) USING (trace_id)
WHERE first_at + INTERVAL 600 SECOND <= (SELECT max(ts) FROM v_live) - INTERVAL 600 SECOND""",
    "latest_results": """SELECT run_id, query_id, journey, utterance, response_text, derived_outcome, intent_correct, hit, task_success
FROM v_golden WHERE run_id = (SELECT max(run_id) FROM v_golden)""",
    "reload_store": """SELECT 'conversations' AS table_name, count(*) AS row_count FROM v_conv
UNION ALL SELECT 'conversation_traces', count(*) FROM v_events UNION ALL SELECT 'customers_context', count(*) FROM v_customers
UNION ALL SELECT 'eval_runs', count(*) FROM v_runs""",
}

# Stores hold what the batch jobs compute.
STORED = {"summary_store": "conversation_rollup", "run_store": "eval_run_list", "label_store": "label_set", "bulk_load": "customer_list"}


def _fill(body: str) -> str:
    from oracles.views import HIT

    return body.replace("{HIT}", HIT)


ORACLES = {name: with_views(_fill(body)) for name, body in _BODIES.items()}
ORACLES |= {name: ORACLES[twin] for name, twin in STORED.items()}
