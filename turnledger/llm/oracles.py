"""DuckDB statements of the search and the tree operators."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

SEARCH = rf"""
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL
    ), sized AS (
      SELECT r, doc_id, len(w)::BIGINT AS n, w FROM d WHERE len(w) > 0
    ), totals AS (
      SELECT count(*)::BIGINT AS total, sum(n)::BIGINT AS words FROM sized
    ), tf AS (
      SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM sized) GROUP BY r, term
    ), df AS (
      SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term
    ), weight AS (
      SELECT term, floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM df, totals
    ), norm AS (
      SELECT r, doc_id, 50 + (50 * n * total) // words AS m FROM sized, totals
    ), q AS (
      SELECT DISTINCT r, item_id, term FROM (
        SELECT r, item_id, unnest(w) AS term
        FROM (SELECT row_number() OVER () AS r, item_id, {_TERMS} AS w FROM benchmark WHERE text IS NOT NULL))
    ), scored AS (
      SELECT q.r AS item, item_id, tf.r, doc_id,
        sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM q JOIN weight USING (term) JOIN tf USING (term) JOIN norm ON tf.r = norm.r
      GROUP BY q.r, item_id, tf.r, doc_id
    ), ranked AS (
      SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank
      FROM scored WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

# The checksum of the decimal identifier, bit by bit.
_CRC = """
    xor(list_reduce(
      [4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
      lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
        lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295)
"""


def _leaf(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f})::VARCHAR || ':' || {f}, '-')" for f in fields) + ")"


def _climb(name: str, nodes: str, levels: int) -> list[str]:
    """Levels of the trees of ``nodes`` (tree, pos, n, h) and the folds of ``{name}_d0``."""
    steps = [f"{name}_l0 AS MATERIALIZED ({nodes})"]
    for k in range(levels):
        steps.append(f"""{name}_l{k + 1} AS MATERIALIZED (
          SELECT tree, pos // 16 AS pos, (n + 15) // 16 AS n,
            CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE min(h) END AS h
          FROM {name}_l{k} GROUP BY tree, pos // 16, n)""")
        steps.append(f"""{name}_d{k + 1} AS MATERIALIZED (
          SELECT r, tree, d.pos // 16 AS pos,
            CASE WHEN l.n > 1 THEN sha256(string_agg(CASE WHEN l.pos = d.pos THEN f ELSE h END, '' ORDER BY l.pos))
              ELSE f END AS f,
            p || coalesce(string_agg(h, '' ORDER BY l.pos) FILTER (l.pos <> d.pos), '') AS p
          FROM {name}_d{k} d JOIN {name}_l{k} l USING (tree)
          WHERE l.pos // 16 = d.pos // 16 GROUP BY r, tree, d.pos, l.n, f, p)""")
    return steps


_STEPS = [
    f"""hashed AS MATERIALIZED (
      SELECT row_number() OVER () AS r, doc_id, source, {_leaf("text")} AS leaf,
        CASE WHEN doc_id IS NOT NULL AND {_CRC} % 5 = 0
          THEN {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {_leaf("text")} END AS fresh
      FROM documents)""",
    """placed AS MATERIALIZED (
      SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
        count(*) OVER (PARTITION BY source) AS n
      FROM hashed)""",
    "a_d0 AS (SELECT r, tree, pos, fresh AS f, '' AS p FROM placed)",
    *_climb("a", "SELECT tree, pos, n, leaf AS h FROM placed", 5),
    "b_d0 AS (SELECT r, 0 AS tree, tree AS pos, f, p FROM a_d5)",
    *_climb("b", "SELECT 0 AS tree, tree AS pos, count(*) OVER () AS n, h FROM a_l5", 4),
]

MANIFEST = f"""
    WITH {", ".join(_STEPS)}
    SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(b_d4.p) AS proof_sha256,
      b_d4.f AS folded_root, b_d4.f = t.h AS verified
    FROM placed JOIN b_d4 USING (r) JOIN a_l5 s ON s.tree = placed.tree CROSS JOIN b_l4 t
"""
