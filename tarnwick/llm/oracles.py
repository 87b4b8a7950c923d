"""DuckDB SQL for the training-data queries that SQL can express. The others are tested against brute force in tests/llm."""

from __future__ import annotations

ORACLE_SQL = {
    "op3_maxscore_top_k": """
        WITH v AS (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)
        ), scored AS (
            SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(CASE
                WHEN len(q.v) = len(c.v) AND len(q.v) > 0 THEN list_dot_product(q.v, c.v)
                ELSE coalesce(list_dot_product(q.v[:least(len(q.v), len(c.v))], c.v[:least(len(q.v), len(c.v))]), 0) END AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.row <> c.row
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scored
        QUALIFY rank <= 5
    """,
    # a turn's marks are `<turn `, the role, `>`, a line feed and `</turn>` with a line feed; each control string in a text costs one backslash more
    "op13_chat_format": r"""
        WITH given AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
        ), marked AS (
            SELECT *, regexp_replace(text, '<(\\*)(/?(?:turn|part|image|audio|document))', '<\\\1\2', 'g') AS body FROM given
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length('<turn ' || url_encode(role) || '>' || chr(10) || body || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
        FROM marked GROUP BY conv_id
    """,
}
