"""DuckDB SQL for the queries that SQL can express."""

ORACLE = {
    "op1_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS body, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents
        )
        SELECT doc_id, first_value(doc_id) OVER best AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER best = 1 AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW best AS (PARTITION BY norm ORDER BY length(body) DESC, doc_id)
    """,
}
