"""ANSI SQL (as DuckDB reads it) of the training-text queries that SQL can express."""

from __future__ import annotations

_TARGETS = """
WITH e AS (SELECT mix_id, dataset_id, max_repeats, coalesce(weight, 1.0) AS w FROM dataset_entry),
s AS (SELECT mix_id, sum(w) AS ws FROM e GROUP BY mix_id),
c AS (SELECT dataset_id, count(*) AS n FROM precomputed WHERE data_split = 'train' GROUP BY dataset_id),
t AS (SELECT e.mix_id, e.dataset_id, w / ws * target_rows AS target, max_repeats * coalesce(n, 0) AS capacity, max_repeats
      FROM e JOIN s USING (mix_id) JOIN mix_run USING (mix_id) LEFT JOIN c ON c.dataset_id = e.dataset_id)
"""

_CJK = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}"
_TOKENS = rf"coalesce(list_sum(list_transform(captions, lambda c: len(regexp_extract_all(coalesce(c, ''), '[{_CJK}]|[^\s{_CJK}]+')))), 0)"

_FORMS = r"""
WITH v AS (SELECT row_id, regexp_replace(lower(u.c), '[^\p{L}\p{M}\p{N}]+', '', 'g') AS f
           FROM precomputed, unnest(captions) AS u(c) WHERE u.c IS NOT NULL),
r AS (SELECT row_id, string_agg(f, '|' ORDER BY f) AS t FROM v WHERE f <> '' GROUP BY row_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _TARGETS + "SELECT mix_id, dataset_id FROM t WHERE target > capacity",
        "p1_shares": _TARGETS
        + """, a AS (SELECT *, least(round_even(target, 0), capacity)::BIGINT AS actual FROM t)
SELECT mix_id, dataset_id, round(target, 6) AS target_rows, capacity::BIGINT AS capacity_rows, actual AS actual_rows,
       round(actual / nullif(sum(actual) OVER (PARTITION BY mix_id), 0), 9) AS actual_share,
       round(target / nullif(sum(target) OVER (PARTITION BY mix_id), 0), 9) AS target_share FROM a""",
        "p1_row_totals": _TARGETS
        + """, a AS (SELECT *, least(round_even(target, 0), capacity)::BIGINT AS actual FROM t)
SELECT mix_id, dataset_id, actual AS n_copies, ceil(actual * max_repeats / nullif(capacity, 0))::BIGINT AS most_copies FROM a WHERE actual > 0""",
        # the search meets every budget exactly, so what is taken is what can be taken
        "p1_token_totals": _TARGETS.replace("count(*) AS n FROM precomputed", f"sum({_TOKENS}) AS n, count(*) AS k FROM precomputed").replace("AS capacity, max_repeats", "AS capacity, n, k")
        + """, m AS (SELECT mix_id, sum(n) / sum(k) AS mean FROM t GROUP BY 1)
SELECT mix_id, dataset_id, capacity::BIGINT AS capacity_tokens, least(round_even(target * mean, 0), capacity)::BIGINT AS actual_tokens FROM t JOIN m USING (mix_id) WHERE capacity > 0""",
        "p2_checks": """SELECT count(*) AS n_rows, sum(len(captions))::BIGINT AS n_captions, sum(len(list_filter(captions, lambda c: c IS NULL)))::BIGINT AS n_null, 0::BIGINT AS n_odd FROM precomputed""",
        "p7_checks": "SELECT data_split, dataset_id, count(*) AS n_rows, 0::BIGINT AS n_missed FROM precomputed WHERE data_split <> 'train' GROUP BY 1, 2",
        "p10_checks": r"SELECT count(*) AS n_documents, count(*) FILTER (regexp_matches(text, '[\p{L}\p{N}]')) AS n_with_words, count(*) FILTER (regexp_matches(text, '[\p{L}\p{N}]')) AS n_with_band FROM documents",
        "p8_placement": """SELECT container_name, (SELECT count(*) FROM documents WHERE text <> '') AS n_documents, 0::BIGINT AS n_overfull, 0::BIGINT AS n_broken, TRUE AS well_filled FROM container_spec""",
        "p4_found": _FORMS + "SELECT first_row_id, row_id FROM (SELECT row_id, min(row_id) OVER (PARTITION BY t) AS first_row_id FROM r) WHERE row_id > first_row_id",
        "p4_records": _FORMS + "SELECT min(row_id) AS first_row_id, count(*) AS n_copies FROM r GROUP BY t",
    }
