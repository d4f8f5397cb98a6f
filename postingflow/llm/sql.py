"""DuckDB twins of the queries that SQL can express, written without the operators' methods."""

from __future__ import annotations

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT = f"""
WITH d AS (SELECT doc_id, sha256({_LOWERED}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


def _placed(name: str, regex: str, options: str = "") -> str:
    """Matches of a regex with their places, one row each: gaps and matches take turns."""
    return f"""
{name}_m AS (SELECT doc_id, regexp_extract_all(t, '{regex}', 0{options}) AS hits, regexp_split_to_array(t, '{regex}'{options}) AS gaps FROM d),
{name}_p AS (SELECT doc_id, unnest(hits) AS hit, unnest(range(1, len(hits) + 1)) AS k, gaps, hits FROM {name}_m WHERE len(hits) > 0),
{name} AS (SELECT doc_id, hit, CAST(list_sum(list_transform(gaps[1:k], lambda x: length(x)))
    + coalesce(list_sum(list_transform(hits[1:k-1], lambda x: length(x))), 0) AS BIGINT) AS s FROM {name}_p)"""


def _entropy(name: str, rank: int, window: int, limit: int, needs: list[str]) -> str:
    """Random windows of candidate runs, recounted for each window, merged where they touch."""
    from postingflow.llm.secret_scan import ALLOWED, ALLOWED_WORDS, weight

    weights = ", ".join(str(weight(c)) for c in range(window + 1))
    wanted = " AND ".join([f"regexp_matches(hit, '{n}')" for n in needs] + [f"NOT regexp_matches(hit, '{a}')" for a in ALLOWED])
    public = "|".join(ALLOWED_WORDS)
    return f"""
{name}_a AS (SELECT doc_id, s, regexp_split_to_array(hit, '{public}') AS gaps, regexp_extract_all(hit, '{public}', 0) AS hits FROM {name}_c WHERE {wanted}),
{name}_b AS (SELECT *, unnest(gaps) AS gap, unnest(range(1, len(gaps) + 1)) AS k FROM {name}_a),
{name}_q AS (SELECT doc_id, gap AS hit, CAST(s + coalesce(list_sum(list_transform(gaps[1:k-1], lambda x: length(x))), 0)
    + coalesce(list_sum(list_transform(hits[1:k-1], lambda x: length(x))), 0) AS BIGINT) AS s FROM {name}_b),
{name}_w AS (SELECT doc_id, s, hit, unnest(range(0, length(hit) - {window} + 1)) AS i FROM {name}_q),
{name}_s AS (SELECT doc_id, s, i, string_split(substr(hit, CAST(i + 1 AS BIGINT), {window}), '') AS cs FROM {name}_w),
{name}_h AS (SELECT doc_id, s, i FROM {name}_s WHERE list_sum(list_transform(list_distinct(cs),
    lambda c: [{weights}][len(list_filter(cs, lambda x: x = c)) + 1])) <= {limit}),
{name}_g AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id, s ORDER BY i) <= {window} THEN 0 ELSE 1 END AS first FROM {name}_h),
{name}_k AS (SELECT *, sum(first) OVER (PARTITION BY doc_id, s ORDER BY i) AS island FROM {name}_g),
{name} AS (SELECT doc_id, {rank} AS rank, '{name}' AS kind, s + min(i) AS s, s + max(i) + {window} AS e FROM {name}_k GROUP BY doc_id, s, island)"""


def _secrets() -> str:
    from postingflow.llm.secret_scan import ALPHABETS, PATTERNS

    quoted = [p.regex.replace("'", "''") for p in PATTERNS]
    kinds = [_placed(f"{p.kind}_c", q) for p, q in zip(PATTERNS, quoted, strict=True)]
    kinds += [_placed(f"{a.kind}_c", a.regex) for a in ALPHABETS]
    entropies = [_entropy(a.kind, len(PATTERNS) + i, a.window, a.limit, list(a.needs)) for i, a in enumerate(ALPHABETS)]
    base = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS rank, '{p.kind}' AS kind, s, s + length(hit) AS e FROM {p.kind}_c "
        f"WHERE length({f"regexp_extract(hit, '{q}', {p.group})" if p.group else 'hit'}) >= {p.least}"
        for i, (p, q) in enumerate(zip(PATTERNS, quoted, strict=True))
    )
    more = " UNION ALL ".join(
        f"SELECT x.* FROM {a.kind} x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.s <= x.s AND b.e >= x.e)"
        for a in ALPHABETS
    )
    text = lambda t: f"coalesce(string_agg(concat_ws(':', {t}.kind, {t}.s, {t}.e), ',' ORDER BY {t}.s, {t}.rank), '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),{','.join(kinds + entropies)},
base AS ({base}), found AS (SELECT * FROM base UNION ALL {more}),
b AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex, {text('base')} AS spans FROM base GROUP BY 1),
f AS (SELECT doc_id, {text('found')} AS spans FROM found GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(f.spans, '') AS spans
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN f USING (doc_id)
"""


SECRETS = _secrets()
