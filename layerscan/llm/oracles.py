"""SQL of the operators that SQL can express."""

from __future__ import annotations

MIXING = r"""
WITH words AS (
    SELECT doc_id, source, text,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
    FROM documents
), keyed AS (
    SELECT doc_id, size, coalesce('0' || source, '1') AS source_key,
           (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT + 0.5::DOUBLE)
               / 4503599627370496::DOUBLE AS draw,
           (size + 1)::DOUBLE / (size + 1
               + 10 * coalesce(length(text) - length(translate(text, '#*$%&|<>', '')), 0))::DOUBLE AS quality
    FROM words
), ordered AS (
    SELECT *, sum(size) OVER (PARTITION BY source_key ORDER BY -ln(draw) / quality, draw, doc_id, size
                              ROWS UNBOUNDED PRECEDING) - size AS before
    FROM keyed
), sized AS (
    SELECT source_key, sum(size)::BIGINT AS source_size,
           CASE (row_number() OVER (ORDER BY source_key) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
    FROM keyed GROUP BY source_key
), total AS (
    SELECT sum(source_size) AS words FROM sized
), levels AS (
    -- The level if a source and all that reach their cap later share what the earlier ones leave.
    SELECT 3 * source_size / weight::DOUBLE AS reached,
           ((SELECT words FROM total) - coalesce(sum(3 * source_size) OVER earlier, 0))::DOUBLE
               / (sum(weight) OVER later)::DOUBLE AS level
    FROM sized
    WINDOW earlier AS (ORDER BY 3 * source_size / weight::DOUBLE, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           later AS (ORDER BY 3 * source_size / weight::DOUBLE, source_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), chosen AS (
    SELECT coalesce(arg_min(level, reached) FILTER (WHERE level < reached), max(reached)) AS level FROM levels
), aimed AS (
    SELECT source_key, source_size, least((3 * source_size)::DOUBLE, level * weight) AS target
    FROM sized, chosen
), budgets AS (
    SELECT *, floor(target + 0.5)::BIGINT AS budget, floor(target + 0.5)::BIGINT // greatest(source_size, 1) AS epochs FROM aimed
)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
FROM ordered JOIN budgets USING (source_key)
"""

LEXICAL = r"""
WITH terms AS (
    SELECT doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), counted AS (
    SELECT row_number() OVER () AS row, doc_id, terms, len(terms)::BIGINT AS n FROM terms WHERE len(terms) > 0
), totals AS (
    SELECT count(*)::BIGINT AS documents, sum(n)::BIGINT AS words FROM counted
), asked AS (
    SELECT item_id, term, count(*)::BIGINT AS times
    FROM (SELECT item_id, unnest(regexp_extract_all(
              translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
    GROUP BY ALL
), held AS (
    SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM counted)
    WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weighed AS (
    SELECT term, floor(1000 * ln((2 * (SELECT documents FROM totals) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight
    FROM held GROUP BY term
), impacts AS (
    SELECT row, doc_id, term,
           weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * documents) // words))) AS impact
    FROM held JOIN weighed USING (term) JOIN counted USING (row), totals
), scores AS (
    SELECT item_id, doc_id, sum(times * impact)::BIGINT AS score
    FROM asked JOIN impacts USING (term) GROUP BY item_id, row, doc_id
), ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
    FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

ORACLES = {"op11_mixing": MIXING, "op12_lexical": LEXICAL}
