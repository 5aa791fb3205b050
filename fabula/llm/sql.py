"""Oracle SQL of those queries that SQL can express."""

_TOP = """v AS (SELECT DISTINCT ON (id) id, CAST(concept AS DOUBLE[]) AS c FROM novel_vector WHERE concept IS NOT NULL AND len(list_filter(concept, lambda x: isnan(x) OR x IS NULL)) = 0),
    n AS (SELECT id, c, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS len FROM v), u AS (SELECT * FROM n WHERE len > 0),
    s AS (SELECT a.id, b.id AS match, round(list_dot_product(a.c, b.c) / (a.len * b.len), 6) AS similarity FROM u a JOIN u b ON a.id <> b.id),
    m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, match) AS rank FROM s WHERE similarity >= 0.85)"""

ORACLES: dict[str, str] = {
    "p3_found": f"WITH {_TOP} SELECT DISTINCT least(id, match) AS id_a, greatest(id, match) AS id_b FROM m WHERE rank <= 5",
    "p3_top_matches": f"WITH {_TOP} SELECT id, match, similarity, rank FROM m WHERE rank <= 5 AND id % 20 = 0",
}
