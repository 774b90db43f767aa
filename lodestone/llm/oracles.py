"""DuckDB SQL for those text operators that SQL can express: the others hold trained models, XXH64 or a tokenizer."""

from __future__ import annotations


def covered(units: str, length: int, window: str) -> str:
    """For sequences seq(doc_id, u, t) of units and window, which makes that from i of them: c(doc_id, p, unit, gone), gone if a window of `length` that starts anywhere else, too, covers p."""
    return f"""{units},
    win AS (SELECT doc_id, unnest(list_transform(range(1, len(u) - {length - 2}), lambda i: {window})) AS h, unnest(range(1, len(u) - {length - 2})) AS i FROM seq),
    hit AS (SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
    one AS (SELECT doc_id, unnest(u) AS unit, unnest(range(1, len(u) + 1)) AS p FROM seq),
    last AS (SELECT one.doc_id, p, unit, max(i) OVER (PARTITION BY one.doc_id ORDER BY p) AS m FROM one LEFT JOIN hit ON hit.doc_id = one.doc_id AND i = p),
    marked AS (SELECT doc_id, p, unit, coalesce(m > p - {length}, false) AS gone FROM last),
    c AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS first FROM marked),
    sums AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS n_removed, count(*) FILTER (first) AS n_spans"""


BYTES = "seq AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS u, hex(encode(coalesce(text, ''))) AS t FROM documents)"
WORDS = r"seq AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS u FROM documents)"

SQL: dict[str, str] = {
    "op2_suffix_dedup": f"""WITH {covered(BYTES, 200, "md5(substr(t, 2 * i - 1, 400))")}, sha256(unhex(coalesce(string_agg(unit, '' ORDER BY p) FILTER (NOT gone), ''))) AS kept FROM c GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept, sha256('')) AS kept_sha256 FROM documents d LEFT JOIN sums USING (doc_id)""",
    "op5_exact_topk": """WITH x AS (SELECT vec_id, list_transform(embedding, lambda e: floor(e::DOUBLE * 256)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM x q JOIN x c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
    r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s) SELECT * FROM r WHERE rank <= 5""",
    "op7_seed_extend": f"""WITH {covered(WORDS, 35, "md5(array_to_string(u[i:i + 34], ' '))")}, sha256(coalesce(string_agg(unit, ' ' ORDER BY p) FILTER (NOT gone), '')) AS kept FROM c GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept, sha256('')) AS kept_sha256 FROM documents d LEFT JOIN sums USING (doc_id)""",
}
