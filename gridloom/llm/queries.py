"""The registered queries of this subpackage, each over whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from gridloom.llm.brown import op2_brown
from gridloom.llm.bpe import op3_bpe
from gridloom.llm.licenses import op6_licenses
from gridloom.llm.media import op10_media
from gridloom.llm.minhash import op9_minhash
from gridloom.llm.packing import op5_packing
from gridloom.llm.quality import op4_quality
from gridloom.llm.simhash import op7_simhash
from gridloom.llm.suffix import op8_suffix
from gridloom.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_brown": op2_brown,
    "op3_bpe": op3_bpe,
    "op4_quality": op4_quality,
    "op5_packing": op5_packing,
    "op6_licenses": op6_licenses,
    "op7_simhash": op7_simhash,
    "op8_suffix": op8_suffix,
    "op9_minhash": op9_minhash,
    "op10_media": op10_media,
}

#: Every 50-byte string of every document, in hexadecimal, with the least id that holds it; the spans to remove are the
#: islands of those that an earlier document holds.
ORACLE_SQL: dict[str, str] = {
    "op8_suffix": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, h, (length(h) // 2)::BIGINT AS n FROM d),
w AS (SELECT doc_id, pos, substr(h, 2 * pos + 1, 100) AS gram FROM (SELECT doc_id, h, unnest(range(n - 49)) AS pos FROM s WHERE n >= 50)),
f AS (SELECT gram, min(doc_id) AS first FROM w GROUP BY gram),
hit AS (SELECT w.doc_id, w.pos FROM w JOIN f USING (gram) WHERE f.first < w.doc_id),
edge AS (SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50 THEN 0 ELSE 1 END AS fresh FROM hit),
run AS (SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS k FROM edge),
span AS (SELECT doc_id, k, min(pos) AS a, max(pos) + 50 AS b FROM run GROUP BY doc_id, k),
piece AS (SELECT doc_id, k, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY k), 0) AS p, a, b FROM span),
kept AS (SELECT s.doc_id, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY k) || substr(any_value(h), 2 * max(b) + 1) AS rest, sum(b - a) AS gone, count(*) AS spans FROM piece JOIN s USING (doc_id) GROUP BY s.doc_id)
SELECT s.doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM s LEFT JOIN kept ON kept.doc_id = s.doc_id
""",
}
