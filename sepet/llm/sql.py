"""Check SQL (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

import zlib

from .hilbert import BITS, SHARDS, curve_states
from .line_dedup import _BREAK, _HIDDEN, _TAG, LEAST_PAGES, RATIO

BLANK_CHARS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL: dict[str, str] = {}

SQL["op1_line_dedup"] = f"""
WITH texts AS (
    SELECT page_id,
           lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
           string_split(regexp_replace(regexp_replace(regexp_replace(html,
               '{_HIDDEN}', chr(10), 'g'), '{_BREAK}', chr(10), 'g'), '{_TAG}', '', 'g'), chr(10)) AS lines
    FROM pages),
keyed AS (SELECT *, row_number() OVER () AS rid FROM texts),
split AS (
    SELECT rid, host, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM keyed),
trimmed AS (SELECT rid, host, i, line, trim(line, {BLANK_CHARS}) AS t FROM split),
totals AS (SELECT host, count(*) AS pages FROM keyed GROUP BY host),
counts AS (SELECT host, t, count(DISTINCT rid) AS n FROM trimmed WHERE t <> '' GROUP BY host, t),
boiler AS (
    SELECT c.host, c.t FROM counts c JOIN totals s ON c.host IS NOT DISTINCT FROM s.host
    WHERE c.n >= {LEAST_PAGES} AND c.n > CAST({RATIO} AS DOUBLE) * s.pages),
marked AS (
    SELECT d.*, b.t IS NOT NULL AS bad FROM trimmed d LEFT JOIN boiler b
    ON d.host IS NOT DISTINCT FROM b.host AND d.t = b.t),
folded AS (
    SELECT rid, count(*) FILTER (t <> '') AS n_lines, count(*) FILTER (bad) AS n_dropped,
           string_agg(line, chr(10) ORDER BY i) FILTER (NOT bad) AS kept
    FROM marked GROUP BY rid)
SELECT k.page_id, k.host, coalesce(f.n_lines, 0) AS n_lines, coalesce(f.n_dropped, 0) AS n_dropped,
       CASE WHEN k.lines IS NOT NULL THEN md5(coalesce(f.kept, '')) END AS kept_md5
FROM keyed k LEFT JOIN folded f USING (rid)
"""

SQL["op5_mixing"] = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
    FROM documents),
per_source AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
    FROM sized GROUP BY source),
ranked AS (
    SELECT source, source_size, w, 2 * source_size AS cap,
           1.5::DOUBLE * sum(source_size) OVER () AS budget,
           coalesce(sum(2 * source_size) OVER l, 0) AS cap_before,
           sum(w) OVER () - coalesce(sum(w) OVER l, 0) AS w_left,
           row_number() OVER (ORDER BY 2 * source_size / w, source NULLS LAST) AS place
    FROM per_source
    WINDOW l AS (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (budget - CAST(cap_before AS DOUBLE)) / CAST(w_left AS DOUBLE) AS lv FROM ranked),
fixed AS (SELECT min_by(lv, place) AS lv FROM levels WHERE lv * w < cap),
targets AS (
    SELECT source, source_size,
           least(coalesce((SELECT lv FROM fixed) * w, CAST(cap AS DOUBLE)), CAST(cap AS DOUBLE)) AS target
    FROM levels),
ordered AS (
    SELECT doc_id, source, size,
           coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, size
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM sized),
budgets AS (
    SELECT o.*, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget
    FROM ordered o JOIN targets t ON o.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
            + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) END AS BIGINT) AS taken
FROM budgets
"""


# The step of CRC-32 for each value of a byte.
_CRC = [zlib.crc32(bytes([b ^ 255])) ^ 0xFF000000 for b in range(256)]
_DIGIT, _AFTER = curve_states(3)
_DIMS = ("source", "lang", "size")


def _curve_steps() -> str:
    """One CTE per bit, from the highest: digit and next state by the corner that the levels' bits name."""
    ctes = ["walk0 AS (SELECT *, 0::BIGINT AS curve, 0 AS state FROM levels)"]
    for k, bit in enumerate(reversed(range(BITS))):
        corner = " + ".join(f"((l_{d} >> {bit}) & 1) * {1 << j}" for j, d in enumerate(_DIMS))
        ctes.append(
            f"walk{k + 1} AS (SELECT * EXCLUDE (curve, state), curve * 8 + {_DIGIT}[state * 8 + {corner} + 1] AS curve, "
            f"{_AFTER}[state * 8 + {corner} + 1] AS state FROM walk{k})"
        )
    return ",\n".join(ctes)


SQL["op13_hilbert_shards"] = f"""
WITH bytes AS (
    SELECT doc_id, source, lang, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) + 1 AS size,
           list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST(concat('0x', h) AS BIGINT)) AS b
    FROM documents),
sized AS (
    SELECT doc_id, source, lang, size,
           xor(list_reduce(list_prepend(4294967295::BIGINT, b),
               lambda crc, x: xor(crc >> 8, list_extract({_CRC}, (xor(crc, x) & 255) + 1))), 4294967295::BIGINT) AS text_crc32
    FROM bytes),
levels AS (
    SELECT *, {", ".join(f"((rank() OVER (ORDER BY {d} NULLS FIRST) - 1) * {1 << BITS}) // count(*) OVER () AS l_{d}" for d in _DIMS)}
    FROM sized),
{_curve_steps()},
placed AS (
    SELECT *, coalesce(sum(size) OVER (ORDER BY curve, text_crc32, doc_id NULLS FIRST
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
           sum(size) OVER () AS total
    FROM walk{BITS}),
cut AS (SELECT *, CAST(before * {SHARDS} // total AS INTEGER) AS shard FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY curve, text_crc32, doc_id NULLS FIRST) - 1 AS slot,
       CAST(NULL AS INTEGER) AS grown_shard, curve
FROM cut
"""


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLDED = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '" + _TERM + "')"

SQL["op12_lexical_search"] = f"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, {_FOLDED.format("text")} AS words FROM documents WHERE text IS NOT NULL),
held AS (SELECT rid, doc_id, words, len(words) AS n FROM docs WHERE len(words) > 0),
corpus AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS total FROM held),
tf AS (
    SELECT rid, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf
    FROM (SELECT rid, doc_id, n, unnest(words) AS term FROM held) GROUP BY ALL),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), corpus),
items AS (
    SELECT item_id, text, term, count(*) AS times
    FROM (SELECT item_id, text, unnest({_FOLDED.format("text")}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark))
    GROUP BY ALL),
scores AS (
    SELECT i.item_id, i.text, tf.rid, tf.doc_id,
           CAST(sum(i.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (100 - 25 + (25 * tf.n * c.n_docs) // c.total))))
                AS BIGINT) AS score
    FROM items i JOIN weights w USING (term) JOIN tf USING (term), corpus c GROUP BY ALL),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank
    FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


SQL["op11_hard_negatives"] = """
WITH rows AS (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
           CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
    FROM rows a JOIN rows r ON a.vec_id <> r.vec_id AND len(a.v) = len(r.v) WHERE a.vec_id % 100 = 0),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
negatives AS (
    SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
    FROM positives p JOIN scored s
      ON p.anchor_id = s.anchor_id AND NOT s.same
     AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 10
"""
