"""DuckDB SQL of those queries of this folder that SQL can express."""

from __future__ import annotations

WORDS_OF = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

MIX = r"""
sized AS (
    SELECT doc_id, source, {words}::BIGINT AS size,
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
    FROM {docs}
), sums AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight
    FROM sized GROUP BY source
), steps AS (
    SELECT *, 3 * source_size AS cap,
           coalesce(sum(3 * source_size) OVER before, 0)::HUGEINT AS capped_before,
           sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left,
           sum(source_size) OVER () AS total
    FROM sums
    WINDOW before AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), flagged AS (
    SELECT *, cap::HUGEINT * weight_left <= (total - capped_before) * weight AS is_capped FROM steps
), goals AS (
    SELECT source, source_size,
           CASE WHEN is_capped THEN cap::DOUBLE
                ELSE ((sum(source_size) OVER () - coalesce(sum(cap) FILTER (is_capped) OVER (), 0))::DOUBLE * weight)
                     / (sum(weight) FILTER (NOT is_capped) OVER ())::DOUBLE END AS target
    FROM flagged
), budgets AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM goals
), keys AS (
    SELECT source, key, sum(size) AS n FROM sized GROUP BY source, key
), cumulated AS (
    SELECT source, key, n, sum(n) OVER (PARTITION BY source ORDER BY key) AS upto FROM keys
), mixed AS (
    SELECT s.doc_id, s.source, s.size, b.source_size, b.target,
           (s.size * (b.whole + CASE
               WHEN c.upto <= b.target - b.whole * b.source_size THEN 1
               WHEN c.upto - c.n <= b.target - b.whole * b.source_size
                    AND c.upto - (b.target - b.whole * b.source_size) < (b.target - b.whole * b.source_size) - (c.upto - c.n) THEN 1
               ELSE 0 END))::BIGINT AS taken
    FROM sized s
    JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
    JOIN cumulated c ON s.source IS NOT DISTINCT FROM c.source AND s.key = c.key
)
"""

WARC = """
WITH keyed AS (
    SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
    SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS first FROM keyed
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM firsts
"""

HAMMING = """
WITH codes AS (
    SELECT vec_id, list_sum(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN 1::UBIGINT << (i - 1) ELSE 0::UBIGINT END))::UBIGINT AS code
    FROM embeddings
), pairs AS (
    SELECT q.vec_id AS query_id, x.vec_id AS neighbour_id, bit_count(xor(q.code, x.code))::INTEGER AS distance
    FROM codes q, codes x WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id)::INTEGER AS rank FROM pairs
)
SELECT query_id, neighbour_id, distance, rank FROM ranked WHERE rank <= 10
"""

#: Words of a text in which only A-Z are lower-cased; the texts of both operators are cut alike.
TERMS_OF = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

DECONTAMINATION = """
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS w FROM documents),
item AS (SELECT item_id, {terms} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[i:i + 9] AS t FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT len(t) AS n FROM win),
grams AS (SELECT r, i, n, w[i:i + n - 1] AS t FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, lengths WHERE len(w) >= n)),
occ AS (SELECT g.r, g.i, g.n, win.item_id FROM grams g JOIN win ON g.t = win.t),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM occ) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM occ) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

SEARCH = """
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS w FROM documents),
corpus AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM doc WHERE len(w) > 0),
item AS (SELECT row_number() OVER () AS q, item_id, unnest(list_distinct({terms})) AS t FROM benchmark),
tf AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM doc) WHERE t IN (SELECT t FROM item) GROUP BY r, t),
df AS (SELECT t, count(*)::BIGINT AS df FROM tf GROUP BY t),
weight AS (SELECT t, floor(1000 * ln(((2 * n_docs + 2)::DOUBLE) / (2 * df + 1)))::BIGINT AS w FROM df, corpus),
score AS (SELECT q, item_id, doc_id, r, sum(weight.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(doc.w) * n_docs) // n_terms))))::BIGINT AS score
 FROM item JOIN tf USING (t) JOIN weight USING (t) JOIN doc USING (r), corpus GROUP BY q, item_id, doc_id, r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM score WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

TRIE = """
WITH own AS (
    SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS turns,
           list_reduce(list_transform([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)), lambda x: x::BIGINT),
               lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, bit: xor(x >> 1, (x & 1) * 3988292384))) AS crc
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), headed AS (
    SELECT conv_id, turns, xor(crc, 4294967295) % 6 AS h FROM own
), rebuilt AS (
    SELECT o.conv_id, list_concat(coalesce(b.turns, [])[1:o.h], o.turns[o.h + 1:]) AS turns
    FROM headed o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100
), prefixes AS (
    SELECT conv_id, len(turns) = depth AS ends_here, depth, turns[1:depth] AS prefix
    FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt)
), nodes AS (
    SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, prefix[1:depth - 1] AS parent,
           CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * length(prefix[-1].text) END AS saved,
           coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends_here), '') AS ends
    FROM prefixes GROUP BY prefix, depth
), children AS (
    SELECT parent AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent
), sums AS (
    SELECT prefix[1:top] AS prefix, sum(saved) AS saved_tokens, count(*) FILTER (n_children IS NULL) AS n_leaves
    FROM (SELECT nodes.*, n_children, unnest(range(0, depth + 1)) AS top FROM nodes LEFT JOIN children USING (prefix)) GROUP BY ALL
)
SELECT n.conv_id::BIGINT AS conv_id, n.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
       coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums USING (prefix) LEFT JOIN children USING (prefix) LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = n.parent
"""

SQL: dict[str, str] = {
    "op2_hamming_search": HAMMING,
    "op1_warc_round_trip": WARC,
    "op4_mix_sources": "WITH " + MIX.format(words=WORDS_OF, docs="documents") + "SELECT doc_id, size, source_size, target, taken FROM mixed",
    "op11_decontamination": DECONTAMINATION.replace("{terms}", TERMS_OF),
    "op12_lexical_search": SEARCH.replace("{terms}", TERMS_OF),
    "op13_prefix_trie": TRIE,
}
