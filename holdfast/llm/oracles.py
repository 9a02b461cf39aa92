"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from holdfast.llm.collocations import LIMIT, LONGEST, MIN_COUNT
from holdfast.llm.licenses import TEMPLATES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

#: Reflected CRC-32 of the decimal digits of ``conv_id``, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(
  list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""


def _license_sql() -> str:
    """Every template tried at every word: phrase in place, with the share of the notice around it."""
    parts, firsts = [], ", ".join(sorted({f"'{t.key[0]}'" for t in TEMPLATES}))
    for t in TEMPLATES:
        key, start = "[" + ", ".join(f"'{x}'" for x in t.key) + "]", t.start
        inside = " + ".join(
            f"CASE WHEN p + {i - start} >= 1 AND w[p + {i - start}] = '{x}' THEN 1 ELSE 0 END"
            for i, x in enumerate(t.words)
        )
        parts.append(
            f"SELECT doc_id, '{t.label}' AS label, {str(t.base).lower()} AS base, p - 1 AS first, "
            f"({inside}) / {len(t.words)}.0::DOUBLE AS cover "
            f"FROM p WHERE x = '{t.key[0]}' AND w[p : p + {len(t.key) - 1}] = {key}"
        )
    return f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, {_LETTERS}) AS w FROM documents
), p AS MATERIALIZED (
  SELECT * FROM (SELECT doc_id, w, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) WHERE x IN ({firsts})
), m AS (
  SELECT * FROM ({" UNION ALL ".join(parts)})
), s AS (
  SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(first) FILTER (WHERE base) AS first_word,
         max(first) FILTER (WHERE base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score
  FROM m GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN s USING (doc_id)
"""


def _collocation_sql() -> str:
    """All phrases counted, cut everywhere and looked up in all longer ones by one word."""
    grams = " UNION ALL ".join(
        f"SELECT lang, array_to_string(w[p : p + {k - 1}], ' ') AS phrase, {k} AS k, count(*) AS a "
        f"FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS p FROM pieces WHERE len(w) >= {k}) GROUP BY 1, 2"
        for k in range(1, LONGEST + 1)
    )
    return f"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)
), size AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang
), f AS MATERIALIZED (
  SELECT * FROM ({grams}) WHERE a >= {MIN_COUNT}
), c AS (
  SELECT lang, phrase, k, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1
), longer AS (
  SELECT lang, part, max(a) AS most FROM (
    SELECT lang, a, unnest([array_to_string(w[:-2], ' '), array_to_string(w[2:], ' ')]) AS part FROM c
  ) GROUP BY lang, part
), cuts AS (
  SELECT c.lang, c.phrase, c.a, c.w, unnest(range(1, c.k)) AS cut
  FROM c LEFT JOIN longer ON c.lang = longer.lang AND c.phrase = longer.part WHERE coalesce(100 * most < 100 * c.a, true)
), scored AS (
  SELECT u.lang, u.phrase, u.a, x.a AS l, y.a AS r, n, cut,
         CAST(1000::HUGEINT * u.a * n // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM cuts u JOIN size USING (lang)
  JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(w[:cut], ' ')
  JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')
), least AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM least QUALIFY rank <= {LIMIT}
"""


SQL: dict[str, str] = {
    "op6_license_index": _license_sql(),
    "op7_winnowing": f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, {_LETTERS}) AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all({_LOWER}, {_LETTERS}) AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS s
  FROM (
    SELECT doc_id, w, l.n AS n, unnest(range(1, len(w) - l.n + 2)) AS p
    FROM d CROSS JOIN (SELECT DISTINCT n FROM iw) l WHERE len(w) >= l.n
  )
), m AS (
  SELECT dw.doc_id, dw.p, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.s = iw.s
), h AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM m))
  GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit,
       coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
""",
    "op11_zfast_prefix_trie": f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i,
         {{'k': md5(coalesce(role, '')) || md5(coalesce(text, '')),
           'w': len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))}} AS turn
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(turn ORDER BY i) AS ts, {_CRC32} % 4 AS h FROM t GROUP BY conv_id
), seq AS (
  SELECT o.conv_id, list_concat(coalesce(b.ts[1 : o.h], []), o.ts[o.h + 1 :]) AS s
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20
), node AS (
  SELECT s[1 : d] AS p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(s) = d) AS ends
  FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM seq) GROUP BY 1, 2
), child AS (
  SELECT p[1 : d - 1] AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY 1
), sub AS (
  SELECT p[1 : k] AS p, CAST(sum(saved) AS BIGINT) AS saved, count(*) FILTER (WHERE leaf) AS leaves
  FROM (
    SELECT node.p, (n_convs - 1) * CASE WHEN d > 0 THEN node.p[d].w ELSE 0 END AS saved, child.n IS NULL AS leaf,
           unnest(range(0, d + 1)) AS k
    FROM node LEFT JOIN child ON child.p = node.p
  ) GROUP BY 1
)
SELECT node.conv_id, node.d AS depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(child.n, 0) AS n_children,
       sub.leaves AS n_leaves, sub.saved AS saved_tokens, sha256(coalesce(node.ends, '')) AS ends_sha256
FROM node JOIN sub ON sub.p = node.p LEFT JOIN child ON child.p = node.p
LEFT JOIN node up ON up.d = node.d - 1 AND up.p = node.p[1 : node.d - 1]
""",
    "op12_collocation_stripes": _collocation_sql(),
}
