"""DuckDB SQL for the rows of the queries."""

from specgrade.llm.license_scan import PHRASES, TEMPLATES, WORD, template_words

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), {AZ})) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)
"""

LINE_DEDUP = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {AZ}) AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id
"""


def _words(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_TEMPLATES = ", ".join(f"('{label}', {_words(template_words(text))}, {_words(template_words(must))})" for label, text, must in TEMPLATES)
_PHRASES = ", ".join(f"('{label}', {_words(words)})" for words, label in PHRASES)

LICENSE_SCAN = rf"""
WITH t(label, tw, must) AS (VALUES {_TEMPLATES}), p(label, pw) AS (VALUES {_PHRASES}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '{WORD}') AS w FROM documents),
places AS (SELECT doc_id, label, i FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d) x JOIN p ON x.w[i + 1:i + len(pw)] = pw),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY doc_id),
blocks AS (SELECT doc_id, w[24 * k + 1:24 * k + 48] AS b FROM (SELECT doc_id, w, unnest(range(greatest(1, CAST(ceil((len(w) - 24) / 24.0) AS BIGINT)))) AS k FROM d) x),
found AS (SELECT doc_id, label, len(list_intersect(tw, b)) / len(tw) AS c FROM blocks JOIN t ON 100 * len(list_intersect(tw, b)) >= 80 * len(tw) AND list_has_all(b, must)),
method AS (SELECT doc_id, max(c) AS c, list(DISTINCT label) AS labels FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(method.labels, [])))), ','), '') AS labels,
       round(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0.0) END, 9) AS score, round(coalesce(c, 0.0), 9) AS containment
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN method USING (doc_id)
"""

COLLOCATIONS = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), {AZ}) AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
          FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words CROSS JOIN (VALUES (1), (2), (3), (4)) x(m)) y),
counts AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
split AS (SELECT lang, m, phrase, f, string_split(phrase, ' ') AS w FROM counts WHERE m >= 2),
cuts AS (SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp
         FROM (SELECT *, unnest(range(1, m)) AS k FROM split) x),
scored AS (SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, (CAST(2000000 AS HUGEINT) * c.a) // (CAST(x.f AS HUGEINT) + y.f) AS score
           FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.lp JOIN counts y ON y.lang = c.lang AND y.phrase = c.rp),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(f) AS longer
           FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM split WHERE m >= 3) x) y GROUP BY ALL),
kept AS (SELECT w.* FROM weakest w LEFT JOIN inside i USING (lang, phrase) WHERE i.longer IS NULL OR CAST(100 AS HUGEINT) * i.longer < CAST(80 AS HUGEINT) * w.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
