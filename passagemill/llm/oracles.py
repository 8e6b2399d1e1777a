"""SQL (DuckDB) of the operators that it can express."""

from __future__ import annotations

_AZ = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Phrases of 2 and 3 words, counted at every place of every piece.
COLLOCATIONS = f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array({_AZ.format("coalesce(text, '')")}, '[.,;:!?\\n\\x0B\\x0C\\r]')), '[^ \\t]+') AS w FROM documents),
 numbered AS (SELECT lang, w, row_number() OVER () AS piece FROM pieces),
 words AS (SELECT lang, piece, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM numbered),
 places AS (SELECT lang, w1, w1 || ' ' || lead(w1) OVER p AS w2, w1 || ' ' || lead(w1) OVER p || ' ' || lead(w1, 2) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY piece ORDER BY i)),
 grams AS (SELECT lang, 1 AS k, w1 AS phrase, count(*) AS f FROM places GROUP BY ALL UNION ALL SELECT lang, 2, w2, count(*) FROM places WHERE w2 IS NOT NULL GROUP BY ALL
 UNION ALL SELECT lang, 3, w3, count(*) FROM places WHERE w3 IS NOT NULL GROUP BY ALL),
 totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
 candidates AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM grams WHERE k > 1 AND f >= 10),
 cuts AS (SELECT lang, k, phrase, w, a, u.size, array_to_string(w[1 : u.size], ' ') AS head, array_to_string(w[u.size + 1 : k], ' ') AS rest FROM candidates, range(1, 3) AS u(size) WHERE u.size < k),
 scored AS (SELECT c.*, h.f AS l, r.f AS r, ((1000000::HUGEINT * a * a) // (h.f::HUGEINT * r.f))::BIGINT AS score
 FROM cuts c JOIN grams h ON h.lang = c.lang AND h.phrase = c.head AND h.k = c.size JOIN grams r ON r.lang = c.lang AND r.phrase = c.rest AND r.k = c.k - c.size),
 worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, size) = 1),
 around AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM candidates WHERE k = 3
 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM candidates WHERE k = 3) x GROUP BY ALL)
 SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank, w.phrase, a, l, r, n, score
 FROM worst w JOIN totals t ON t.lang = w.lang LEFT JOIN around x ON x.lang = w.lang AND x.phrase = w.phrase WHERE most IS NULL OR 100 * most < 50 * a QUALIFY rank <= 2000"""


#: Runs are of a-z and À-ÿ, so a character is one byte, or 195 and its code point less 64.
_BYTES = "list_transform(string_split(doc_id || ':', ''), lambda c: unicode(c)) || flatten(list_transform(string_split(run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END))"
_BITS = f"flatten(list_transform({_BYTES}, lambda b: [{', '.join(f'(b >> {k}) & 1' for k in range(8))}]))"
#: CRC-32 bit by bit (reflected polynomial 0xEDB88320).
_STEP = f"xor(x >> 1, (xor(x, b) & 1) * {0xEDB88320})"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform({_BITS}, lambda b: b::BIGINT)), lambda x, b: {_STEP}), 4294967295::BIGINT)"

#: Each table takes twice as many steps as the one before; 16 steps multiply n by 5^16.
_DOUBLED = ",\n ".join(f"way{k + 1} AS MATERIALIZED (SELECT a.word, b.last FROM way{k} a JOIN way{k} b ON b.word = a.last)" for k in range(4))
#: Near words share a form with one letter taken out of either or both at one place.
SPELLING = f"""WITH runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id,
 unnest(regexp_extract_all({_AZ.format('text')}, '[a-zÀ-ÿ]+')) AS run FROM documents) r WHERE length(run) > 5 GROUP BY ALL),
 hashed AS (SELECT run, n, {_CRC} AS h FROM runs),
 typed AS MATERIALIZED (SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
 words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) > 5 GROUP BY word HAVING sum(n) >= 5),
 less AS MATERIALIZED (SELECT word, n, u.i, substring(word, 1, u.i) || substring(word, u.i + 2) AS rest FROM words, unnest(range(0, length(word))) AS u(i)),
 pairs AS (SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
 UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
 best AS (SELECT word, count(*) AS n_near, max(n) AS most, first(other ORDER BY n DESC, other) AS other FROM pairs GROUP BY word),
 formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * w.n THEN other END AS form, CASE WHEN most >= 5 * w.n THEN most END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
 way0 AS MATERIALIZED (SELECT word, coalesce(form, word) AS last FROM formed), {_DOUBLED}
 SELECT f.word, form, last AS root, n, n_near, form_n FROM formed f JOIN way4 e ON e.word = f.word"""
