"""DuckDB SQL for the queries that SQL can express."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CONTAMINATION = rf"""
WITH item AS (
  SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), part AS (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM item WHERE len(w) > 0
), test AS (
  SELECT DISTINCT item_id::VARCHAR AS item_id, n, array_to_string(w[p : p + n - 1], ' ') AS k FROM part
), doc AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), place AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM doc, (SELECT DISTINCT n FROM test)
), hit AS (
  SELECT doc_id, p, place.n, item_id
  FROM place JOIN test ON place.n = test.n AND array_to_string(place.w[place.p : place.p + place.n - 1], ' ') = test.k
), words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hit)) GROUP BY 1
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS list FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

LINES = """
WITH doc AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), place AS (
  SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS p FROM doc WHERE len(l) > 2
), win AS (
  SELECT doc_id, p, l[p] AS a, l[p + 1] AS b, l[p + 2] AS c FROM place
), ranked AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS nth FROM win
), gone AS (
  SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS q FROM ranked WHERE nth > 1
), line AS (
  SELECT doc_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS q FROM doc
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(gone.q) AS n_removed,
         coalesce(string_agg(x, chr(10) ORDER BY q) FILTER (WHERE gone.q IS NULL), '') AS text
  FROM line LEFT JOIN gone USING (doc_id, q) GROUP BY doc_id
)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, sha256(text) AS kept_sha256 FROM kept
"""

NEAR = f"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM doc WHERE len(w) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM common JOIN size u ON a = u.doc_id JOIN size v ON b = v.doc_id WHERE 100 * c >= 75 * (u.n + v.n - c)
), pair AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM doc
  UNION
  SELECT reach.a, pair.b FROM reach JOIN pair ON reach.b = pair.a
), least AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN size USING (doc_id)
"""

PASSAGES = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), place AS (
  SELECT doc_id, p, array_to_string(w[p : p + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM doc WHERE len(w) >= 50)
), first AS (
  SELECT k, min(doc_id) AS low FROM place GROUP BY 1 HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM place JOIN first USING (k) WHERE low < doc_id
), word AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM doc
), kept AS (
  SELECT doc_id, count(*) AS n, count(gone.q) AS n_removed, string_agg(x, ' ' ORDER BY q) FILTER (WHERE gone.q IS NULL) AS text
  FROM word LEFT JOIN gone USING (doc_id, q) GROUP BY 1
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""


def _nibbles() -> list[int]:
    """CRC-32 (reflected) of the sixteen values of four bits."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    return table


def crc32(text: str) -> str:
    """SQL for the CRC-32 of a text's UTF-8 bytes, four bits at a time, the low four of a byte first."""
    digits = f"string_split(regexp_replace(hex(encode({text})), '(.)(.)', '\\2\\1', 'g'), '')"
    values = f"list_transform({digits}, lambda h: ('0x0' || h)::BIGINT)"
    step = f"lambda c, n: xor(c >> 4, {_nibbles()}[xor(c & 15, n) + 1])"
    return f"CASE WHEN {text} = '' THEN 0 ELSE xor(list_reduce({values}, {step}, 4294967295::BIGINT), 4294967295) END"


def shards(count: int) -> str:
    """Rendezvous hashing over shards of equal weight: the least -ln(draw) is the greatest draw."""
    def best(n: int) -> str:
        draws = f"list_transform(range(0, {n}), lambda s: {{'draw': substr(md5(k || ':' || s), 1, 13), 'shard': -s}})"
        return f"(-list_sort({draws})[-1].shard)::INTEGER"

    return f"""
WITH doc AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, coalesce(text, '') AS t FROM documents
), placed AS (
  SELECT doc_id, strlen(t)::BIGINT + 1 AS size, ({crc32("t")})::BIGINT AS text_crc32, {best(count)} AS shard, {best(count + 1)} AS grown_shard,
         md5(k) AS place
  FROM doc
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place, size, text_crc32) - 1 AS slot, grown_shard
FROM placed
"""


SHARDS = shards(8)

NEGATIVES = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, b.r, list_inner_product(a.c, b.c)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor, anchor_id, r, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, r) <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank
  FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


def _fits(said: str, initial: str) -> str:
    return f"(({initial} = 's' AND {said} = '') OR ({initial} = 'u' AND {said} <> 'u') OR ({initial} = 'a' AND {said} = 'u'))"


# The cheapest edits by a recursion over the rows: for each conversation and last initial the least (cost, audit) so far. Two inserts before a
# row are enough: a third brings the walk back to the initial that one insert reaches.
REPAIR = f"""
WITH RECURSIVE hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations
), dealt AS (
  SELECT conv_id, turn, role, text, ({crc32("k")}) % 20 AS kind FROM hashed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM dealt, range(0, 2) AS t(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth, substr(role, 1, 1) AS initial,
         trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM damaged
), judged AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY nth) > 1 THEN 'duplicate'
                 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY nth) || initial AS pair
  FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM judged GROUP BY 1
), walk AS (
  SELECT conv_id, n, 0::BIGINT AS step, '' AS said, 0::BIGINT AS cost, '' AS audit FROM counted
  UNION ALL
  SELECT * FROM (
    SELECT x.conv_id, x.n, x.step + 1 AS step, CASE letter WHEN 'D' THEN x.said WHEN 'K' THEN initial WHEN 'R' THEN CASE WHEN x.said = 'u' THEN 'a' ELSE 'u' END END AS said,
           x.cost + CASE letter WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END AS cost,
           x.audit || letter AS audit
    FROM (SELECT conv_id, n, step, cost + 2 * k AS cost, audit || repeat('I', k) AS audit,
                 CASE k WHEN 0 THEN said WHEN 1 THEN CASE WHEN said = 'u' THEN 'a' ELSE 'u' END ELSE CASE WHEN said = 'u' THEN 'u' ELSE 'a' END END AS said
          FROM walk, range(0, 3) AS t(k)) x
    JOIN judged j ON x.conv_id IS NOT DISTINCT FROM j.conv_id AND j.nth = x.step + 1, (VALUES ('D'), ('K'), ('R')) AS l(letter)
    WHERE letter = 'D' OR (fault IN ('none', 'truncated') AND (letter = 'R' OR {_fits("x.said", "initial")}))
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, said ORDER BY cost, audit) = 1
), best AS (
  SELECT conv_id, cost + 2 * k AS cost, audit || repeat('I', k) AS audit
  FROM walk, range(0, 3) AS t(k)
  WHERE step = n AND CASE k WHEN 0 THEN said IN ('', 'a') WHEN 1 THEN said = 'u' ELSE said = 's' END
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost + 2 * k, audit || repeat('I', k)) = 1
), letters AS (
  SELECT conv_id, unnest(string_split(audit, '')) AS letter, unnest(range(1, strlen(audit) + 1)) AS p FROM best WHERE audit <> ''
), steps AS (
  SELECT *, sum((letter <> 'I')::INT) OVER w AS nth, sum((letter <> 'D')::INT) OVER w AS place FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY p)
), turns AS (
  SELECT s.conv_id, s.place, s.letter, j.role, CASE WHEN s.letter = 'I' THEN '' ELSE j.text END AS text,
         coalesce(max((s.place = 1 AND s.letter = 'K' AND j.initial = 's')::INT) OVER (PARTITION BY s.conv_id), 0) AS lead
  FROM steps s LEFT JOIN judged j ON s.conv_id IS NOT DISTINCT FROM j.conv_id AND s.nth = j.nth WHERE s.letter <> 'D'
), said AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY place) AS whole
  FROM turns GROUP BY 1
), every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(whole, '')) AS repaired_sha256
FROM every e LEFT JOIN counted c ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON e.conv_id IS NOT DISTINCT FROM b.conv_id
     LEFT JOIN said s ON e.conv_id IS NOT DISTINCT FROM s.conv_id
"""
