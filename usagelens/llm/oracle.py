"""Oracle SQL (DuckDB) of the operators that SQL can tell: 3, 7, 8, 11 and 12, by brute force over whole tables."""

from __future__ import annotations

from usagelens.llm import decontaminate, exponion, near_vectors, sharding

# Links by comparing all vectors of a label; components by following links until nothing new is reached.
OP3 = f"""
WITH RECURSIVE fit AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND LEN(LIST_FILTER(embedding, lambda x: x IS NULL OR ISNAN(x) OR ISINF(x))) = 0 AND LEN(LIST_FILTER(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id AND LEN(a.v) = LEN(b.v)
  WHERE LIST_COSINE_SIMILARITY(a.v, b.v) >= {near_vectors.THRESHOLD}),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
counts AS (SELECT a, COUNT(*) AS n FROM links GROUP BY a),
least AS (SELECT a, MIN(b) AS b FROM reach GROUP BY a)
SELECT e.vec_id, COALESCE(c.n, 0) AS n_links, LEAST(e.vec_id, m.b) AS component_id, COALESCE(e.vec_id = LEAST(e.vec_id, m.b), TRUE) AS kept
FROM embeddings e LEFT JOIN counts c ON e.vec_id = c.a LEFT JOIN least m ON e.vec_id = m.a"""

# What each bit of a byte adds to the reflected CRC-32.
_CRC_BITS = ("0x77073096", "0xEE0E612C", "0x076DC419", "0x0EDB8832", "0x1DB71064", "0x3B6E20C8", "0x76DC4190", "0xEDB88320")
_CRC_BYTE = "c >> 8"
for _i, _bits in enumerate(_CRC_BITS):
    _CRC_BYTE = f"XOR({_CRC_BYTE}, ((XOR(c, b) >> {_i}) & 1) * {int(_bits, 16)})"


def _jumps(shards: int) -> str:
    return f"""
  SELECT CAST({shards} AS BIGINT) AS shards, k AS key, CAST(-1 AS BIGINT) AS place, CAST(0 AS BIGINT) AS following, CASE WHEN k < 0 THEN k + {sharding.WORD} ELSE k END AS seed
  FROM (SELECT DISTINCT CAST(key AS HUGEINT) AS k FROM docs)"""


def op7(shards: int = 40, slices: int = sharding.SLICES) -> str:
    """Jump consistent hashing in 128-bit integers, and CRC-32 byte by byte."""
    step = f"((seed * {sharding.STEP} + 1) % {sharding.WORD})"
    return f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, COALESCE(doc_id, 0) AS key, HEX(ENCODE(COALESCE(text, ''))) AS body FROM documents),
jumps AS ({_jumps(shards)} UNION ALL {_jumps(shards + 1)}
  UNION ALL
  SELECT shards, key, following, CAST(FLOOR((following + 1) * (2147483648.0e0 / (CAST({step} // 8589934592 AS DOUBLE) + 1.0e0))) AS BIGINT), {step}
  FROM jumps WHERE following < shards),
placed AS (SELECT shards, key, CAST(place AS INTEGER) AS shard FROM jumps WHERE following >= shards),
summed AS (
  SELECT doc_id, key, CAST(LEN(body) // 2 + 16 AS BIGINT) AS size,
    XOR(LIST_REDUCE(LIST_PREPEND(CAST(4294967295 AS BIGINT), LIST_TRANSFORM(REGEXP_EXTRACT_ALL(body, '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, b: {_CRC_BYTE}), 4294967295) AS text_crc32
  FROM docs)
SELECT s.doc_id, s.size, s.text_crc32, 'key' AS law, p.shard, g.shard AS grown_shard,
  ROW_NUMBER() OVER (PARTITION BY p.shard ORDER BY ((s.key % {slices} + {slices}) % {slices} + s.text_crc32) % {slices}, s.doc_id NULLS FIRST, s.text_crc32, s.size) - 1 AS slot
FROM summed s JOIN placed p ON p.key = s.key AND p.shards = {shards} JOIN placed g ON g.key = s.key AND g.shards = {shards + 1}"""


def op8(window: int = decontaminate.WINDOW) -> str:
    """All runs of words of documents that are as long as a window, joined with the windows of items."""
    words = "UNNEST(w) AS word, GENERATE_SUBSCRIPTS(w, 1) AS i, LEN(w) AS n"
    found = "REGEXP_EXTRACT_ALL(TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '" + decontaminate.WORD + "')"
    run = lambda size: f"STRING_AGG(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING)"
    items = " UNION ALL ".join(f"SELECT item, {k} AS size, i, n, {run(k)} AS run FROM item_words WHERE n {'>=' if k == window else '='} {k}" for k in range(1, window + 1))
    runs = " UNION ALL ".join(f"SELECT r, {k} AS size, i, n, {run(k)} AS run FROM doc_words WHERE {k} IN (SELECT size FROM windows)" for k in range(1, window + 1))
    return f"""
WITH item_words AS (SELECT r, item, {words} FROM (SELECT ROW_NUMBER() OVER () AS r, COALESCE(CAST(item_id AS VARCHAR), '') AS item, {found} AS w FROM benchmark)),
windows AS (SELECT DISTINCT item, size, run FROM ({items}) WHERE i + size - 1 <= n),
docs AS (SELECT ROW_NUMBER() OVER () AS r, doc_id, {found} AS w FROM documents),
doc_words AS (SELECT r, {words} FROM docs),
hits AS (SELECT d.r, d.i, d.size, x.item FROM ({runs}) d JOIN windows x ON x.size = d.size AND x.run = d.run WHERE d.i + d.size - 1 <= d.n),
places AS (SELECT r, COUNT(DISTINCT place) AS n_hit FROM (SELECT r, UNNEST(RANGE(i, i + size)) AS place FROM hits) GROUP BY r),
owners AS (SELECT r, COUNT(*) AS n_items, STRING_AGG(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(LEN(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, SHA256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN places USING (r) LEFT JOIN owners USING (r)"""


def op11(k: int = exponion.CENTROIDS, rounds: int = exponion.ROUNDS) -> str:
    """All distances to all centroids, round after round."""
    scaled = f"LIST_TRANSFORM(embedding, lambda x: CAST(FLOOR({exponion.SCALE} * CAST(x AS DOUBLE)) AS BIGINT))"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
near{i} AS (SELECT r, ARG_MIN(c, (d, c)) AS c, MIN(d) AS d FROM (
  SELECT v.r, m.c, LIST_SUM(LIST_TRANSFORM(LIST_ZIP(v.q, m.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM fit v CROSS JOIN means{i} m) GROUP BY r),""")
        if i < rounds:
            steps.append(f"""
sums{i} AS (SELECT c, j, SUM(x) AS s, COUNT(*) AS n FROM (SELECT c, UNNEST(q) AS x, GENERATE_SUBSCRIPTS(q, 1) AS j FROM fit JOIN near{i} USING (r)) GROUP BY c, j),
means{i + 1} AS (SELECT m.c, COALESCE(s.q, m.q) AS q FROM means{i} m LEFT JOIN (
  SELECT c, LIST(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS q FROM sums{i} GROUP BY c) s ON m.c = s.c),""")
    return f"""
WITH fit AS MATERIALIZED (
  SELECT vec_id, ROW_NUMBER() OVER () AS r, {scaled} AS q FROM embeddings
  WHERE LEN(embedding) = {exponion.LENGTH} AND LEN(LIST_FILTER(embedding, lambda x: x IS NULL OR ISNAN(x) OR ABS(x) > {exponion.MOST_COMPONENT})) = 0),
means0 AS (
  SELECT c, q FROM (SELECT ROW_NUMBER() OVER (ORDER BY SHA256('{exponion.SEED}:' || COALESCE(CAST(vec_id AS VARCHAR), '')), q) - 1 AS c, q FROM fit) WHERE c < {k}),{"".join(steps)}
about AS (SELECT c, CAST(SUM(d) AS BIGINT) AS cluster_inertia FROM near{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, cluster_inertia, CAST((SELECT SUM(d) FROM near{rounds}) AS BIGINT) AS inertia,
  SHA256(ARRAY_TO_STRING(m.q, ',')) AS centroid_sha256
FROM fit JOIN near{rounds} USING (r) JOIN about USING (c) JOIN means{rounds} m USING (c)"""


def op12(seed: int = 7) -> str:
    """Lines by a regular expression, parts joined from lists of lines."""
    h = ", ".join(f"CAST('0x' || SUBSTRING(h, {1 + 8 * i}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
    part = lambda a, b: f"ARRAY_TO_STRING(LIST_SLICE(lines, {a} + 1, {b}), '')"
    return f"""
WITH docs AS (
  SELECT doc_id, COALESCE(text, '') AS text, SHA256('{seed}:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
lined AS (
  SELECT doc_id, text, REGEXP_EXTRACT_ALL(text, '[^\n]*\n|[^\n]+') AS lines, {h} FROM docs),
placed AS (
  SELECT *, LEN(lines) AS n, LEAST(h1 % (LEN(lines) + 1), h2 % (LEN(lines) + 1)) AS a, GREATEST(h1 % (LEN(lines) + 1), h2 % (LEN(lines) + 1)) AS b,
    CASE WHEN text = '' OR CONTAINS(text, '<P>') OR CONTAINS(text, '<S>') OR CONTAINS(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM lined),
parts AS (
  SELECT doc_id, text, n, form, {part("0", "a")} AS prefix, {part("a", "b")} AS middle, {part("b", "n")} AS suffix FROM placed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN LENGTH(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN LENGTH(middle) END AS middle_chars,
  SHA256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  SHA256(prefix || middle || suffix) AS restored_sha256
FROM parts"""
