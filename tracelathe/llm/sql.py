"""SQL (DuckDB) for the queries that SQL can express, over whole tables and whole texts."""

OP1 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                                      ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT DISTINCT a, a FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON w.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(l.least, d.doc_id) AS component_id, d.doc_id = coalesce(l.least, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.doc_id = d.doc_id
"""

OP7 = r"""
WITH norm AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM norm WINDOW g AS (PARTITION BY t)
"""

OP9 = r"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT doc_id, i, md5(substr(h, 2 * i - 1, 800)) AS w
  FROM (SELECT doc_id, h, unnest(range(1, len(h) // 2 - 398)) AS i FROM docs WHERE len(h) >= 800)),
twice AS (SELECT doc_id, i FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)),
marked AS (SELECT doc_id, i, i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 AS far, lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL AS first FROM twice),
numbered AS (SELECT doc_id, i, sum(CASE WHEN far OR first THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS b FROM numbered GROUP BY 1, 2),
borders AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS free FROM spans),
kept AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
                string_agg(substr(h, 2 * free - 1, 2 * (a - free)), '' ORDER BY a) AS front FROM borders JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(from_hex(coalesce(front || substr(h, 2 * last - 1), h))) AS kept_sha256
FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

OP11 = r"""
WITH RECURSIVE crc_table AS (  -- of CRC-32, byte by byte
  SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
docs AS (
  SELECT row_number() OVER () AS k, doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, n_chars,
         coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
           || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS front,
         coalesce(octet_length(encode(text)) || ':' || text, '-') AS back,
         xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT),
                         lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM documents, crc_table),
hashed AS (
  SELECT k, doc_id, tree, sha256(front || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || back) AS leaf,
         CASE WHEN crc % 7 = 0 THEN sha256(front || coalesce(length((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || back) END AS changed
  FROM docs),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY tree) AS n FROM hashed),
up(tree, l, r, n, h) AS (
  SELECT tree, 0, r, n, leaf FROM leaves
  UNION ALL
  SELECT tree, l + 1, r // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY r)) FROM up WHERE n > 1 GROUP BY tree, l, r // 2, (n + 1) // 2),
sub AS (SELECT tree, h AS subroot, count(*) OVER () AS m FROM up WHERE n = 1),
above(l, r, n, h) AS (
  SELECT 0, tree, m, subroot FROM sub
  UNION ALL
  SELECT l + 1, r // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY r)) FROM above WHERE n > 1 GROUP BY l, r // 2, (n + 1) // 2),
top AS (SELECT h AS root FROM above WHERE n = 1),
way(k, tree, l, r, n, sibling, x) AS (  -- from leaf to subroot: the sibling met last, and what the tampered leaf has become
  SELECT k, tree, 0, r, n, NULL::VARCHAR, coalesce(changed, leaf) FROM leaves
  UNION ALL
  SELECT w.k, w.tree, w.l + 1, w.r // 2, (w.n + 1) // 2, s.h,
         sha256(CASE WHEN s.h IS NULL THEN w.x WHEN w.r % 2 = 0 THEN w.x || s.h ELSE s.h || w.x END)
  FROM way w LEFT JOIN up s ON s.tree = w.tree AND s.l = w.l AND s.r = xor(w.r, 1) WHERE w.n > 1),
reached AS (SELECT w.k, w.tree, w.x, s.m FROM way w JOIN sub s ON s.tree = w.tree WHERE w.n = 1),
on_top(k, l, r, n, sibling, x) AS (
  SELECT k, 0, tree, m, NULL::VARCHAR, x FROM reached
  UNION ALL
  SELECT w.k, w.l + 1, w.r // 2, (w.n + 1) // 2, s.h,
         sha256(CASE WHEN s.h IS NULL THEN w.x WHEN w.r % 2 = 0 THEN w.x || s.h ELSE s.h || w.x END)
  FROM on_top w LEFT JOIN above s ON s.l = w.l AND s.r = xor(w.r, 1) WHERE w.n > 1),
proof AS (
  SELECT k, sha256(coalesce(string_agg(sibling, '' ORDER BY part, l), '')) AS proof_sha256
  FROM (SELECT k, 0 AS part, l, sibling FROM way UNION ALL SELECT k, 1, l, sibling FROM on_top) GROUP BY k)
SELECT v.doc_id, v.leaf, s.subroot, top.root, p.proof_sha256, o.x AS folded_root, o.x = top.root AS verified
FROM leaves v JOIN sub s ON s.tree = v.tree JOIN proof p ON p.k = v.k JOIN on_top o ON o.k = v.k AND o.n = 1, top
"""

OP12 = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
starts AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE len(w) >= 13)),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM starts) WHERE first < doc_id),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM repeated),
kept AS (
  SELECT d.doc_id, string_agg(d.x, ' ' ORDER BY d.i) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM docs) d ANTI JOIN covered c ON c.doc_id = d.doc_id AND c.i = d.i GROUP BY d.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

OP13 = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
docs AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
         CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * (len(t) - len(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * len(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN first < x.doc_id THEN 'E' ELSE '' END AS fails
  FROM texts x LEFT JOIN marks m ON m.doc_id = x.doc_id),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM docs GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, step, filter_order[step] AS f, filter_order[:step - 1] AS before FROM (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders)),
states AS (
  SELECT *, contains(fails, f) AS failed, before <> '' AND regexp_matches(fails, '[' || CASE WHEN before = '' THEN '-' ELSE before END || ']') AS gone
  FROM steps, cells),
sums AS (
  SELECT part, filter_order, step, f, sum(CASE WHEN NOT gone AND NOT failed THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN NOT gone AND failed THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN gone AND failed THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fails = f THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN NOT gone AND failed THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN NOT gone AND failed THEN bad ELSE 0 END)::BIGINT AS toxic_lost
  FROM states GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM sums
"""

ORACLE_SQL = {"op1_minhash": OP1, "op7_exact_dedup": OP7, "op9_repeats": OP9, "op11_merkle": OP11, "op12_windows": OP12, "op13_filter_audit": OP13}
