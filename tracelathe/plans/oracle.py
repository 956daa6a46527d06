"""The registered queries as plain SQL over the given tables, for cross-checking."""

from __future__ import annotations

import glob
import os
import zipfile

import pyspark

from tracelathe.plans.catalog import QUERIES, QUERY_EPS
from tracelathe.plans.views import BURST_GAP_NS, CONTEXT_NS
from tracelathe.schema import EPS, PIECE

_TYPES = {"s": "VARCHAR", "i": "BIGINT", "b": "BOOLEAN"}


def _stop_list() -> str:
    """Spark's English stop words as a SQL list, read from the library's own resource file."""
    jars = os.path.join(os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__), "jars")
    with zipfile.ZipFile(glob.glob(f"{jars}/spark-mllib_*.jar")[0]) as jar:
        words = jar.read("org/apache/spark/ml/feature/stopwords/english.txt").decode().split("\n")
    return "[" + ",".join("'" + w.replace("'", "''") + "'" for w in words if w) + "]"


def _shaped(body: str, columns: str) -> str:
    out = []
    for item in columns.split():
        name, kind = item.split(":")
        out.append(f'round(CAST("{name}" AS DOUBLE), {kind[1:]}) + 0.0 AS "{name}"' if kind[0] == "f"
                   else f'CAST("{name}" AS {_TYPES[kind]}) AS "{name}"')
    return f"SELECT {', '.join(out)} FROM ({body}) AS shaped"


EV = """ev AS (SELECT CAST(user_id AS VARCHAR) AS test_id, event_id, epoch_us(ts) * 1000 AS ts_ns, event_type,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(round(value * 100) AS BIGINT) AS v, value FROM events)"""
ACC = EV + """, acc AS (SELECT test_id, 4 * event_id AS line_id, 0 AS pos, ts_ns, CAST(ts_ns AS VARCHAR) AS ts_text,
  CASE WHEN k % 2 = 0 THEN 'MEM_R' ELSE 'MEM_W' END AS action, '0x' || lower(to_hex(4096 + k)) AS address,
  '32b' AS size, 'core.' || event_type || '[' || (k % 4) || ']' AS descr, v AS value,
  '0x' || lower(to_hex(v)) AS value_hex, 'ev ' || event_id AS comment,
  k % 2 = 0 AS is_read, k % 2 = 1 AS is_write FROM ev)"""
FSM = EV + """, fsm AS (SELECT test_id, 4 * event_id + 1 AS line_id, 0 AS pos, ts_ns, k, 'F' || (k % 2) AS fsm_name,
  from_state, event_type AS to_state FROM (SELECT *, lag(event_type) OVER (PARTITION BY test_id, k % 2 ORDER BY event_id)
  AS from_state FROM ev) WHERE from_state IS NOT NULL)"""
ACC_FSM = ACC + FSM[len(EV):]
FRAME = ACC_FSM + """, frame AS (SELECT test_id, line_id, 0 AS part, pos, ts_ns, ts_text, action, descr, value_hex, address FROM acc
  UNION ALL SELECT test_id, line_id, 2, pos, ts_ns, CAST(ts_ns AS VARCHAR), 'FSM_TRANSITION', fsm_name || '_transition',
  from_state || '->' || to_state, NULL FROM fsm)"""
ERR = """err AS (SELECT test_id, 4 * event_id + 2 AS line_id, 0 AS pos, ts_ns, k, 'fault k=' || k AS message
  FROM ev WHERE event_type = 'error')"""
RUNS = """runs AS (SELECT test_id, CASE WHEN bool_or(event_type = 'error' AND value > 200) THEN 'FAIL' ELSE 'PASS' END
  AS status FROM ev GROUP BY test_id)"""

VALUES = f"""WITH {ACC}, st AS (SELECT *, lag(value) OVER (PARTITION BY test_id, descr ORDER BY line_id) AS prev FROM acc),
 d AS (SELECT *, value - prev AS diff FROM st)
SELECT test_id, descr, count(*) AS n, min(value) AS min, max(value) AS max, avg(value) AS mean, median(value) AS median,
 stddev_pop(value) AS std, count(DISTINCT value) AS n_unique, max(value) - min(value) AS range, 0.0 AS importance,
 bit_or(value) AS bits_ever, bit_and(value) AS bits_always, bit_or(xor(value, prev)) AS bits_toggled,
 avg(bit_count(value)) AS mean_popcount, avg(bit_count(xor(value, prev))) AS mean_hamming,
 avg(diff) AS mean_diff, max(abs(diff)) AS max_diff, stddev_pop(diff) AS diff_std,
 count(DISTINCT (prev, value)) FILTER (prev IS NOT NULL) AS n_transitions,
 count(*) FILTER (diff <> 0) / count(diff) AS change_frequency
FROM d GROUP BY test_id, descr HAVING count(*) >= 3"""

SEQ = f"""{ACC}, w AS (SELECT *, lead(descr) OVER o AS d1, lead(descr, 2) OVER o AS d2, lead(action) OVER o AS a1,
  lead(action, 2) OVER o AS a2, lead(value_hex) OVER o AS v1, lead(value_hex, 2) OVER o AS v2, lead(ts_ns, 2) OVER o AS t2
  FROM acc WINDOW o AS (PARTITION BY test_id ORDER BY ts_ns, line_id, pos)),
 sq AS (SELECT test_id, line_id, ts_ns, descr || '->' || d1 || '->' || d2 AS sequence FROM w WHERE d2 IS NOT NULL),
 sc AS (SELECT test_id, sequence, count(*) AS n, min((ts_ns, line_id)) AS first_at FROM sq GROUP BY ALL)"""
TOP10 = f"""WITH {SEQ} SELECT * FROM (SELECT test_id, sequence, n,
 row_number() OVER (PARTITION BY test_id ORDER BY n DESC, first_at) AS rank FROM sc) WHERE rank <= 10"""
AI_SEQ = f"""WITH {FRAME}, w AS (SELECT *, lead(descr) OVER o AS d1, lead(descr, 2) OVER o AS d2 FROM frame
  WINDOW o AS (PARTITION BY test_id ORDER BY ts_text, line_id, part, pos)),
 c AS (SELECT test_id, descr || '->' || d1 || '->' || d2 AS sequence, count(*) AS n, min((ts_text, line_id, part, pos)) AS first_at
  FROM w WHERE d2 IS NOT NULL GROUP BY ALL)
SELECT * FROM (SELECT test_id, sequence, n, row_number() OVER (PARTITION BY test_id ORDER BY n DESC, first_at) AS rank FROM c)
WHERE rank <= 20"""
SEQ_SUMMARY = f"""SELECT s.*, top_size, first_top, ai_size, first_ai FROM (WITH {SEQ}
 SELECT test_id, sum(n) AS total, count(*) AS n_unique,
  greatest(ln(sum(n)) - sum(n * ln(n)) / sum(n), 0.0) AS entropy FROM sc GROUP BY test_id) s
 LEFT JOIN (SELECT test_id, count(*) AS top_size, min_by(sequence, rank) AS first_top FROM ({TOP10}) GROUP BY 1) USING (test_id)
 LEFT JOIN (SELECT test_id, count(*) AS ai_size, min_by(sequence, rank) AS first_ai FROM ({AI_SEQ}) GROUP BY 1) USING (test_id)"""

EDGES = f"""{FSM}, edges AS (SELECT * FROM (SELECT test_id, fsm_name, from_state, to_state, count(*) AS n,
  min((ts_ns, line_id)) AS first_at, max((ts_ns, line_id)) AS last_at FROM fsm GROUP BY ALL)
  QUALIFY sum(n) OVER (PARTITION BY test_id, fsm_name) >= 2),
 visits AS (SELECT test_id, fsm_name, state, sum(n) AS visits FROM (
  SELECT test_id, fsm_name, from_state AS state, n FROM edges UNION ALL
  SELECT test_id, fsm_name, max_by(to_state, last_at), 1 FROM edges GROUP BY test_id, fsm_name) GROUP BY ALL)"""
CYCLES = f"""WITH RECURSIVE {EDGES}, path AS (
 SELECT test_id, fsm_name, from_state AS start, to_state AS cur, [from_state] AS states FROM edges WHERE to_state >= from_state
 UNION ALL SELECT p.test_id, p.fsm_name, p.start, e.to_state, list_append(p.states, p.cur) FROM path p
 JOIN edges e ON e.test_id = p.test_id AND e.fsm_name = p.fsm_name AND e.from_state = p.cur
 WHERE p.cur > p.start AND len(p.states) < 5 AND e.to_state >= p.start AND e.to_state <> p.cur
  AND NOT list_contains(p.states[2:], e.to_state))
SELECT test_id, fsm_name, len(states) AS length, array_to_string(states, '->') AS cycle FROM path WHERE cur = start"""
FSM_SUMMARY = f"""WITH RECURSIVE {EDGES}, reach(test_id, fsm_name, a, b) AS (
 SELECT test_id, fsm_name, from_state, to_state FROM edges UNION
 SELECT r.test_id, r.fsm_name, r.a, e.to_state FROM reach r JOIN edges e ON e.test_id = r.test_id AND e.fsm_name = r.fsm_name AND e.from_state = r.b)
SELECT t.*, n_states, coalesce(n_self_loops, 0) AS n_self_loops,
 coalesce(n_two_cycles, 0) AS n_two_cycles, coalesce(n_cycles, 0) AS n_cycles, 
 (test_id, fsm_name) IN (SELECT (test_id, fsm_name) FROM reach WHERE a = b) AS has_cycles FROM (
 SELECT test_id, fsm_name, sum(n) AS total, count(*) AS n_transitions, min_by(from_state, first_at) AS start_state,
  max_by(to_state, last_at) AS end_state, greatest(ln(sum(n)) - sum(n * ln(n)) / sum(n), 0.0) AS entropy
 FROM edges GROUP BY test_id, fsm_name) t
 JOIN (SELECT test_id, fsm_name, count(*) AS n_states FROM visits GROUP BY ALL) USING (test_id, fsm_name)
 LEFT JOIN (SELECT test_id, fsm_name, count(*) FILTER (length = 1) AS n_self_loops, count(*) FILTER (length = 2) AS n_two_cycles,
  count(*) AS n_cycles FROM ({CYCLES}) GROUP BY ALL) USING (test_id, fsm_name)"""

RATIO = "CASE WHEN count(*) FILTER (is_write) > 0 THEN count(*) FILTER (is_read) / count(*) FILTER (is_write) ELSE CAST('inf' AS DOUBLE) END"
RW = f"""WITH {ACC} SELECT test_id, descr, count(*) FILTER (is_read) AS reads, count(*) FILTER (is_write) AS writes,
 {RATIO} AS rw_ratio FROM acc GROUP BY test_id, descr"""
INTERVALS = f"""WITH {ACC}, g AS (SELECT *, ts_ns - lag(ts_ns) OVER (PARTITION BY test_id, descr, action ORDER BY line_id) AS kg,
  ts_ns - lag(ts_ns) OVER (PARTITION BY test_id, descr ORDER BY ts_ns, line_id) AS ag FROM acc)
SELECT test_id, descr, avg(kg) FILTER (is_read) / 1e9 AS read_mean_interval, stddev_pop(kg) FILTER (is_read) / 1e9 AS read_std_interval,
 avg(kg) FILTER (is_write) / 1e9 AS write_mean_interval, stddev_pop(kg) FILTER (is_write) / 1e9 AS write_std_interval,
 avg(ag) / 1e9 AS mean_interval, stddev_pop(ag) / 1e9 AS std_interval, max(ag) / 1e9 AS max_interval,
 CASE WHEN max(ts_ns) > min(ts_ns) THEN count(*) / ((max(ts_ns) - min(ts_ns)) / 1e9) ELSE 0.0 END AS access_frequency
FROM g GROUP BY test_id, descr HAVING count(*) >= 3"""
BURSTS = f"""WITH {ACC}, g AS (SELECT *, CASE WHEN ts_ns - lag(ts_ns) OVER (PARTITION BY test_id, descr ORDER BY ts_ns, line_id)
  <= {BURST_GAP_NS} THEN 0 ELSE 1 END AS s FROM acc),
 i AS (SELECT *, sum(s) OVER (PARTITION BY test_id, descr ORDER BY ts_ns, line_id) AS burst FROM g)
SELECT test_id, descr, min(ts_ns) AS start_ns, max(ts_ns) AS end_ns, count(*) AS length FROM i
GROUP BY test_id, descr, burst HAVING count(*) >= 2"""
BURST_STATS = f"""SELECT test_id, descr, count(*) AS n_bursts, avg(length) AS mean_len, max(length) AS max_len,
 sum(length) AS total_accesses FROM ({BURSTS}) GROUP BY test_id, descr"""

BINS = f"""{ACC}, b AS (SELECT a.*, ((ts_ns - t0) * 100 + (t1 - t0) - 1) // (t1 - t0) - 1 AS bin FROM acc a JOIN (
  SELECT test_id, min(ts_ns) AS t0, max(ts_ns) AS t1 FROM acc GROUP BY 1) USING (test_id) WHERE ts_ns > t0),
 bins AS (SELECT test_id, bin, coalesce(r, 0) AS reads, coalesce(w, 0) AS writes FROM
  (SELECT DISTINCT test_id FROM acc) CROSS JOIN (SELECT unnest(range(0, 100)) AS bin)
  LEFT JOIN (SELECT test_id, bin, count(*) FILTER (is_read) AS r, count(*) FILTER (is_write) AS w FROM b GROUP BY ALL)
  USING (test_id, bin))"""
PHASES = f"""WITH {BINS}, l AS (SELECT *, CASE WHEN reads + writes = 0 THEN 'idle' WHEN reads + writes >
  avg(reads + writes) OVER (PARTITION BY test_id) THEN 'high' ELSE 'low' END AS label FROM bins),
 s AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY test_id ORDER BY bin) = label THEN 0 ELSE 1 END AS s FROM l),
 p AS (SELECT *, sum(s) OVER (PARTITION BY test_id ORDER BY bin) AS phase FROM s)
SELECT test_id, phase, label, min(bin) AS start_bin, max(bin) AS end_bin, avg(reads) AS mean_reads, avg(writes) AS mean_writes
FROM p GROUP BY test_id, phase, label"""
ACF = f"""WITH {BINS}, c AS (SELECT test_id, bin, reads - avg(reads) OVER (PARTITION BY test_id) AS r,
  writes - avg(writes) OVER (PARTITION BY test_id) AS w FROM bins),
 v AS (SELECT test_id, sum(r * r) AS vr, sum(w * w) AS vw FROM c GROUP BY 1),
 a AS (SELECT x.test_id, lag, sum(x.r * y.r) AS ar, sum(x.w * y.w) AS aw FROM c x CROSS JOIN (SELECT unnest(range(0, 11)) AS lag)
  JOIN c y ON y.test_id = x.test_id AND y.bin = x.bin + lag GROUP BY ALL),
 q AS (SELECT test_id, lag, CASE WHEN vr > 0 THEN ar / vr ELSE 0.0 END AS read_r, CASE WHEN vw > 0 THEN aw / vw ELSE 0.0 END AS write_r
  FROM a JOIN v USING (test_id))
SELECT *, bool_or(lag > 0 AND (abs(read_r) > 0.5 OR abs(write_r) > 0.5)) OVER (PARTITION BY test_id) AS periodic FROM q"""
PEAK = f"WITH {BINS} SELECT test_id, min_by(bin, (-(reads + writes), bin)) AS peak_bin FROM bins GROUP BY test_id"
ACTIVITY = f"""SELECT * FROM (WITH {ACC} SELECT test_id, (max(ts_ns) - min(ts_ns)) / 1e9 AS duration_s, count(*) AS total,
  CASE WHEN max(ts_ns) > min(ts_ns) THEN count(*) / ((max(ts_ns) - min(ts_ns)) / 1e9) ELSE 0.0 END AS rate,
  count(*) FILTER (is_read) AS reads, count(*) FILTER (is_write) AS writes, {RATIO} AS rw_ratio FROM acc GROUP BY test_id)
 JOIN ({PEAK}) USING (test_id) JOIN (SELECT test_id, count(*) AS n_phases FROM ({PHASES}) GROUP BY 1) USING (test_id)
 JOIN (SELECT DISTINCT test_id, periodic FROM ({ACF})) USING (test_id)"""

CONTEXT = f"""{ACC}, {ERR}, ctx AS (SELECT e.test_id, e.line_id, e.ts_ns, e.message, count(a.ts_ns) AS context_size
  FROM err e LEFT JOIN acc a ON a.test_id = e.test_id AND a.ts_ns BETWEEN e.ts_ns - {CONTEXT_NS} AND e.ts_ns GROUP BY ALL)"""
ERROR_SUMMARY = f"""WITH {CONTEXT}, {RUNS} SELECT r.test_id, count(c.line_id) AS error_count, min(c.ts_ns) AS first_ns,
 max(c.ts_ns) AS last_ns, avg(c.context_size) AS avg_context_size FROM runs r LEFT JOIN ctx c USING (test_id) GROUP BY r.test_id"""


def _ngrams(tokens: str) -> str:
    return (f"list_concat(list_concat({tokens}, [{tokens}[i] || ' ' || {tokens}[i + 1] for i in range(1, len({tokens}))]),"
            f" [{tokens}[i] || ' ' || {tokens}[i + 1] || ' ' || {tokens}[i + 2] for i in range(1, len({tokens}) - 1)])")


def _words(text: str, shortest: int = 2) -> str:
    size = "{2,}" if shortest == 2 else "+"
    return (f"list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{size}'),"
            f" lambda x: NOT list_contains({_stop_list()}, x))")


def _weights(corpus: str, doc: str, cap: int) -> str:
    """CTEs weighing ``tf(corpus, doc, mult, term, tf)`` against ``sizes(corpus, n_docs)``."""
    return f"""voc AS (SELECT * FROM (SELECT {corpus}, term, sum(mult) AS df, sum(mult * tf) AS corpus_tf,
  row_number() OVER (PARTITION BY {corpus} ORDER BY sum(mult * tf) DESC, term) AS term_no FROM tf GROUP BY {corpus}, term)
  WHERE term_no <= {cap}),
 wt AS (SELECT {corpus}, {doc}, mult, term, tf * (ln((1 + n_docs) / (1 + df)) + 1) AS w FROM tf JOIN voc USING ({corpus}, term)
  JOIN sizes USING ({corpus})),
 weights AS (SELECT {corpus}, {doc}, mult, term, w / sqrt(sum(w * w) OVER (PARTITION BY {corpus}, {doc})) AS weight FROM wt)"""


def _term_ctes() -> str:
    return f"""{FRAME}, descrs AS (SELECT test_id, descr, count(*) AS mult, min((part, line_id, pos)) AS first_at,
  arg_min_null(address, (part, line_id, pos)) AS address FROM frame GROUP BY test_id, descr),
 toks AS (SELECT test_id, descr, mult, {_words('descr')} AS t FROM descrs),
 grams AS (SELECT test_id, descr, mult, unnest({_ngrams('t')}) AS term FROM toks),
 tf AS (SELECT test_id, descr, mult, term, count(*) AS tf FROM grams GROUP BY ALL),
 sizes AS (SELECT test_id, sum(mult) AS n_docs FROM descrs GROUP BY 1),
 {_weights('test_id', 'descr', 1000)},
 terms AS (SELECT * FROM (SELECT test_id, term, sum(mult * weight) AS score, row_number() OVER (PARTITION BY test_id
  ORDER BY round(sum(mult * weight), 9) DESC, term) AS rank FROM weights GROUP BY test_id, term) WHERE rank <= 100),
 hits AS (SELECT d.test_id, d.descr, first_at, address, min_by(term, rank) AS term, min_by(score, rank) AS score,
  min(rank) AS term_rank FROM descrs d JOIN terms t ON t.test_id = d.test_id AND contains(d.descr, t.term) GROUP BY ALL),
 tops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY term_rank, first_at) AS rank FROM hits)
  WHERE rank <= 50)"""


VECTORS = f"""{ACC}, vec AS (SELECT test_id, descr, count(*) FILTER (is_read) AS reads, count(*) FILTER (is_write) AS writes,
  count(value) AS n_values, coalesce(avg(value), 0) AS mean_value, coalesce(stddev_pop(value), 0) AS std_value,
  CASE WHEN count(*) FILTER (is_read) > 1 THEN (max_by(ts_ns, line_id) FILTER (is_read) - min_by(ts_ns, line_id) FILTER (is_read))
   / 1e9 / (count(*) FILTER (is_read) - 1) ELSE 0.0 END AS read_gap,
  CASE WHEN count(*) FILTER (is_write) > 1 THEN (max_by(ts_ns, line_id) FILTER (is_write) - min_by(ts_ns, line_id) FILTER (is_write))
   / 1e9 / (count(*) FILTER (is_write) - 1) ELSE 0.0 END AS write_gap, min(line_id) AS first_at
  FROM acc GROUP BY test_id, descr HAVING count(*) >= 3)"""
DIMS = ["reads", "writes", "n_values", "mean_value", "std_value", "read_gap", "write_gap"]
_SCALE = ", ".join(f"({d} - avg({d}) OVER p) / CASE WHEN stddev_pop({d}) OVER p > 0 THEN stddev_pop({d}) OVER p ELSE 1 END AS {d}"
                   for d in DIMS)
SCALED = f"{VECTORS}, sv AS (SELECT test_id, descr, first_at, {_SCALE} FROM vec WINDOW p AS (PARTITION BY test_id))"
_DIST = " + ".join(f"(a.{d} - b.{d}) * (a.{d} - b.{d})" for d in DIMS)


def _clusters(scaled: str, eps: float, columns: str) -> str:
    """Density clusters of ``sv`` within each test_id: neighbours, core points, what these reach, the earliest one of it."""
    return f"""WITH RECURSIVE {scaled}, nb AS MATERIALIZED (SELECT a.test_id, a.first_at AS a, b.first_at AS b FROM sv a
  JOIN sv b ON a.test_id = b.test_id AND {_DIST} <= {eps * eps}),
 core AS MATERIALIZED (SELECT test_id, a FROM nb GROUP BY test_id, a HAVING count(*) >= 5),
 ce AS MATERIALIZED (SELECT nb.* FROM nb JOIN core x ON x.test_id = nb.test_id AND x.a = nb.a JOIN core y ON y.test_id = nb.test_id
  AND y.a = nb.b),
 reach AS (SELECT test_id, a, a AS b FROM core UNION SELECT r.test_id, r.a, e.b FROM reach r JOIN ce e
  ON e.test_id = r.test_id AND e.a = r.b),
 num AS (SELECT test_id, a, dense_rank() OVER (PARTITION BY test_id ORDER BY root) - 1 AS cluster_id FROM
  (SELECT test_id, a, min(b) AS root FROM reach GROUP BY test_id, a)),
 lab AS (SELECT nb.test_id, nb.a, coalesce(min(own.cluster_id), min(num.cluster_id)) AS cluster_id FROM nb
  JOIN num ON num.test_id = nb.test_id AND num.a = nb.b
  LEFT JOIN num own ON own.test_id = nb.test_id AND own.a = nb.a GROUP BY nb.test_id, nb.a)
SELECT {columns}, cluster_id FROM lab JOIN sv ON sv.test_id = lab.test_id AND sv.first_at = lab.a"""


CLUSTERS = _clusters(SCALED, QUERY_EPS, "sv.test_id, sv.descr, sv.first_at")
# All runs as one group, at the operator's own radius.
CORPUS_SCALED = f"{VECTORS}, sv AS (SELECT 'all' AS test_id, test_id AS run, descr, first_at, {_SCALE} FROM vec WINDOW p AS ())"
CORPUS_CLUSTERS = _clusters(CORPUS_SCALED, EPS, "sv.run AS test_id, sv.descr")
VALUE_VECTORS = f"""WITH {ACC}, st AS (SELECT test_id, descr, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min,
  max(value) AS max, max(value) - min(value) AS range, count(*) AS n FROM acc GROUP BY test_id, descr HAVING count(*) >= 3),
 r AS (SELECT test_id, descr, value, min AS lo, max AS hi, (CAST(max AS DOUBLE) - min) / 10 AS step, CASE WHEN max > min THEN
  CAST(least(floor((CAST(value AS DOUBLE) - min) / (max - min) * 10), 9) AS INTEGER) END AS b FROM acc JOIN st USING (test_id, descr)),
 h AS (SELECT test_id, descr, CASE WHEN b IS NULL THEN 5 WHEN value < lo + b * step THEN b - 1
  WHEN b < 9 AND value >= lo + (b + 1) * step THEN b + 1 ELSE b END AS bin, count(*) AS n FROM r GROUP BY ALL),
 e AS (SELECT test_id, descr, greatest(ln(sum(n)) - sum(n * ln(n)) / sum(n), 0.0) AS entropy FROM h GROUP BY ALL)
SELECT * FROM st JOIN e USING (test_id, descr)"""


def _importance() -> str:
    return f"""WITH ev1 AS (SELECT test_id, descr, 1 AS src, rank AS a, 0 AS b, score AS importance, 'terms' AS source,
  'High TF-IDF score (' || printf('%.4f', score) || ') - contains term ''' || term || '''' AS reason FROM (WITH {_term_ctes()} SELECT * FROM tops)
 UNION ALL SELECT test_id, descr, 2, cluster_id, no, 0.7, 'cluster', 'Part of access pattern cluster ' || cluster_id FROM (
  SELECT *, row_number() OVER (PARTITION BY test_id, cluster_id ORDER BY first_at) AS no FROM ({CLUSTERS})) WHERE no <= 20
 UNION ALL SELECT test_id, unnest(string_split(sequence, '->')), 3, rank, unnest([0, 1, 2]), n / 10, 'sequence',
  'Part of common access sequence (occurs ' || n || ' times)' FROM ({AI_SEQ}))
SELECT * FROM ev1 QUALIFY row_number() OVER (PARTITION BY test_id, descr ORDER BY src, a, b) = 1"""


PIECES = f"""{ACC}, docs AS (SELECT test_id, lower(string_agg(descr, ' ' ORDER BY line_id)) AS doc FROM acc GROUP BY 1),
 pieces AS (SELECT test_id, regexp_extract_all(doc, '{PIECE}') AS p FROM docs)"""


def _melted(family: str, entity: str, body: str, features: list[str]) -> str:
    names = ", ".join(f"'{f}'" for f in features)
    values = ", ".join(f'CAST("{f}" AS DOUBLE)' for f in features)
    return (f"SELECT test_id, '{family}' AS family, {entity} AS entity, unnest([{names}]) AS feature,"
            f" unnest([{values}]) AS value FROM ({body})")


VALUE_FEATURES = ["n", "min", "max", "mean", "median", "std", "n_unique", "range", "mean_popcount", "mean_hamming",
                  "mean_diff", "max_diff", "diff_std", "n_transitions", "change_frequency", "importance"]
PATTERNS = f"SELECT * FROM ({RW}) LEFT JOIN ({INTERVALS}) USING (test_id, descr)"
MELTED = " UNION ALL ".join([
    _melted("register_values", "descr", VALUES, VALUE_FEATURES),
    _melted("register_sequences", "''", SEQ_SUMMARY, ["total", "n_unique", "entropy"]),
    _melted("fsm_transitions", "fsm_name", FSM_SUMMARY, ["total", "n_transitions", "n_states", "entropy", "n_self_loops",
                                                         "n_two_cycles", "n_cycles"]),
    _melted("register_access_patterns", "descr", PATTERNS, [
        "reads", "writes", "rw_ratio", "read_mean_interval", "read_std_interval", "write_mean_interval",
        "write_std_interval", "mean_interval", "std_interval", "max_interval", "access_frequency"]),
    _melted("register_access_patterns", "descr", BURST_STATS, ["n_bursts", "mean_len", "max_len", "total_accesses"]),
    _melted("temporal_patterns", "''", ACTIVITY, ["duration_s", "total", "rate", "reads", "writes", "rw_ratio", "peak_bin",
                                                  "n_phases", "periodic"]),
    _melted("error_contexts", "''", f"SELECT *, first_ns / 1e9 AS first_s, last_ns / 1e9 AS last_s FROM ({ERROR_SUMMARY})",
            ["error_count", "first_s", "last_s", "avg_context_size"]),
])


def _long(melted: str) -> str:
    return f"{EV}, {RUNS}, lf AS MATERIALIZED (SELECT m.*, status FROM ({melted}) m JOIN runs USING (test_id) WHERE value IS NOT NULL)"


def _triage(melted: str, only: str = "TRUE") -> str:
    return f"""{_long(melted)}, fin AS (SELECT * EXCLUDE (value), round(value, 9) AS value FROM lf
  WHERE NOT isnan(value) AND NOT isinf(value) AND {only}),
 base AS MATERIALIZED (SELECT family, entity, feature, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS support,
  quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.95) AS p95 FROM fin WHERE status = 'PASS' GROUP BY ALL),
 met AS (SELECT f.test_id, family, entity, feature, value, mean, std, p05, p95, CASE WHEN std > 0 THEN (value - mean) / std END AS z,
  value < p05 OR value > p95 AS outside FROM fin f JOIN base USING (family, entity, feature) WHERE status = 'FAIL'),
 dev AS MATERIALIZED (SELECT * FROM met WHERE abs(z) > 3 OR outside)"""


BUCKETS = f"""{_triage(MELTED)}, {ERR}, fst AS (SELECT test_id, min_by(message, (ts_ns, line_id)) AS message FROM err GROUP BY 1),
 wst AS (SELECT test_id, min_by(entity, (z IS NOT NULL, -round(coalesce(abs(z), abs(value - mean)), 6), entity, feature)) AS register,
  max(abs(z)) AS max_z FROM dev WHERE family = 'register_values' GROUP BY 1),
 sig AS (SELECT r.test_id, coalesce(regexp_replace(regexp_replace(message, '0x[0-9a-fA-F]+', '<hex>', 'g'), '[0-9]+', '<n>', 'g'), '')
  AS message, coalesce(register, '') AS register, coalesce(max_z, 0) AS max_z FROM runs r LEFT JOIN fst USING (test_id)
  LEFT JOIN wst USING (test_id) WHERE status = 'FAIL'),
 bck AS (SELECT sha256(message || '|' || register) AS bucket_id, message, register, count(*) AS size,
  min(test_id) AS representative, max(max_z) AS max_z FROM sig GROUP BY message, register)"""


def _unseen(ctes: str, found: str, keys: str) -> str:
    return f"""WITH {ctes}, {RUNS}, f AS (SELECT DISTINCT test_id, status, {keys} FROM ({found}) JOIN runs USING (test_id))
SELECT test_id, {keys} FROM f WHERE status = 'FAIL' AND ({keys}) NOT IN (SELECT ({keys}) FROM f WHERE status = 'PASS')"""


def bodies() -> dict[str, str]:
    err_ev = f"{EV}, {ERR}"
    out = {
        "parse_access": f"WITH {ACC} SELECT * FROM acc",
        "parse_spanning": f"WITH {ACC} SELECT test_id, 4 * line_id AS line_id, pos, ts_ns, action, address, descr, value, comment FROM acc",
        "parse_spanning_marks": f"WITH {FSM}, {ERR} SELECT test_id, 4 * line_id AS line_id, fsm_name AS name, from_state || '->' || to_state AS what, ts_ns"
                                " FROM fsm UNION ALL SELECT test_id, 4 * line_id, 'error', message, ts_ns FROM err",
        "parse_fsm": f"WITH {FSM} SELECT * REPLACE (k % 4 AS ts_ns), 'generic' AS kind FROM fsm",
        "parse_errors": f"WITH {err_ev} SELECT * REPLACE (k % 4 AS ts_ns) FROM err",
        "asof_timestamp": f"WITH {FSM}, {ERR} SELECT test_id, line_id, 'fsm' AS kind, ts_ns FROM fsm UNION ALL"
                          " SELECT test_id, line_id, 'error', ts_ns FROM err",
        "run_status": f"WITH {EV}, {RUNS} SELECT * FROM runs",
        "run_status_counts": f"WITH {EV}, {RUNS} SELECT status, count(*) AS n FROM runs GROUP BY status",
        "analysis_union": f"WITH {FRAME} SELECT * FROM frame",
        "access_flags": f"WITH {ACC} SELECT *, TRUE AS is_array, FALSE AS is_fsm_related,"
                        " contains(descr, 'error') OR contains(descr, 'status') AS is_status FROM acc",
        "register_arrays": f"WITH {FRAME} SELECT test_id, split_part(descr, '[', 1) AS array_name,"
                           " min_by(descr, (part, line_id, pos)) AS example, 0.8 AS importance,"
                           " 'Register array detected' AS reason FROM frame WHERE part = 0 GROUP BY 1, 2",
        "hex_values": f"WITH {ACC} SELECT *, value AS value_d, value AS value_bits FROM acc",
        "relative_time": f"WITH {FRAME} SELECT *, (ts_ns - min(ts_ns) OVER (PARTITION BY test_id)) / 1e9 AS relative_time FROM frame",
        "register_value_stats": VALUES, "register_diff_stats": VALUES, "bit_stats": VALUES,
        "value_transitions": f"WITH {ACC} SELECT test_id, descr, count(DISTINCT (prev, value)) AS n_transitions FROM (SELECT *,"
                             " lag(value) OVER (PARTITION BY test_id, descr ORDER BY line_id) AS prev FROM acc)"
                             " WHERE prev IS NOT NULL GROUP BY 1, 2",
        "sequence_windows": f"WITH {SEQ} SELECT test_id, line_id, concat_ws(',', descr, d1, d2) AS registers,"
                            " concat_ws(',', action, a1, a2) AS actions, concat_ws(',', value_hex, v1, v2) AS values,"
                            " ts_ns AS start_ns, t2 AS end_ns, t2 - ts_ns AS duration_ns FROM w WHERE d2 IS NOT NULL",
        "sequence_top10": TOP10, "sequence_summary": SEQ_SUMMARY, "text_order_sequences": AI_SEQ,
        "fsm_summary": FSM_SUMMARY,
        "fsm_transitions": f"WITH {EDGES} SELECT *, from_state || '->' || to_state AS edge FROM edges",
        "fsm_state_visits": f"WITH {EDGES} SELECT * FROM visits",
        "fsm_matrix": f"WITH {EDGES}, st AS (SELECT test_id, fsm_name, from_state AS s FROM edges UNION SELECT test_id, fsm_name,"
                      " to_state FROM edges) SELECT x.test_id, x.fsm_name, x.s AS from_state, y.s AS to_state, coalesce(n, 0) AS n"
                      " FROM st x JOIN st y USING (test_id, fsm_name) LEFT JOIN edges e ON e.test_id = x.test_id AND"
                      " e.fsm_name = x.fsm_name AND e.from_state = x.s AND e.to_state = y.s",
        "fsm_cycles": CYCLES, "rw_ratio": RW, "interval_stats": INTERVALS, "bursts": BURSTS, "burst_stats": BURST_STATS,
        "run_activity": ACTIVITY, "activity_bins": f"WITH {BINS} SELECT * FROM bins", "peak_bin": PEAK,
        "activity_phases": PHASES, "autocorrelation": ACF,
        "error_context": f"WITH {CONTEXT} SELECT * FROM ctx",
        "error_context_rows": f"WITH {ACC}, {ERR} SELECT a.*, e.ts_ns AS err_ns FROM (SELECT DISTINCT test_id, ts_ns FROM err) e JOIN acc a"
                              f" ON a.test_id = e.test_id AND a.ts_ns BETWEEN e.ts_ns - {CONTEXT_NS} AND e.ts_ns",
        "error_summary": ERROR_SUMMARY,
        "error_messages": f"WITH {err_ev} SELECT * FROM err",
        "error_terms": f"WITH {err_ev}, t AS (SELECT test_id, {_words('message', 1)} AS w FROM err), g AS (SELECT test_id,"
                       " unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS term FROM t)"
                       " SELECT * FROM (SELECT test_id, term, count(*) AS n, row_number() OVER (PARTITION BY test_id"
                       " ORDER BY count(*) DESC, term) AS rank FROM g GROUP BY test_id, term) WHERE rank <= 10",
        "tfidf_terms": f"WITH {_term_ctes()} SELECT * FROM terms",
        "important_registers": f"WITH {_term_ctes()} SELECT * FROM hits",
        "doc_tfidf": f"WITH toks AS (SELECT 0 AS c, doc_id, 1 AS mult, {_words('text')} AS t FROM documents),"
                     f" grams AS (SELECT c, doc_id, mult, unnest({_ngrams('t')}) AS term FROM toks),"
                     " tf AS (SELECT c, doc_id, mult, term, count(*) AS tf FROM grams GROUP BY ALL),"
                     " sizes AS (SELECT 0 AS c, count(*) AS n_docs FROM documents),"
                     f" {_weights('c', 'doc_id', 500)} SELECT * FROM weights",
        "path_pieces": f"WITH {PIECES} SELECT test_id, piece, count(*) AS n FROM (SELECT test_id, unnest(p) AS piece FROM pieces) GROUP BY 1, 2",
        "test_embedding": f"WITH {PIECES}, toks AS (SELECT 0 AS c, test_id, 1 AS mult, list_filter(p, lambda x: NOT"
                          f" list_contains({_stop_list()}, x)) AS t FROM pieces),"
                          f" grams AS (SELECT c, test_id, mult, unnest({_ngrams('t')}) AS term FROM toks),"
                          " tf AS (SELECT c, test_id, mult, term, count(*) AS tf FROM grams GROUP BY ALL),"
                          " sizes AS (SELECT 0 AS c, count(*) AS n_docs FROM docs),"
                          f" {_weights('c', 'test_id', 500)} SELECT * FROM weights",
        "access_vectors": f"WITH {VECTORS} SELECT * FROM vec", "scaled_vectors": f"WITH {SCALED} SELECT * FROM sv",
        "access_clusters": CLUSTERS, "corpus_clusters": CORPUS_CLUSTERS,
        "value_vectors": VALUE_VECTORS, "value_entropy": VALUE_VECTORS,
        "register_importance": _importance(),
        "corpus_importance": f"SELECT descr, max(importance) AS importance FROM ({_importance()}) GROUP BY descr",
        "importance_tags": f"WITH {ACC} SELECT acc.*, importance AS ai_importance FROM acc LEFT JOIN ({_importance()}) i USING (test_id, descr)",
        "run_features": f"WITH {_long(MELTED)} SELECT * FROM lf",
        "baseline": f"WITH {_triage(MELTED)} SELECT * FROM base",
        "deviations": f"WITH {_triage(MELTED)} SELECT * FROM dev",
        "unseen_edges": _unseen(EDGES, "SELECT * FROM edges", "fsm_name, from_state, to_state"),
        "unseen_sequences": _unseen(SEQ, "SELECT * FROM sc", "sequence"),
        "unseen_registers": _unseen(ACC, "SELECT * FROM acc", "descr"),
        "failure_buckets": f"WITH {BUCKETS} SELECT * FROM bck",
        "triage_report": f"WITH {BUCKETS} SELECT * FROM (SELECT bucket_id, size, dev.test_id, family, entity, feature, value, z,"
                         " row_number() OVER (PARTITION BY bucket_id ORDER BY z IS NOT NULL, round(coalesce(abs(z), abs(value - mean)), 6) DESC,"
                         " dev.test_id, family, entity, feature) AS rank FROM bck JOIN sig USING (message, register) JOIN dev ON dev.test_id = sig.test_id)",
        "erratic_registers": f"""WITH {_triage(_melted('register_values', 'descr', VALUES, VALUE_FEATURES),
                                               "feature IN ('std', 'diff_std', 'mean_diff', 'change_frequency')")}
 SELECT * FROM (SELECT entity AS descr, feature, value AS failing_value, mean AS baseline_mean, z, test_id, row_number() OVER
 (PARTITION BY feature ORDER BY round(abs(z), 6) DESC, test_id, entity) AS rank FROM dev WHERE z IS NOT NULL) WHERE rank <= 20""",
    }
    return out


def oracle_sql() -> dict[str, str]:
    return {name: _shaped(body, QUERIES[name].columns) for name, body in bodies().items()}
