"""Declared schemas and the fixed values that results depend on."""

from pyspark.sql import types as T

# Thresholds, caps and windows of the analyses (results depend on them).
MIN_ACCESSES = 3            # accesses or values a register needs before it gets statistics
MIN_TRANSITIONS = 2         # transitions a state machine needs
SEQ_LENGTH = 3              # steps of an access sequence
TOP_SEQUENCES = 10          # per run, feature sequences
TOP_AI_SEQUENCES = 20       # per run, intelligence sequences
TOP_TERMS = 100             # scored terms kept per run
TOP_REGISTERS = 50          # registers taken from term evidence
CLUSTER_MEMBERS = 20        # registers taken from each cluster
RUN_VOCABULARY = 1000       # terms per run
CORPUS_VOCABULARY = 500     # terms across runs
N_BINS = 100                # activity bins per run
HIST_BINS = 10              # value histogram bins
MAX_LAG = 10                # autocorrelation lags
BURST_GAP_NS = 1_000        # one microsecond
CONTEXT_NS = 1_000          # one microsecond before an error
EPS = 0.5                   # neighbourhood radius
MIN_POINTS = 5              # neighbours (self included) of a core point
N_TREES = 100
MAX_SAMPLES = 256
CONTAMINATION = 0.05
SEED = 42
PCA_DIMS = 10
CLUSTER_IMPORTANCE = 0.7
ARRAY_IMPORTANCE = 0.8
SLEEP_FSM = "SleepStateFSM"
READ, WRITE, TRANSITION = "MEM_R", "MEM_W", "FSM_TRANSITION"
PASS, FAIL, UNKNOWN = "PASS", "FAIL", "UNKNOWN"
TRACE_NAME, RUN_LOG_NAME, FAIL_MARK = "ptracker.log.gz", "jestr.log", "uvm_error"

# The pieces of a register path, and the reasons evidence is listed with.
PIECE = r"[^\[\]\.]+|\[\d+\]"
TERM_REASON = "High TF-IDF score (%.4f) - contains term '%s'"
CLUSTER_REASON = "Part of access pattern cluster %d"
SEQUENCE_REASON = "Part of common access sequence (occurs %d times)"
ARRAY_REASON = "Register array detected"

# One log chunk holds this many line ids; ordered work never puts more in one task's group.
CHUNK_LINES = 1 << 20

RUNS = T.StructType([
    T.StructField("test_id", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("log_path", T.StringType()),
    T.StructField("status", T.StringType()),
])
RAW_LINES = T.StructType([
    T.StructField("test_id", T.StringType()),
    T.StructField("line_id", T.LongType()),
    T.StructField("raw", T.StringType()),
])
ACCESS_COLUMNS = [
    "test_id", "line_id", "pos", "ts_ns", "ts_text", "action", "address", "size", "descr",
    "value_hex", "value", "value_d", "value_bits", "comment", "raw", "is_read", "is_write",
    "is_array", "is_fsm_related", "is_status",
]
FSM_COLUMNS = ["test_id", "line_id", "pos", "ts_ns", "ts_text", "fsm_name", "from_state",
               "to_state", "kind", "raw"]
ERR_COLUMNS = ["test_id", "line_id", "pos", "ts_ns", "ts_text", "message", "raw"]
