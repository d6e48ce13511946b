"""Fixed values that must equal the reference's for right results.

All patterns are written in the subset that both Java regex (Spark) and RE2
(DuckDB, the oracle) accept: no look-around, ``[^\\n]`` instead of ``.`` (Java's
dot also stops at CR and Unicode line separators), ``[\\s\\S]`` instead of the
dot-all flag.  ``\\w``/``\\s`` are ASCII in both engines (documented choice).
"""

# --- fixed values: comment patterns (line comment needs a space after // for
# the newline-keeping and the removing stripper, not for the layout keeper) ---
COMMENT_SPACED = r"// [^\n]*|/\*[\s\S]*?\*/"
COMMENT_ANY = r"//[^\n]*|/\*[\s\S]*?\*/"

# --- fixed values: test-case id from a file name (primary, then fallback) ---
GROUP_PRIMARY = r"^(CWE[0-9]+_[^_]+(?:_[^_]+)*?)(?:_[0-9]+[a-z]?)?(?:_bad|_good)?\.(?:c|cpp|java|cs)$"
GROUP_FALLBACK = r"_[0-9]+[a-z]?(?:_bad|_good)?$"

# --- fixed values: function header patterns on a trimmed line, group 1 = name ---
HEADER_C = r"^(?:static\s+)?(?:unsigned\s+\w+|\w+\s*\*?)\s+(\w+)\s*\([^)]*\)\s*(?:$|\{)"
HEADER_JAVA = (
    r"^(?:public|private|protected)?\s*(?:static)?\s*\w+(?:\[\])?\s+(\w+)\s*\([^)]*\)\s*"
    r"(?:throws\s+\w+(?:\s*,\s*\w+)*)?\s*(?:$|\{)"
)
HEADER_CS = r"^(?:public|private|protected|internal)?\s*(?:static)?\s*\w+(?:\[\])?\s+(\w+)\s*\([^)]*\)\s*\{"

# --- fixed values: trivial-wrapper test on a function body ---
BODY_LINE_COMMENT = r"//[^\n]*"
BODY_BLOCK_COMMENT = r"/\*[\s\S]*?\*/"
CALL_STATEMENT = r"\w+\s*\([^)]*\)\s*;"
MAX_WRAPPER_STATEMENTS = 2

# --- fixed values: whitespace removed by Python's str.strip() ---
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: extensions and language dispatch ---
ANALYSIS_EXTENSIONS = (".c", ".cpp", ".java", ".cs")
INGEST_EXTENSIONS = (".java", ".c", ".cpp")
LANGUAGE_BY_EXT = {".c": "c", ".cpp": "c", ".java": "java", ".cs": "cs"}

# --- fixed values: labels ---
POSITIVE = "POSITIVE"
NEGATIVE = "NEGATIVE"

# --- fixed values: split ids and ratios (training, testing, validation) ---
SPLIT_PERCENT = (70, 20, 10)
SPLIT_IDS = {"training": 0, "testing": 1, "validation": 2}

# --- fixed values: window and tensor shapes ---
WINDOW_LINES = 40
TOKENS_PER_LINE = 98
BATCH_SIZE = 40

# --- fixed values: analytics ---
DEFAULT_THRESHOLDS = (10, 15, 20)
NOTEBOOK_THRESHOLDS = (10, 15, 20, 25, 30, 35, 40, 50, 213)
HIST_BINS = 50
LABEL_HIST_EDGES = 30
WHISKER = 1.5

# --- fixed values: evaluation ---
BCE_LOG_FLOOR = -100.0
WEIGHTED_BCE_ALPHA = 0.75
WEIGHTED_BCE_EPS = 1e-7
PATIENCE = 3
EPOCH_CAP = 40

# --- fixed values: hyper-parameter search space and halving schedule ---
SEARCH_LR = (1e-4, 1e-2)
SEARCH_BATCH = (32, 64, 128)
SEARCH_NODES = (128, 256, 512)
SEARCH_DROPOUT = (0.3, 0.6)
SEARCH_WEIGHT_DECAY = (1e-6, 1e-3)
SEARCH_TRIALS = 20
HALVING_GRACE = 5
HALVING_FACTOR = 2
HALVING_MAX_T = 20
