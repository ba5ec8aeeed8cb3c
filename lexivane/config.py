"""Default parameters."""

# Results depend on these exact numbers, texts and patterns.
VOCAB_SIZE = 150_000
SIF_COEFFICIENT = 1e-3
ZIPF_SIF_COEFFICIENT = 1e-4
N_SPLITS = 10
TEST_SIZE = 0.1
VAL_SIZE = 0.1
RANDOM_STATE = 51
MAX_LENGTH = 800
RECALL_THRESHOLDS = (5, 10, 20, 30)
TOP_K = 30
RRF_K = 60
STAGE1_K = 100
L2_EPSILON = 1e-12
BM25_K1 = 1.5
BM25_B = 0.75
OKAPI_EPSILON = 0.25
OKAPI_DUMMY_TERMS = 5
DEFAULT_PATTERN = r"\[unused\d+\]"
UPPER_CASE_PATTERN = r"\b\w*[A-Z]\w*\b"
EXOTIC_PATTERN = r"^(?!Ġ[a-zA-ZæøåÆØÅ0-9.,\s]*$)(?!<\|end_of_text\|>$).*[^a-zA-ZæøåÆØÅ0-9.,\s]"
UNCOMMON_PATTERN = r"^\d{2,}$|^Ġ{2,}.*|^\.|^Ġ.*\d.*\d|(?=.*[a-zA-Z])(?=.*\d)"
DANISH_INSTRUCTION = "Givet et spørgsmål, find relevante tekstudsnit, der besvarer det:"
EMBED_INSTRUCTION = "Given a web search query, retrieve relevant passages that answer the query"
INSTRUCTION_SEPARATOR = "!@#$%^&*()"
ACCENTED = "àáâãäèéêëìíîïòóôõöùúûüñç"
UNACCENTED = "aaaaaeeeeiiiiooooouuuunc"

# Our own limits and sizes; none of them changes a result.
UNKNOWN_TOKEN = "[UNK]"
BROADCAST_BYTES = 256 << 20
QUERY_BLOCK_BYTES = 64 << 20
ROWS_PER_BUCKET = 500_000
