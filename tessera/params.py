"""Default parameters of indexing, search and evaluation."""

EMBEDDING_DIM = 2560
CHUNK_WORDS, CHUNK_KEEP_OVER, HEADER_SPLIT_OVER, TITLE_CHARS = 512, 10, 50, 200
RRF_K, RRF_WEIGHT = 20, 30.0
PHRASE_BONUS, TERM_BONUS, INDEX_PENALTY = 0.3, 0.15, -0.5
DIVERSITY_DECAY, RERANK_FACTOR, SEARCH_LIMIT = 0.95, 2, 10
DENSITY_THRESHOLD, DENSITY_CHARS, TOC_CHARS = 0.55, 1000, 600
CACHE_THRESHOLD, CACHE_SIZE, CACHE_TTL_S = 0.92, 500, 3600
CUTOFFS, RELEVANT, ALPHA, POOL_DEPTH = (1, 3, 5, 10), 2, 0.5, 20
BM25_K1, BM25_B, IDF_FLOOR = 1.2, 0.75, 1e-6
RESERVED_PROJECTS = ("help", "projects", "remove", "list", "index", "search", "download")

# How a reranker's input shrinks, as shares of its texts and as characters of a text; and of a judge.
RERANK_KEEP = (1.0, 0.75, 0.5, 0.35, 0.25)
RERANK_BUDGETS = (3000, 2000, 1400, 1000, 800, 600, 450)
SHORT_HEAD, SHORT_HEAD_MIN, SHORT_MARK = 0.72, 200, "\n...\n"
JUDGE_CHARS, JUDGE_CHARS_AGAIN, JUDGE_SURE, JUDGE_BORDERLINE = 1500, 1400, 0.7, (1, 2)
