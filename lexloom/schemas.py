"""Fixed schemas and values shared by all modules."""

from __future__ import annotations

from pyspark.sql import types as T

# Source names and the system prompt appear in results as they stand here.
ALPACA_SOURCE = "beomi/KoAlpaca-v1.1a"
SHAREGPT_SOURCE = "dbdu/ShareGPT-74k-ko"
QA_SOURCE = "kikikara/ko_QA_dataset"
SYSTEM_PROMPT = "당신은 간결하고 정확한 한국어 어시스턴트입니다."
UNKNOWN_SOURCE = "unknown"
NULL_TEXT = "None"

# Defaults of the reports.
DEFAULT_TEXT_COLUMNS = ("text", "messages", "conversations", "instruction", "output")
DEFAULT_EVICTION_RATIO = 0.3
DEFAULT_TOP_K = 200
DEFAULT_REPORT_ROWS = 30
DEFAULT_SAMPLE_ROWS = 3
DEFAULT_SEED = 42
UNBOUNDED_LENGTH = 100_000

# Formats and texts of the reports.
REPORT_LINE = "%02d. TOKEN_ID=%d | STR='%s' | OCC=%d"
NO_COLUMNS = "컬럼 정보 없음"
NO_SAMPLE = "샘플 없음"
LOAD_FAILED = "로드 실패"
SINGLE_SPLIT = "single"

MESSAGE_TYPE = T.StructType(
    [
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)
MESSAGES_TYPE = T.ArrayType(MESSAGE_TYPE)
UNIFIED_SCHEMA = T.StructType(
    [
        T.StructField("messages", MESSAGES_TYPE),
        T.StructField("source", T.StringType()),
    ]
)

VOCAB_SCHEMA = T.StructType(
    [
        T.StructField("token_id", T.IntegerType()),
        T.StructField("token", T.StringType()),
        T.StructField("is_special", T.BooleanType()),
    ]
)

PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("splits", T.ArrayType(T.StringType())),
        T.StructField("schema", T.ArrayType(T.StringType())),
        T.StructField("sample", T.ArrayType(T.StringType())),
    ]
)

# Words for the table form of encoding: letter runs, single digits, symbol runs, whitespace runs.
WORD_PATTERN = r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|\s+"
