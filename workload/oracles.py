"""The same results in SQL, one statement per query."""

from __future__ import annotations

from lexloom.operators.order import FEISTEL_ROUNDS
from lexloom.schemas import (
    ALPACA_SOURCE,
    DEFAULT_EVICTION_RATIO,
    DEFAULT_SAMPLE_ROWS,
    DEFAULT_SEED,
    QA_SOURCE,
    SHAREGPT_SOURCE,
    SYSTEM_PROMPT,
    WORD_PATTERN,
)
from workload.inputs import SPECIAL_TOKENS, UNK_ID
from workload.queries import (
    DOCUMENT_RATIO,
    HEAD_ROWS,
    MISSING_TABLE,
    PLAIN_PROMPT,
    PROFILED,
    REPORT_ROWS,
    SPLIT_TABLE,
    SUMMARY_TOP_K,
    TRUNCATED_LENGTH,
)

SPACE = (
    r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# Decimal digits, superscripts, subscripts, circled and other digits, written out for the SQL alone.
ONLY_DIGITS = (
    r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒"
    r"\x{1369}-\x{1371}\x{19da}\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}]+$"
)
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
WORDS = f"regexp_extract_all(text, '{WORD_PATTERN}')"


def strip(column: str) -> str:
    return f"regexp_replace({column}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def query(*ctes: str, select: str) -> str:
    return f"WITH {', '.join(ctes)} {select}"


def words_cte(name: str, rows: str, keys: str, max_length: int | None = None) -> str:
    """Rows `(keys, pos, word)` of a relation with a `text` column."""
    words = WORDS if max_length is None else f"({WORDS})[1:{max_length}]"
    return (
        f"{name} AS (SELECT {keys}, unnest(w) AS word, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS pos "
        f"FROM (SELECT {keys}, {words} AS w FROM {rows}))"
    )


VOCAB = (
    words_cte("vocab_words", "documents", "doc_id"),
    f"""word_counts AS MATERIALIZED (SELECT word, count(*) AS cnt FROM vocab_words GROUP BY word)""",
    f"""vocab AS MATERIALIZED (
        SELECT CAST(place + {len(SPECIAL_TOKENS) - 1} AS INTEGER) AS token_id, word AS token, false AS is_special
        FROM (SELECT word, row_number() OVER (ORDER BY cnt DESC, word) AS place FROM word_counts)
        UNION ALL
        SELECT CAST(id AS INTEGER), token, true
        FROM (VALUES {", ".join(f"({i}, '{t}')" for i, t in enumerate(SPECIAL_TOKENS))}) s(id, token))""",
)

RULES = {
    "special": "is_special",
    "blank": f"NOT regexp_matches(token, '[^{SPACE}]')",
    "byte": "regexp_matches(token, '^<0x[0-9A-Fa-f]{2}>$')",
    "control": r"regexp_matches(token, '[\x00-\x1f]')",
    "digits": f"regexp_matches({strip('token')}, '{ONLY_DIGITS}')",
    "symbols": f"NOT regexp_matches({strip('token')}, '[a-zA-Z0-9가-힣]')",
    "space_marker": "(contains(token, 'Ġ') OR contains(token, '▁'))",
    "short": rf"regexp_matches({strip('token')}, '^[\p{{L}}\p{{N}}]{{1,2}}$')",
}
PRUNABLE = f"prunable AS (SELECT token_id, token FROM vocab WHERE NOT ({' OR '.join(RULES.values())}))"


def counts_ctes(rows: str, keys: list[str], max_length: int | None = None) -> tuple[str, ...]:
    """The vocabulary and `counts(token_id, cnt, seen)` of a relation."""
    key_list = ", ".join(keys)
    packed = ", ".join(f"{key} := {key}" for key in [*keys, "pos"])
    return (
        *VOCAB,
        words_cte("words", rows, key_list, max_length),
        f"""word_places AS MATERIALIZED (SELECT word, count(*) AS n, min(struct_pack({packed})) AS seen FROM words GROUP BY word)""",
        f"""counts AS MATERIALIZED (
            SELECT CAST(coalesce(token_id, {UNK_ID}) AS INTEGER) AS token_id, CAST(sum(n) AS BIGINT) AS cnt, min(seen) AS seen
            FROM word_places LEFT JOIN vocab ON word = vocab.token GROUP BY ALL)""",
    )


def flat_counts(keys: list[str]) -> str:
    seen = ", ".join(f"seen.{key} AS first_{key}" for key in [*keys, "pos"])
    return f"SELECT token_id, cnt, {seen} FROM counts"


CONVERSATION_KEYS = ["conv_id", "turn"]
CONVERSATION_ROWS = "(SELECT conv_id, CAST(turn AS INTEGER) AS turn, text FROM conversations)"
CONVERSATION_COUNTS = counts_ctes(CONVERSATION_ROWS, CONVERSATION_KEYS)


def evicted_ctes(ratio: float) -> tuple[str, ...]:
    return (
        PRUNABLE,
        """ranked AS (
            SELECT prunable.token_id, token, coalesce(cnt, 0) AS cnt, count(*) OVER () AS candidates,
                   row_number() OVER (
                       ORDER BY coalesce(cnt, 0), CASE WHEN cnt IS NULL THEN prunable.token_id END, seen DESC) AS place
            FROM prunable LEFT JOIN counts ON prunable.token_id = counts.token_id)""",
        f"""evicted AS (
            SELECT token_id, token, cnt FROM ranked
            WHERE place <= greatest(1, floor(candidates * CAST({ratio} AS DOUBLE))))""",
    )


TOP = f"""top AS (
    SELECT CAST(row_number() OVER (ORDER BY cnt DESC, seen) AS INTEGER) AS rank, token_id, cnt
    FROM counts ORDER BY rank LIMIT {SUMMARY_TOP_K})"""
RARE = f"""rare AS (
    SELECT CAST(row_number() OVER (ORDER BY cnt, seen DESC) AS INTEGER) AS rank, token_id, cnt
    FROM counts ORDER BY rank LIMIT {REPORT_ROWS})"""
UNUSED = "unused AS (SELECT token_id, token FROM vocab ANTI JOIN counts USING (token_id))"
FIRST_UNUSED = f"""first_unused AS (
    SELECT CAST(row_number() OVER (ORDER BY token_id) AS INTEGER) AS rank, token_id, token
    FROM unused ORDER BY rank LIMIT {REPORT_ROWS})"""


# Source shapes as rows `(row_order, sub_order, …)`

ALPACA = """alpaca AS (
    SELECT u.conv_id AS row_order, CAST(u.turn AS INTEGER) AS sub_order, u.text AS instruction, a.text AS output
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant')"""
SHAREGPT = """turns AS (
    SELECT doc_id AS row_order, 0 AS sub_order, unnest(lines) AS value,
           CAST(generate_subscripts(lines, 1) AS INTEGER) AS pos
    FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))"""
QA = """qa AS (
    SELECT doc_id AS row_order, 0 AS sub_order, string_split(text, chr(10))[1] AS input,
           array_to_string(string_split(text, chr(10))[2:], chr(10)) AS output
    FROM documents)"""
SHAPES = (ALPACA, SHAREGPT, QA)


def exchange(rows: str, question: str, answer: str, source: str, prompt: str = SYSTEM_PROMPT) -> str:
    parts = [
        (0, "system", f"'{prompt}'"),
        (1, "user", question),
        (2, "assistant", answer),
    ]
    return " UNION ALL ".join(
        f"SELECT row_order, sub_order, {pos} AS pos, '{role}' AS role, {content} AS content, {source} AS source "
        f"FROM {rows}"
        for pos, role, content in parts
    )


def system_only(rows: str, source: str) -> str:
    return (
        f"SELECT row_order, sub_order, 0 AS pos, 'system' AS role, '{SYSTEM_PROMPT}' AS content, {source} AS source "
        f"FROM {rows}"
    )


ALPACA_MESSAGES = exchange("alpaca", "instruction", "output", f"'{ALPACA_SOURCE}'")
SHAREGPT_MESSAGES = (
    system_only("(SELECT DISTINCT row_order, sub_order FROM turns)", f"'{SHAREGPT_SOURCE}'")
    + " UNION ALL SELECT row_order, sub_order, pos, "
    "CASE WHEN (pos - 1) % 3 = 0 THEN 'user' ELSE 'assistant' END, value, "
    f"'{SHAREGPT_SOURCE}' FROM turns"
)
QA_MESSAGES = exchange("qa", "input", "output", f"'{QA_SOURCE}'")
UNIFIED = f"""unified AS (
    SELECT 0 AS source_order, * FROM ({ALPACA_MESSAGES})
    UNION ALL SELECT 1, * FROM ({SHAREGPT_MESSAGES})
    UNION ALL SELECT 2, * FROM ({QA_MESSAGES}))"""
OTHERS = """
    benchmark_rows AS (SELECT item_id AS row_order, 0 AS sub_order, text AS input FROM benchmark),
    label_rows AS (SELECT doc_id AS row_order, 0 AS sub_order FROM labels),
    nation_rows AS (SELECT CAST(n_nationkey AS BIGINT) AS row_order, 0 AS sub_order, n_name AS output FROM nation)"""
UNIFIED_ROWS = """unified_rows AS (
    SELECT source_order, row_order, sub_order, source, CAST(count(*) AS INTEGER) AS messages,
           string_agg(role || ': ' || content, chr(10) ORDER BY pos) AS text,
           row_number() OVER (ORDER BY source_order, row_order, sub_order) - 1 AS row_no
    FROM unified GROUP BY source_order, row_order, sub_order, source)"""


def repr_of(column: str) -> str:
    """A string as Python shows it."""
    escaped = (
        rf"replace(replace(replace(replace({column}, '\', '\\'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')"
    )
    return (
        f"CASE WHEN contains({column}, '''') AND NOT contains({column}, '\"') THEN '\"' || {escaped} || '\"' "
        rf"ELSE '''' || replace({escaped}, '''', '\''') || '''' END"
    )


# Columns by table with their types in SQL.
PROFILE_COLUMNS = {
    "benchmark": "item_id bigint, text varchar",
    "conversations": "conv_id bigint, turn bigint, role varchar, text varchar",
    "customer": "c_custkey bigint, c_name varchar, c_nationkey integer, c_acctbal double, c_mktsegment varchar",
    "documents": "doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint",
    "embeddings": "vec_id bigint, embedding integer[], label integer",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar",
    "labels": "doc_id bigint, quality integer, toxic integer",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber integer, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag varchar, l_linestatus varchar, l_shipdate timestamp",
    "nation": "n_nationkey integer, n_name varchar, n_regionkey integer",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus varchar, o_totalprice double, o_orderdate timestamp, "
    "o_orderpriority varchar",
    "pages": "page_id bigint, url varchar, html varchar",
    "part": "p_partkey bigint, p_name varchar, p_brand varchar, p_type varchar, p_size integer, p_retailprice double",
    "region": "r_regionkey integer, r_name varchar",
    "supplier": "s_suppkey bigint, s_name varchar, s_nationkey integer, s_acctbal double",
}
SHOWN_TYPES = {"varchar": "string", "integer": "int", "integer[]": "array<int>", "timestamp": "timestamp_ntz"}


def profile_part(name: str, first: str, columns: str) -> list[str]:
    selects = []
    for pos, (column, kind) in enumerate(part.split(" ") for part in columns.split(", ")):
        shown = repr_of(column) if kind == "varchar" else f"CAST({column} AS VARCHAR)"
        if kind == "integer[]":
            thousandths = f"list_transform({column}, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS INTEGER))"
            shown = f"replace(CAST({thousandths} AS VARCHAR), ', ', ',')"
        typed = SHOWN_TYPES.get(kind, kind)
        selects.append(f"SELECT '{name}' AS name, 'schema' AS part, {pos} AS pos, '{column}: {typed}' AS line FROM {first}")
        selects.append(f"SELECT '{name}', 'sample', {pos}, '{column}: ' || {shown} FROM {first}")
    return selects


def profile_sql() -> str:
    selects = []
    for name, order in PROFILED.items():
        first = f"(SELECT * FROM {name} ORDER BY {order} LIMIT 1)"
        selects.append(f"SELECT '{name}' AS name, 'splits' AS part, 0 AS pos, 'single' AS line")
        selects += profile_part(name, first, PROFILE_COLUMNS[name])
    selects += [f"SELECT '{MISSING_TABLE}', '{part}', 0, 'cannot be read'" for part in ("schema", "sample")]
    selects.append(
        f"SELECT '{SPLIT_TABLE}', 'splits', CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER), lang "
        "FROM (SELECT DISTINCT lang FROM documents)"
    )
    first = "(SELECT * FROM documents ORDER BY lang, doc_id LIMIT 1)"
    selects += profile_part(SPLIT_TABLE, first, "doc_id bigint, text varchar, source varchar, n_chars bigint")
    return " UNION ALL ".join(selects)


# Unknown words of `words` and their pieces: the longest match at every place, then the places a walk from the left meets.
SEGMENTED = (
    "unknown AS (SELECT word FROM word_places WHERE word NOT IN (SELECT token FROM vocab))",
    "entries AS (SELECT token, min(token_id) AS token_id, length(token) AS n FROM vocab WHERE NOT is_special AND token <> '' GROUP BY token)",
    """matches AS MATERIALIZED (
        SELECT word, start, max(entries.n) AS n, arg_max(token_id, entries.n) AS token_id
        FROM (SELECT word, start, unnest(range(1, length(word) - start + 2)) AS n
              FROM (SELECT word, unnest(range(1, length(word) + 1)) AS start FROM unknown)) places
        JOIN entries ON token = substr(word, start, places.n) GROUP BY word, start)""",
    """walk AS (
        SELECT word, 0 AS pos, 1::BIGINT AS start FROM unknown
        UNION ALL
        SELECT walk.word, pos + 1, walk.start + coalesce(n, 1) FROM walk LEFT JOIN matches ON matches.word = walk.word AND matches.start = walk.start
        WHERE walk.start + coalesce(n, 1) <= length(walk.word))""",
    f"""pieces AS (
        SELECT walk.word, pos, walk.start, CAST(coalesce(token_id, {UNK_ID}) AS INTEGER) AS token_id
        FROM walk LEFT JOIN matches ON matches.word = walk.word AND matches.start = walk.start)""",
)


def all_oracles() -> dict[str, str]:
    conversation_ctes = CONVERSATION_COUNTS
    report = f"""
        SELECT 'unused_count' AS section, 0 AS rank, -1 AS token_id, '' AS token, count(*) AS value FROM unused
        UNION ALL SELECT s, rank, token_id, token, 0 FROM first_unused,
               (VALUES ('unused'), ('reassign_unused')) t(s)
        UNION ALL SELECT s, rank, rare.token_id, token, cnt FROM rare LEFT JOIN vocab USING (token_id),
               (VALUES ('low_frequency'), ('reassign_low_frequency')) t(s)"""
    unlisted = (
        *VOCAB,
        words_cte("page_words", "(SELECT page_id, html AS text FROM pages)", "page_id"),
        """incoming AS (
            SELECT row_number() OVER (ORDER BY cnt DESC, seen, word) - 1 AS rank, word AS token, cnt FROM (
                SELECT word, count(*) AS cnt, min(struct_pack(page_id := page_id, pos := pos)) AS seen
                FROM page_words WHERE word NOT IN (SELECT token FROM vocab) GROUP BY word))""",
    )
    pairs = (
        *conversation_ctes,
        *evicted_ctes(DEFAULT_EVICTION_RATIO),
        *unlisted[len(VOCAB) :],
        """freed AS (
            SELECT token_id, token AS replaced, row_number() OVER (ORDER BY token_id) - 1 AS rank FROM evicted)""",
        "pairs AS (SELECT token_id, replaced, token FROM freed JOIN incoming USING (rank))",
    )
    effects = (
        *pairs,
        "adapted AS (SELECT token_id, coalesce(pairs.token, vocab.token) AS token FROM vocab LEFT JOIN pairs USING (token_id))",
        "ids_before AS MATERIALIZED (SELECT token AS word, min(token_id) AS id_before FROM vocab GROUP BY token)",
        "ids_after AS MATERIALIZED (SELECT token AS word, min(token_id) AS id_after FROM adapted GROUP BY token)",
        """page_counts AS MATERIALIZED (
            SELECT page_id, word, id_before, id_after, n FROM (SELECT page_id, word, count(*) AS n FROM page_words GROUP BY page_id, word)
            LEFT JOIN ids_before USING (word) LEFT JOIN ids_after USING (word))""",
        "moved AS (SELECT * FROM page_counts WHERE id_before IS DISTINCT FROM id_after)",
    )
    mixed_text = """
        SELECT source, row_order, sub_order, 'None' || chr(10) || instruction || chr(10) || output AS text FROM (
            SELECT '{alpaca}' AS source, * FROM alpaca)
        UNION ALL SELECT '{sharegpt}', row_order, sub_order,
            string_agg(CASE (pos - 1) % 3 WHEN 0 THEN 'human' WHEN 1 THEN 'gpt' ELSE 'system' END || ': ' || value,
                       chr(10) ORDER BY pos) || chr(10) || 'None' || chr(10) || 'None'
            FROM turns GROUP BY row_order, sub_order
        UNION ALL SELECT '{qa}', row_order, sub_order,
            'None' || chr(10) || 'None' || chr(10) || output FROM qa""".format(
        alpaca=ALPACA_SOURCE, sharegpt=SHAREGPT_SOURCE, qa=QA_SOURCE
    )
    unified_ids = (
        "(SELECT source_order, row_order * 1048576 + sub_order AS row_no, text FROM unified_rows)"
    )
    ranked_token = "SELECT rank, t.token_id, token, cnt FROM {rows} t LEFT JOIN vocab ON t.token_id = vocab.token_id"
    conversation = CONVERSATION_COUNTS
    return {
        "chat_alpaca": query(ALPACA, select=ALPACA_MESSAGES),
        "chat_sharegpt": query(SHAREGPT, select=SHAREGPT_MESSAGES),
        "chat_qa": query(QA, select=exchange("qa", "input", "output", f"'{QA_SOURCE}'", PLAIN_PROMPT)),
        "unified_corpus": query(*SHAPES, UNIFIED, select="SELECT * FROM unified"),
        "unified_lazily": query(
            *SHAPES,
            OTHERS,
            select=" UNION ALL ".join(
                [
                    ALPACA_MESSAGES,
                    SHAREGPT_MESSAGES,
                    QA_MESSAGES,
                    system_only("benchmark_rows", "'benchmark'"),
                    system_only("label_rows", "'unknown'"),
                    system_only("nation_rows", "'None'"),
                ]
            ),
        ),
        "unified_unknown_as_qa": query(
            *SHAPES,
            OTHERS,
            select=" UNION ALL ".join(
                [
                    ALPACA_MESSAGES,
                    SHAREGPT_MESSAGES,
                    QA_MESSAGES,
                    exchange("benchmark_rows", "input", "'None'", "'benchmark'"),
                    exchange("label_rows", "'None'", "'None'", "''"),
                    exchange("nation_rows", "'None'", "output", "'None'"),
                ]
            ),
        ),
        "row_keys": query(
            *SHAPES,
            UNIFIED,
            UNIFIED_ROWS,
            select="SELECT source || '-' || row_no AS row_key, source, row_order, sub_order, messages "
            "FROM unified_rows",
        ),
        "message_text": query(
            *SHAPES,
            UNIFIED,
            UNIFIED_ROWS,
            select="SELECT source_order, row_order, sub_order, text FROM unified_rows",
        ),
        "text_columns": query(*SHAPES, select=mixed_text),
        "fallback_text": "SELECT p_partkey, p_partkey || ' ' || p_name || ' ' || p_brand || ' ' || p_type || ' ' || "
        "p_size || ' ' || p_retailprice AS text FROM part",
        "word_counts": query(*VOCAB[:2], select="SELECT word, cnt FROM word_counts"),
        "vocabulary_entries": query(*VOCAB, select="SELECT * FROM vocab"),
        "token_ids": query(
            *conversation[:-2],
            select=f"""SELECT conv_id, turn, pos, CAST(coalesce(token_id, {UNK_ID}) AS INTEGER) AS token_id
                FROM words LEFT JOIN vocab ON words.word = vocab.token""",
        ),
        "segmented_words": f"WITH RECURSIVE {', '.join((*conversation[:-1], *SEGMENTED))} SELECT word, pos, start - 1 AS start, token_id FROM pieces",
        "piece_counts": f"""WITH RECURSIVE {', '.join((*conversation[:-1], *SEGMENTED))}
            SELECT token_id, CAST(sum(n) AS BIGINT) AS cnt FROM (
                SELECT token_id, n FROM word_places JOIN vocab ON word = token
                UNION ALL SELECT pieces.token_id, n FROM word_places JOIN pieces USING (word))
            GROUP BY token_id""",
        "grown_counts": query(
            *VOCAB,
            words_cte(
                "words",
                "(SELECT 0 AS part_no, doc_id AS a, 0 AS b, text FROM documents UNION ALL SELECT 2, conv_id, turn, text FROM conversations)",
                "part_no, a, b",
            ),
            """word_places AS MATERIALIZED (
                SELECT word, count(*) AS n, min(struct_pack(part_no := part_no, a := a, b := b, pos := pos)) AS seen
                FROM words GROUP BY word)""",
            select=f"""SELECT token_id, cnt, seen.part_no::BIGINT AS part_no, seen.a AS a, seen.b AS b, seen.pos::BIGINT AS pos FROM (
                SELECT CAST(coalesce(token_id, {UNK_ID}) AS INTEGER) AS token_id, CAST(sum(n) AS BIGINT) AS cnt, min(seen) AS seen
                FROM word_places LEFT JOIN vocab ON word = token GROUP BY ALL)""",
        ),
        "drawn_rows": f"""
            WITH RECURSIVE sizes AS (
                SELECT count(*) AS n, greatest(1, (length(bin(greatest(count(*), 2) - 1)) + 1) // 2)::INTEGER AS half FROM documents
            ), walk AS (
                SELECT d AS draw, 0 AS turn, d >> half AS l, d & ((1::BIGINT << half) - 1) AS r
                FROM (SELECT unnest(range(0, least({DEFAULT_SAMPLE_ROWS}, n))) AS d, half FROM sizes)
                UNION ALL
                SELECT draw, CASE turn WHEN {FEISTEL_ROUNDS} THEN 0 ELSE turn + 1 END,
                    CASE turn WHEN {FEISTEL_ROUNDS} THEN l ELSE r END,
                    CASE turn WHEN {FEISTEL_ROUNDS} THEN r ELSE xor(l, ('0x' || substr(
                        md5(concat_ws(':', {DEFAULT_SEED}, turn, r)), 1, 13))::BIGINT & ((1::BIGINT << half) - 1)) END
                FROM walk, sizes WHERE NOT (turn = {FEISTEL_ROUNDS} AND (l << half) + r < n)
            ), drawn AS (
                SELECT draw + 1 AS draw, (l << half) + r AS row_no FROM walk, sizes
                WHERE turn = {FEISTEL_ROUNDS} AND (l << half) + r < n
            )
            SELECT draw, row_no, doc_id, lang FROM drawn JOIN (
                SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS row_no FROM documents) USING (row_no)""",
        "token_counts": query(*conversation, select=flat_counts(CONVERSATION_KEYS)),
        "document_token_counts": query(*counts_ctes("documents", ["doc_id"]), select=flat_counts(["doc_id"])),
        "unified_token_counts": query(
            *SHAPES,
            UNIFIED,
            UNIFIED_ROWS,
            *counts_ctes(unified_ids, ["source_order", "row_no"]),
            select=flat_counts(["source_order", "row_no"]),
        ),
        "truncated_counts": query(
            *counts_ctes("documents", ["doc_id"], TRUNCATED_LENGTH),
            select=flat_counts(["doc_id"]),
        ),
        "text_columns_counts": query(
            ALPACA,
            *counts_ctes(
                "(SELECT row_order, sub_order, instruction || chr(10) || output AS text FROM alpaca)",
                ["row_order", "sub_order"],
            ),
            select=flat_counts(["row_order", "sub_order"]),
        ),
        "tokenizer_counts": query(*conversation, select=flat_counts(CONVERSATION_KEYS)),
        "tokenizer_word_counts": query(*conversation, select=flat_counts(CONVERSATION_KEYS)),
        "tokenizer_evicted": query(
            *conversation, *evicted_ctes(DEFAULT_EVICTION_RATIO), select="SELECT token_id, token FROM evicted"
        ),
        "tokenizer_vocabulary": query(*VOCAB, select="SELECT * FROM vocab"),
        "top_tokens_report": query(*conversation, TOP, select=ranked_token.format(rows="top")),
        "rare_tokens_report": query(*conversation, RARE, select=ranked_token.format(rows="rare")),
        "usage_totals": query(
            *conversation,
            select="SELECT count(*) AS unique_token_count, CAST(sum(cnt) AS BIGINT) AS total_token_count FROM counts",
        ),
        "usage_report_sections": query(*conversation, RARE, UNUSED, FIRST_UNUSED, select=report),
        "usage_report_lines": query(
            *conversation,
            RARE,
            select="SELECT rank, format('{:02d}. TOKEN_ID={} | STR=''{}'' | OCC={}', rank, t.token_id, token, cnt) "
            "AS line FROM rare t LEFT JOIN vocab ON t.token_id = vocab.token_id",
        ),
        "usage_summary_document": query(
            *conversation,
            TOP,
            select="SELECT 'conversations' AS dataset, "
            "'text,messages,conversations,instruction,output' AS text_columns, "
            "'train' AS split, 'words' AS model, CAST(-1 AS BIGINT) AS sample_limit, "
            f"CAST({SUMMARY_TOP_K} AS BIGINT) AS top_k, (SELECT count(*) FROM counts) AS unique_token_count, "
            "(SELECT CAST(sum(cnt) AS BIGINT) FROM counts) AS total_token_count, rank - 1 AS pos, "
            "t.token_id, token, cnt FROM top t LEFT JOIN vocab ON t.token_id = vocab.token_id",
        ),
        "vocabulary_rules": query(
            *VOCAB, select=f"SELECT token_id, {', '.join(f'{sql} AS {name}' for name, sql in RULES.items())} FROM vocab"
        ),
        "prunable_tokens": query(*VOCAB, PRUNABLE, select="SELECT * FROM prunable"),
        "unused_vocabulary": query(*conversation, UNUSED, select="SELECT * FROM unused"),
        "unused_prunable": query(
            *conversation, PRUNABLE, select="SELECT * FROM prunable ANTI JOIN counts USING (token_id)"
        ),
        "first_unused_prunable": query(
            *conversation,
            PRUNABLE,
            "unused AS (SELECT * FROM prunable ANTI JOIN counts USING (token_id))",
            FIRST_UNUSED,
            select="SELECT * FROM first_unused",
        ),
        "used_prunable": query(
            *conversation, PRUNABLE, select="SELECT token_id, cnt FROM counts SEMI JOIN prunable USING (token_id)"
        ),
        "evicted": query(
            *conversation, *evicted_ctes(DEFAULT_EVICTION_RATIO), select="SELECT token_id, token FROM evicted"
        ),
        "evicted_truncated": query(
            *counts_ctes("documents", ["doc_id"], TRUNCATED_LENGTH),
            *evicted_ctes(DOCUMENT_RATIO),
            select="SELECT token_id, token FROM evicted",
        ),
        "eviction_numbers": query(
            *conversation,
            *evicted_ctes(DEFAULT_EVICTION_RATIO),
            UNUSED,
            select="""
                SELECT 'vocab_tokens' AS metric, count(*) AS value FROM vocab
                UNION ALL SELECT 'prunable_tokens', count(*) FROM prunable
                UNION ALL SELECT 'unused_tokens', count(*) FROM unused
                UNION ALL SELECT 'unused_prunable_tokens', count(*) FROM prunable ANTI JOIN counts USING (token_id)
                UNION ALL SELECT 'quota', CAST(greatest(1, floor(count(*) * CAST({ratio} AS DOUBLE))) AS BIGINT)
                          FROM prunable
                UNION ALL SELECT 'selected_unused', count(*) FROM evicted WHERE cnt = 0
                UNION ALL SELECT 'selected_rare', count(*) FROM evicted WHERE cnt > 0
                UNION ALL SELECT 'selected_total', count(*) FROM evicted
                UNION ALL SELECT 'corpus_rows', count(*) FROM conversations
                UNION ALL SELECT 'used_tokens', count(*) FROM counts""".format(ratio=DEFAULT_EVICTION_RATIO),
        ),
        "labelled_vocabulary": query(
            *conversation,
            *evicted_ctes(DEFAULT_EVICTION_RATIO),
            select="SELECT vocab.*, CASE WHEN evicted.token_id IS NULL THEN 'kept' ELSE 'evicted' END AS status "
            "FROM vocab LEFT JOIN evicted ON vocab.token_id = evicted.token_id",
        ),
        "first_rows": f"SELECT * FROM conversations ORDER BY conv_id, turn LIMIT {HEAD_ROWS}",
        "sampled_rows": "SELECT doc_id, lang, n_chars FROM documents "
        f"ORDER BY md5(concat(doc_id, ':', {DEFAULT_SEED})), doc_id LIMIT {DEFAULT_SAMPLE_ROWS}",
        "distinct_documents": "SELECT doc_id, lang, source, md5(text) AS text_md5 FROM ("
        "SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS place FROM documents) WHERE place = 1",
        "cleaned_lines": f"""
            SELECT doc_id, line_no, line FROM (
                SELECT doc_id, line_no, {strip('raw')} AS line FROM (
                    SELECT doc_id, unnest(lines) AS raw, CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS line_no
                    FROM (SELECT doc_id, regexp_split_to_array(text, '{LINE_BREAK}') AS lines FROM documents)))
            WHERE line <> '' AND NOT starts_with(line, '#')""",
        "table_profiles": profile_sql(),
        "profiles_written": profile_sql(),
        "results_written": query(
            *conversation, *evicted_ctes(DEFAULT_EVICTION_RATIO), select="SELECT token_id, token FROM evicted"
        ),
        "vocabulary_read": query(*VOCAB, select="SELECT * FROM vocab"),
        "split_rows": "SELECT doc_id, lang AS split, md5(text) AS text_md5, 'all' AS read FROM documents "
        "UNION ALL SELECT doc_id, lang, md5(text), 'one' FROM documents WHERE lang = 'de'",
        "unified_from_files": query(*SHAPES, UNIFIED, select="SELECT * FROM unified"),
        "transcript_counts": query(
            *counts_ctes(
                "(SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text "
                "FROM conversations GROUP BY conv_id)",
                ["conv_id"],
            ),
            select=flat_counts(["conv_id"]),
        ),
        "incoming_tokens": query(*unlisted, select="SELECT * FROM incoming"),
        "paired_tokens": query(*pairs, select="SELECT * FROM pairs"),
        "adaptation_changes": query(
            *effects,
            select=f"""
                SELECT CAST(token_id AS INTEGER) AS token_id, CAST(sum(lost) AS BIGINT) AS lost, CAST(sum(gained) AS BIGINT) AS gained
                FROM (SELECT coalesce(id_before, {UNK_ID}) AS token_id, n AS lost, 0 AS gained FROM moved
                      UNION ALL SELECT coalesce(id_after, {UNK_ID}), 0, n FROM moved) GROUP BY ALL""",
        ),
        "adapted_counts": query(
            *effects,
            select=f"""
                SELECT CAST(coalesce(id_after, {UNK_ID}) AS INTEGER) AS token_id, CAST(sum(n) AS BIGINT) AS cnt
                FROM page_counts GROUP BY ALL""",
        ),
        "adapted_rows": query(
            *effects,
            select="""
                SELECT page_id, CAST(sum(n) AS BIGINT) AS n_changed,
                       CAST(coalesce(sum(n) FILTER (id_before IS NOT NULL), 0) AS BIGINT) AS n_known_before,
                       CAST(coalesce(sum(n) FILTER (id_after IS NOT NULL), 0) AS BIGINT) AS n_known_after
                FROM moved GROUP BY page_id""",
        ),
        "adapted_vocabulary": query(
            *pairs,
            select="SELECT vocab.token_id, coalesce(pairs.token, vocab.token) AS token, is_special, "
            "CASE WHEN pairs.token IS NULL THEN 'kept' ELSE 'injected' END AS status "
            "FROM vocab LEFT JOIN pairs ON vocab.token_id = pairs.token_id",
        ),
    }
