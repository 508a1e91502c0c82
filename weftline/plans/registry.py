"""Registered queries: name -> (run(spark, sf_dir), DuckDB SQL over the same tables, or None where SQL cannot say it).

Inputs that the tables lack (control characters, tags, result lines) are derived from their rows by
expressions that both engines read alike.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import language, markup, text as tx
from weftline.operators import jsonl, jsontree, request, resume, run, segment, stats
from weftline.sources import staging
from weftline.streaming import fold

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- what both engines read alike -------------------------------------------------------------

NORM = r"regexp_replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), '[\x{{2028}}\x{{2029}}\x{{200B}}\x{{200E}}\x{{200F}}\x{{FEFF}}\x{{202A}}-\x{{202E}}\x{{2060}}-\x{{206F}}\x{{0}}-\x{{8}}\x{{B}}-\x{{1F}}\x{{7F}}]', '', 'g')"
STRIP = r"regexp_replace(regexp_replace(" + NORM + r", '(?m)^[ \t]*\n', '', 'g'), '\n[ \t]*\z', '')"
NOT_BLANK = r"regexp_replace({0}, '[\s\x{{A0}}\x{{FEFF}}\p{{Z}}\v]', '', 'g') <> ''"
#: Texts with what normalising is for: all kinds of newlines, zero-width characters, controls, blank lines.
JUNK = "concat(replace(replace(text, ' and ', '​ and\r\n'), '. ', '.\n \t\n'), '\n \t\n\n', '\x07end ﻿\r')"
#: Result lines of every shape, from a document's number.
LINE = """CASE doc_id % 12
 WHEN 0 THEN concat('{"custom_id":"request-', doc_id, '","response":{"status_code":200,"request_id":"b","body":{"model":"m', doc_id % 3, '","provider":"p', doc_id % 2, '","choices":[{"finish_reason":"stop","native_finish_reason":"stop","message":{"content":"text ', doc_id, '","reasoning":"why ', doc_id, '"}}],"usage":{"prompt_tokens":', doc_id % 97, ',"completion_tokens":', doc_id % 31, ',"total_tokens":', doc_id % 97 + doc_id % 31, ',"cost":0.00', doc_id % 9 + 1, ',"prompt_tokens_details":{"cached_tokens":', doc_id % 5, '}}}},"error":null}')
 WHEN 1 THEN concat('{"custom_id":"request-', doc_id, '","response":{"status_code":200,"body":{"model":"m', doc_id % 3, '","choices":[{"text":"plain ', doc_id, '"}]}},"error":null}')
 WHEN 2 THEN concat('{"custom_id":"request-', doc_id, '","response":{"status_code":200,"body":{"status":"completed","output":[{"type":"reasoning","content":[{"type":"t","text":"so "},{"type":"t","text":"then"}]},{"type":"message","content":[{"type":"output_text","text":"out ', doc_id, '"},{"type":"refusal","text":"no"}]}]}},"error":null}')
 WHEN 3 THEN concat('{"custom_id":"request-', doc_id, '","response":null,"error":{"code":"E', doc_id % 4, '","message":"bad"}}')
 WHEN 4 THEN concat('{"custom_id":"request-', doc_id, '","response":{"status_code":500,"body":{"error":{"message":"boom"}}},"error":null}')
 WHEN 5 THEN concat('{"custom_id":"request-', doc_id, '","response":{"status_code":200,"body":{"choices":[{"finish_reason":"length","message":{"content":"cut ', doc_id, '"}}]}},"error":null}')
 WHEN 6 THEN concat('{"custom_id":"request-', doc_id, '","response":{"status_code":200,"body":{"status":"incomplete","incomplete_details":{"reason":"max_output_tokens"},"output":[]}},"error":null}')
 WHEN 7 THEN concat('{"custom_id":"request-', doc_id, '", oops')
 WHEN 8 THEN concat('{"custom_id":"","response":{"body":{"choices":[{"message":{"content":"late ', doc_id, '","reasoning_content":"hm"}}]}},"error":null}')
 WHEN 9 THEN concat('{"custom_id":"request-', doc_id, '","response":{"status_code":200,"body":{"choices":[{"message":{"content":"r ', doc_id, '","reasoning_details":[{"type":"reasoning.text","text":"a"},{"type":"x","text":"b"},{"type":"reasoning.text","text":"c"}]}}]}},"error":null}')
 WHEN 10 THEN concat('{"custom_id":"request-', doc_id, '","response":{"status_code":200,"body":{"error":{"message":"inner"}}},"error":null}')
 ELSE concat('{"custom_id":"request-', doc_id, '","response":{"status_code":200,"body":{"note":1}},"error":""}') END"""


def junk(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.expr(JUNK).alias("text"))


def results(spark, sf_dir):
    return jsonl.read_lines(load(spark, sf_dir, "documents").select("doc_id", F.expr(LINE).alias("line")))


# --- segmentation and requests ----------------------------------------------------------------

_CHUNKS = f"""n AS (SELECT doc_id, string_split({NORM.format('text')}, chr(10)) AS l FROM documents),
c AS (SELECT doc_id, i AS pos, array_to_string(l[i * 5 + 1 : i * 5 + 5], chr(10)) AS chunk FROM n, unnest(range(0, ceil(len(l) / 5.0)::BIGINT)) AS t(i))"""
_NUMBERED = f"f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS chunk_no FROM c WHERE {NOT_BLANK.format('chunk')})"
_LINE_SQL = r"""SELECT doc_id, chunk_no, to_json({custom_id: 'request-' || chunk_no, method: 'POST', url: '/v1/chat/completions', body: {messages: [{role: 'user', content: regexp_replace(chunk, '\A[\r\n]+|[\r\n]+\z', '', 'g')}]}})::VARCHAR AS line FROM f"""


def fixed(spark, sf_dir, lines=5):
    docs = load(spark, sf_dir, "documents").select("doc_id", tx.normalize(F.col("text")).alias("text"))
    return docs, segment.fixed_chunks(F.col("text"), lines)


@query(f"WITH {_CHUNKS}, {_NUMBERED} {_LINE_SQL}")
def compile_fixed(spark, sf_dir):
    """Documents, five lines a chunk, to chat request lines."""
    docs, chunks = fixed(spark, sf_dir)
    return request.compile_requests(segment.numbered_chunks(docs, chunks))


_PATTERN = r"^[A-D]\w+"
_BY_PATTERN = rf"""n AS (SELECT doc_id, list_filter(string_split(regexp_replace({NORM.format('text')}, '(?m)({_PATTERN})', chr(1) || '\1', 'g'), chr(1)), lambda x: x <> '') AS l FROM documents),
c AS (SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS chunk FROM n)"""


@query(f"WITH {_BY_PATTERN}, {_NUMBERED} {_LINE_SQL}")
def compile_regex(spark, sf_dir):
    """The same, cut where lines begin with a word in A to D."""
    docs, _ = fixed(spark, sf_dir)
    return request.compile_requests(segment.numbered_chunks(docs, segment.pattern_chunks(F.col("text"), _PATTERN)))


@query(f"WITH {_CHUNKS} SELECT doc_id, 'chunk-' || (pos + 1) AS chunk_name, chunk FROM c WHERE {NOT_BLANK.format('chunk')}")
def chunk_named(spark, sf_dir):
    return segment.named_chunks(*fixed(spark, sf_dir))


@query(f"WITH {_CHUNKS} SELECT doc_id, chunk FROM c WHERE pos = 0")
def first_chunk(spark, sf_dir):
    docs, chunks = fixed(spark, sf_dir)
    return docs.select("doc_id", segment.first_chunk(chunks).alias("chunk"))


@query(f"WITH {_CHUNKS}, m AS (SELECT coalesce(max(doc_id), 0) AS last FROM labels) SELECT doc_id, pos::INT AS pos, 'request-' || (last + row_number() OVER (ORDER BY doc_id, pos)) AS custom_id FROM c, m WHERE {NOT_BLANK.format('chunk')}")
def id_continuation(spark, sf_dir):
    """Ids that go on after those a target already holds."""
    docs, chunks = fixed(spark, sf_dir)
    have = load(spark, sf_dir, "labels").select(F.concat(F.lit("request-"), "doc_id").alias("custom_id"))
    rows = segment.explode_chunks(docs, chunks).where(~tx.is_blank(F.col("chunk"))).drop("chunk")
    rows = staging.staged(rows, "chunks")  # else the sample of ranges cuts all texts once more
    return request.global_ids(rows, ["doc_id", "pos"], request.next_id(have)).select("doc_id", "pos", "custom_id")


_TALK = "WITH t AS (SELECT conv_id, list({role: role, content: text} ORDER BY turn) AS m FROM conversations GROUP BY conv_id) "


def talks(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", F.col("text").alias("content")).alias("m"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("m"))


@query(_TALK + "SELECT conv_id, to_json({messages: m, temperature: 0.5, max_tokens: 100, stream: true})::VARCHAR AS body FROM t")
def payload_chat(spark, sf_dir):
    return talks(spark, sf_dir).select("conv_id", F.to_json(request.chat_body(F.col("m"), {"temperature": 0.5, "max_tokens": 100}, True)).alias("body"))


@query(_TALK + "SELECT conv_id, to_json({prompt: array_to_string([coalesce(x.content, '') for x in m], ''), stream: false})::VARCHAR AS body FROM t")
def payload_completions(spark, sf_dir):
    return talks(spark, sf_dir).select("conv_id", F.to_json(request.completions_body(F.col("m"), {}, False)).alias("body"))


@query(_TALK + """, p AS (SELECT conv_id, [x.content for x in m if x.role = 'system'] AS s, [{type: 'message', role: x.role, content: list_filter([{type: CASE WHEN x.role = 'assistant' THEN 'output_text' ELSE 'input_text' END, text: x.content}], lambda y: y.text <> '')} for x in m if x.role <> 'system'] AS i FROM t)
SELECT conv_id, CASE WHEN len(s) > 0 THEN to_json({input: i, instructions: array_to_string(s, chr(10)), store: false})::VARCHAR ELSE to_json({input: i, store: false})::VARCHAR END AS body FROM p""")
def payload_responses(spark, sf_dir):
    return talks(spark, sf_dir).select("conv_id", F.to_json(request.responses_body(F.col("m"))).alias("body"))


@query(_TALK + """SELECT conv_id, '{"messages":[' || array_to_string([to_json(x)::VARCHAR for x in m], ',') || ',{"role":"assistant","content":"Sure","prefix":true}],"stream":false}' AS body FROM t""")
def payload_deepseek(spark, sf_dir):
    return talks(spark, sf_dir).select("conv_id", F.to_json(request.chat_body(F.col("m"), {}, False, prefill="Sure", prefix=True)).alias("body"))


_ENDPOINT = "CASE event_id % 6 WHEN 0 THEN 'chat' WHEN 1 THEN 'completions' WHEN 2 THEN 'responses' WHEN 3 THEN 'openrouter-chat' WHEN 4 THEN 'openrouter-responses' ELSE 'deepseek' END"


@query(f"SELECT event_id, CASE WHEN e LIKE '%responses' THEN '/v1/responses' WHEN e = 'completions' THEN '/v1/completions' ELSE '/v1/chat/completions' END AS url FROM (SELECT event_id, {_ENDPOINT} AS e FROM events)")
def url_for_endpoint(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", tx.endpoint_path(F.expr(_ENDPOINT)).alias("url"))


_ATTEMPT = """event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
 CASE WHEN event_id % 5 = 0 THEN 502 WHEN event_id % 211 = 1 THEN 429 WHEN event_id % 7 = 2 THEN 403 ELSE 200 END AS status,
 CASE WHEN event_id % 53 = 0 THEN 'CONTENT_FILTER_TRIGGERED' WHEN event_id % 5 = 0 THEN 'API_ERROR_502' ELSE '' END AS code,
 CASE WHEN event_id % 14 = 2 THEN 'blocked for Safety' ELSE 'no' END AS message, CAST(event_id % 2 + 1 AS INT) AS attempt"""
_BLOCKED = "(code = 'CONTENT_FILTER_TRIGGERED' OR (status = 403 AND regexp_matches(lower(message), 'content filter|moderation|safety|policy|flagged')))"


def attempts(spark, sf_dir):
    load(spark, sf_dir, "events").createOrReplaceTempView("_weftline_events")
    return spark.sql(f"SELECT {_ATTEMPT} FROM _weftline_events")


@query(f"WITH a AS (SELECT {_ATTEMPT} FROM events) SELECT event_id, {_BLOCKED} AS blocked, TRY_CAST(regexp_extract(code, '^API_ERROR_([0-9]+)$', 1) AS INT) AS api_status FROM a")
def moderation_block(spark, sf_dir):
    return attempts(spark, sf_dir).select("event_id", tx.is_moderation_block(F.col("status"), F.col("code"), F.col("message")).alias("blocked"), tx.api_error_status(F.col("code")).alias("api_status"))


# --- text ---------------------------------------------------------------------------------------

_J = f"(SELECT doc_id, {JUNK} AS text FROM documents)"


@query(f"SELECT doc_id, {NORM.format('text')} AS text FROM {_J}")
def normalize(spark, sf_dir):
    return junk(spark, sf_dir).select("doc_id", tx.normalize(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {STRIP.format('text')} AS text FROM {_J}")
def strip_empty(spark, sf_dir):
    return junk(spark, sf_dir).select("doc_id", tx.strip_empty(F.col("text")).alias("text"))


@query(rf"SELECT doc_id, regexp_replace({STRIP.format('text')}, '\n+', chr(10) || chr(10), 'g') AS text FROM {_J}")
def double_newline(spark, sf_dir):
    return junk(spark, sf_dir).select("doc_id", tx.double_newlines(F.col("text")).alias("text"))


_TAGGED = "concat('<think>', text, '</think>', text, '<think> \n </think><think></think><think> kept ', doc_id, ' </think>')"


@query(f"SELECT doc_id, regexp_replace(t, '(?s)<think>.*?</think>', '', 'g') AS text FROM (SELECT doc_id, {_TAGGED} AS t FROM documents)")
def tag_delete(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", tx.delete_tagged(F.expr(_TAGGED), "<think>", "</think>").alias("text"))


@query(rf"SELECT doc_id, array_to_string([regexp_replace(x, '\A\s+|\s+\z', '', 'g') for x in regexp_extract_all(t, '(?s)<think>(.*?)</think>', 1) if x <> ''], chr(10) || chr(10)) AS text FROM (SELECT doc_id, {_TAGGED} AS t FROM documents)")
def tag_extract(spark, sf_dir):
    """Whole texts stand between the tags."""
    return load(spark, sf_dir, "documents").select("doc_id", tx.extract_tagged(F.expr(_TAGGED), "<think>", "</think>").alias("text"))


_TEMPLATE = "From {{ .Source }} in {{.Lang}}: {{ .Text }} ({{ .Unknown }})"


@query("SELECT doc_id, 'From ' || source || ' in ' || lang || ': ' || text || ' {{ .Lang }} ({{ .Unknown }})' AS text FROM documents")
def template_fill(spark, sf_dir):
    """Whole texts are put in; values are not expanded again, and unknown keys stay."""
    values = {"Source": F.col("source"), "Lang": F.col("lang"), "Text": F.concat("text", F.lit(" {{ .Lang }}"))}
    return load(spark, sf_dir, "documents").select("doc_id", tx.fill_template(F.lit(_TEMPLATE), values).alias("text"))


_LINES_SQL = f"SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split({NORM.format('text')}, chr(10))) AS l FROM {_J}) WHERE {NOT_BLANK.format('l')}"


@query(f"SELECT d.doc_id, coalesce(floor(avg(length_grapheme(l)) + 0.5), 0)::BIGINT AS mean_graphemes, coalesce(floor(avg(strlen(l)) + 0.5), 0)::BIGINT AS mean_bytes FROM documents d LEFT JOIN ({_LINES_SQL}) x USING (doc_id) GROUP BY d.doc_id")
def avg_line_length(spark, sf_dir):
    means = junk(spark, sf_dir).select("doc_id", stats.line_averages(F.col("text")).alias("m"))
    return means.select("doc_id", F.col("m.graphemes").alias("mean_graphemes"), F.col("m.bytes").alias("mean_bytes"))


_TOKENS = "(SELECT doc_id, ceil(2.0 * len(regexp_extract_all(text, '[#*0-9]')) + len(regexp_replace(text, '[#*0-9]', '', 'g')) / 4.0)::BIGINT AS tokens FROM documents)"


def tokens(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", tx.approximate_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT * FROM {_TOKENS}")
def approx_tokens(spark, sf_dir):
    return tokens(spark, sf_dir)


@query(f"SELECT count(*) AS n, sum(tokens)::BIGINT AS total, avg(tokens) AS mean, median(tokens) AS median FROM {_TOKENS}")
def token_stats(spark, sf_dir):
    return stats.token_stats(tokens(spark, sf_dir))


@query(f"WITH t AS {_TOKENS}, m AS (SELECT median(tokens) AS m FROM t) SELECT doc_id, tokens, CASE WHEN tokens >= 3 * m THEN 'triple' ELSE 'double' END AS outlier FROM t, m WHERE tokens >= 2 * m")
def token_outliers(spark, sf_dir):
    return stats.token_outliers(tokens(spark, sf_dir))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '(.)\.[^.]*$', '\1') AS b FROM pages), q AS (SELECT page_id, regexp_replace(b, '[^\p{L}\p{N}_-]', '', 'g') AS f FROM p) SELECT page_id, 'tc_' || substr(f, 1, 28) || '_20260102' AS session_id FROM q""")
def session_id(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", tx.session_id(F.col("url"), F.lit("2026-01-02").cast("date")).alias("session_id"))


@query("""SELECT p_partkey, lower(p_name) || ' ' || lpad((p_partkey % 120)::VARCHAR, 20, '0') || '.txt' AS sort_key FROM part""")
def natural_sort(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", tx.natural_key(F.concat("p_name", F.lit(" 00"), (F.col("p_partkey") % 120).cast("string"), F.lit(".txt"))).alias("sort_key"))


LANGUAGES = [(0, "English", ["anglais", "ingles"]), (1, "Français", ["french", "francés"]), (2, "Deutsch", ["german", "allemand"]), (3, "Español", ["spanish"]), (4, "Português", ["portuguese"])]
_INPUT = "CASE doc_id % 9 WHEN 0 THEN 'English' WHEN 1 THEN 'FRENCH' WHEN 2 THEN 'francais' WHEN 3 THEN 'Deutch' WHEN 4 THEN 'spanihs' WHEN 5 THEN 'portugues' WHEN 6 THEN 'klingon' WHEN 7 THEN 'german' ELSE 'Englsh' END"


@query(f"""WITH n(ord, name, aliases) AS (VALUES {', '.join(f"({o}, '{n}', {a!r})" for o, n, a in LANGUAGES)}), d AS (SELECT ord, name, unnest(list_prepend(name, aliases)) AS alias FROM n),
i AS (SELECT DISTINCT {_INPUT} AS input FROM documents),
r AS (SELECT input, ord, name, CASE WHEN input = name THEN 0 WHEN input = alias OR lower(input) = alias THEN 1 WHEN length(alias) > 3 AND levenshtein(strip_accents(lower(input)), strip_accents(lower(alias))) <= greatest(1, floor(0.3 * length(name))) THEN levenshtein(strip_accents(lower(input)), strip_accents(lower(alias))) + 2 END AS rank FROM i, d)
SELECT i.input, (SELECT name FROM r WHERE r.input = i.input AND rank IS NOT NULL ORDER BY rank, ord LIMIT 1) AS name FROM i""")
def language_resolve(spark, sf_dir):
    names = spark.createDataFrame(LANGUAGES, "ord int, name string, aliases array<string>")
    return language.resolve(load(spark, sf_dir, "documents").select(F.expr(_INPUT).alias("input")), names)


# --- results ------------------------------------------------------------------------------------

_R = f"r AS (SELECT doc_id, {LINE} AS line FROM documents), v AS (SELECT doc_id, line, CASE WHEN json_valid(line) THEN line::JSON END AS j FROM r)"
_B = "$.response.body"
_TRUE = lambda p: f"(json_extract(j, '{p}') IS NOT NULL AND json_extract(j, '{p}')::VARCHAR NOT IN ('null', 'false', '0', '\"\"'))"
_STR = lambda p: f"json_extract_string(j, '{p}')"


def _code_sql(missing: bool) -> str:
    status, finish, reason = _STR("$.response.status_code"), _STR(_B + ".choices[0].finish_reason"), _STR(_B + ".incomplete_details.reason")
    return f"""CASE WHEN j IS NULL THEN 'malformed' WHEN {_TRUE('$.error')} THEN 'error' WHEN NOT {_TRUE('$.response')} THEN 'unrecognized'
 WHEN {status + " IS NULL OR" if missing else ""} {status} <> '200' THEN 'status' WHEN {_TRUE(_B + '.error')} THEN 'error' WHEN {finish} = 'error' THEN 'stream_terminated' WHEN {finish} = 'length' THEN 'max_tokens' WHEN {finish} = 'content_filter' THEN 'content_filter'
 WHEN {_STR(_B + '.status')} = 'incomplete' AND {reason} IN ('max_output_tokens', 'max_tokens') THEN 'max_tokens' END"""


_OUT = lambda kind, part: f"(SELECT coalesce(string_agg(json_extract_string(p.value, '$.text'), '' ORDER BY i.rowid, p.rowid), '') FROM json_each(j, '{_B}.output') i, json_each(i.value, '$.content') p WHERE json_extract_string(i.value, '$.type') = '{kind}'{part})"


def _parse_sql(router: bool) -> str:
    c = _B + ".choices[0]"
    thought = f"nullif({_STR(c + '.message.reasoning_content')}, '')"
    if router:
        thought = f"coalesce({thought}, nullif({_STR(c + '.message.reasoning')}, ''), nullif((SELECT coalesce(string_agg(json_extract_string(d.value, '$.text'), '' ORDER BY d.rowid), '') FROM json_each(j, '{c}.message.reasoning_details') d WHERE json_extract_string(d.value, '$.type') = 'reasoning.text'), ''))"
    return f"""WITH {_R}, k AS (SELECT *, coalesce({_code_sql(False)}, CASE WHEN NOT {_TRUE(_B + '.output')} AND NOT {_TRUE(c + '.message')} AND json_extract(j, '{c}.text') IS NULL THEN 'unrecognized' END) AS error_code FROM v)
SELECT doc_id, coalesce(nullif({_STR('$.custom_id')}, ''), 'unknown') AS custom_id, error_code IS NOT NULL AS is_error, error_code,
 CASE WHEN error_code IS NULL THEN CASE WHEN {_TRUE(_B + '.output')} THEN {_OUT('message', " AND json_extract_string(p.value, '$.type') = 'output_text'")} WHEN {_TRUE(c + '.message')} THEN coalesce({_STR(c + '.message.content')}, '') ELSE {_STR(c + '.text')} END END AS text,
 CASE WHEN error_code IS NULL THEN CASE WHEN {_TRUE(_B + '.output')} THEN nullif({_OUT('reasoning', '')}, '') WHEN {_TRUE(c + '.message')} THEN {thought} END END AS reasoning FROM k"""


@query(_parse_sql(False))
def parse_results(spark, sf_dir):
    return jsonl.parse_results(results(spark, sf_dir)).select("doc_id", "custom_id", "is_error", "error_code", "text", "reasoning")


@query(_parse_sql(True))
def parse_results_router(spark, sf_dir):
    return jsonl.parse_results(results(spark, sf_dir), True).select("doc_id", "custom_id", "is_error", "error_code", "text", "reasoning")


@query(f"WITH {_R} SELECT doc_id, CASE WHEN json_exists(j, '{_B}.provider') OR json_exists(j, '{_B}.choices[0].native_finish_reason') OR {_TRUE(_B + '.choices[0].message.reasoning_details')} OR {_TRUE(_B + '.choices[0].message.reasoning')} THEN 'openrouter' ELSE 'openai' END AS format FROM v")
def detect_format(spark, sf_dir):
    return results(spark, sf_dir).select("doc_id", jsonl.detect_format(F.col("v")).alias("format"))


@query(f"""WITH {_R}, t AS (SELECT doc_id, line, CASE WHEN NOT {_TRUE('$.error')} AND NOT {_TRUE(_B + '.error')} THEN coalesce({_STR(_B + '.choices[0].message.content')}, {_STR(_B + '.choices[0].text')}, nullif({_OUT('message', " AND json_extract_string(p.value, '$.type') = 'output_text'")}, '')) END AS t FROM v)
SELECT doc_id // 6 AS file, coalesce(nullif(trim(string_agg(t, chr(10) || chr(10) ORDER BY doc_id)), ''), string_agg(line, chr(10) ORDER BY doc_id)) AS text FROM t GROUP BY 1""")
def extract_text(spark, sf_dir):
    """Six result lines are a file."""
    return jsonl.extract_text(results(spark, sf_dir).withColumn("file", F.expr("doc_id div 6")), "file", "doc_id")


@query(f"WITH {_R} SELECT count(*) AS total, count(*) FILTER (WHERE o IS NULL) AS succeeded, count(*) FILTER (WHERE o IS NOT NULL) AS failed, " + ", ".join(f"coalesce(sum(CASE WHEN o IS NULL THEN floor(coalesce(TRY_CAST({_STR(f'{_B}.usage.{p}')} AS DOUBLE), 0) * {k} + {0.5 if k > 1 else 0}) END), 0)::BIGINT AS {name}" for name, (p, k) in stats.USAGE.items()) + f" FROM (SELECT *, {_code_sql(True)} AS o FROM v)")
def batch_stats(spark, sf_dir):
    return stats.batch_stats(stats.batch_rows(results(spark, sf_dir)))


@query(f"WITH {_R} SELECT {_STR(_B + '.model')} AS model, count(*) AS n, min(doc_id) AS first_seen FROM (SELECT *, {_code_sql(True)} AS o FROM v) WHERE o IS NULL AND nullif({_STR(_B + '.model')}, '') IS NOT NULL GROUP BY 1")
def batch_by_model(spark, sf_dir):
    return stats.counts_by(stats.batch_rows(results(spark, sf_dir)), "model", "doc_id")


@query(f"WITH {_R} SELECT doc_id, coalesce(nullif({_STR('$.custom_id')}, ''), 'line-' || doc_id) AS custom_id, coalesce({_STR('$.error.code')}, {_STR('$.response.status_code')}, 'n/a') AS status, o AS outcome FROM (SELECT *, {_code_sql(True)} AS o FROM v) WHERE o IS NOT NULL")
def batch_failures(spark, sf_dir):
    return stats.failures(stats.batch_rows(results(spark, sf_dir)), "doc_id")


# --- resuming and comparing -------------------------------------------------------------------------

_REQ = "q AS (SELECT 'request-' || doc_id AS custom_id, doc_id FROM documents), s AS (SELECT 'request-' || doc_id AS custom_id, quality = 0 AS is_error, toxic FROM labels)"


def requests_and_results(spark, sf_dir):
    q = load(spark, sf_dir, "documents").select(F.concat(F.lit("request-"), "doc_id").alias("custom_id"), "doc_id")
    return q, load(spark, sf_dir, "labels").select(F.concat(F.lit("request-"), "doc_id").alias("custom_id"), (F.col("quality") == 0).alias("is_error"), "toxic")


@query(f"WITH {_REQ} SELECT * FROM q WHERE custom_id NOT IN (SELECT custom_id FROM s)")
def resume_pending(spark, sf_dir):
    return resume.pending(*requests_and_results(spark, sf_dir))


@query(f"WITH {_REQ} SELECT * FROM q WHERE custom_id IN (SELECT custom_id FROM s WHERE is_error) AND custom_id NOT IN (SELECT custom_id FROM s WHERE toxic = 1 OR hash_odd) ".replace(" OR hash_odd", ""))
def retry_pending(spark, sf_dir):
    q, s = requests_and_results(spark, sf_dir)
    return resume.pending_retry(q, s, s.where("toxic = 1"))


_RETRY = """o AS (SELECT 'request-' || (doc_id // 3) AS custom_id, doc_id AS line_no, 'old ' || text AS line FROM documents),
r AS (SELECT 'request-' || (doc_id // 2) AS custom_id, doc_id AS line_no, 'new ' || text AS line, doc_id % 3 = 0 AS is_error FROM documents)"""


@query(f"""WITH {_RETRY}, g AS (SELECT custom_id, arg_max(line, line_no) AS new, arg_max(is_error, line_no) AS bad, min(line_no) AS first FROM r GROUP BY 1), k AS (SELECT * FROM g WHERE NOT bad)
SELECT coalesce(new, line) AS line, 0 AS part, line_no AS ord FROM o LEFT JOIN k USING (custom_id) UNION ALL SELECT new, 1, first FROM k WHERE custom_id NOT IN (SELECT custom_id FROM o)""")
def merge_retries(spark, sf_dir):
    """Every document is an original and a retry; ids repeat on both sides, and a third of the retried ids are new."""
    d = load(spark, sf_dir, "documents")
    rows = lambda m, name, bad: d.select(F.concat(F.lit("request-"), F.expr(f"doc_id div {m}")).alias("custom_id"), F.col("doc_id").alias("line_no"), F.concat(F.lit(name), "text").alias("line"), (F.col("doc_id") % bad == 0).alias("is_error"))
    return resume.merge_retries(rows(3, "old ", 4), rows(2, "new ", 3))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents),
a AS (SELECT doc_id // 2 AS pair, pos, line FROM l WHERE doc_id % 2 = 0), b AS (SELECT doc_id // 2 AS pair, pos, line FROM l WHERE doc_id % 2 = 1)
SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.pos, b.pos)::INT AS pos, coalesce(a.line, '') AS left_line, coalesce(b.line, '') AS right_line FROM a FULL JOIN b ON a.pair = b.pair AND a.pos = b.pos""")
def compare_lines(spark, sf_dir):
    """Each even document against the odd one after it."""
    lines = load(spark, sf_dir, "documents").select(F.expr("doc_id div 2").alias("pair"), (F.col("doc_id") % 2).alias("side"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return resume.compare_lines(lines.where("side = 0").drop("side"), lines.where("side = 1").drop("side"), "pair")


# --- files and trees -----------------------------------------------------------------------------------

@query(r"""WITH RECURSIVE l AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\n]*\n|[^\n]+')) AS line, generate_subscripts(regexp_extract_all(text, '[^\n]*\n|[^\n]+'), 1) AS k FROM documents),
p AS (SELECT doc_id, k, strlen(line) AS n, 0 AS part, line FROM l WHERE k = 1 UNION ALL
 SELECT l.doc_id, l.k, CASE WHEN p.n > 0 AND p.n + strlen(l.line) > 700 THEN strlen(l.line) ELSE p.n + strlen(l.line) END, CASE WHEN p.n > 0 AND p.n + strlen(l.line) > 700 THEN p.part + 1 ELSE p.part END, l.line FROM p JOIN l ON l.doc_id = p.doc_id AND l.k = p.k + 1)
SELECT doc_id, part, string_agg(line, '' ORDER BY k) AS content FROM p GROUP BY 1, 2""")
def split_parts(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.posexplode(segment.size_parts(F.col("text"), 700)).alias("part", "content"))


@query("SELECT source AS folder, lpad(doc_id::VARCHAR, 20, '0') || '.txt' AS place, '--- File: ' || doc_id || '.txt ---' || chr(10) || text AS content FROM documents")
def merge_files(spark, sf_dir):
    """The documents of a source are the files of a folder."""
    d = load(spark, sf_dir, "documents").select("source", F.concat("doc_id", F.lit(".txt")).alias("name"), "text")
    return resume.merge_files(d, "source", "name", "text")


_TREE = """concat('{"a":{"b":[', doc_id % 7, ',{"c":"', source, '"}],"e":{}},"k', doc_id % 3, '":', CASE WHEN doc_id % 2 = 0 THEN 'null' ELSE 'true' END, '}')"""
_OTHER = """concat('{"a":{"b":[', doc_id % 5, ']},"k', doc_id % 2, '":{"z":1}}')"""


@query(f"SELECT doc_id, array_to_string(string_split(replace(replace(fullkey, '$.', ''), '[', '.'), '.'), '/') AS path, coalesce(atom::VARCHAR, 'null') AS value FROM (SELECT doc_id, replace(fullkey, ']', '') AS fullkey, atom FROM documents, json_tree({_TREE}) WHERE type NOT IN ('OBJECT', 'ARRAY'))")
def json_flatten(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.expr(_TREE).alias("j"))
    return jsontree.flatten(d, "doc_id", "j").select("doc_id", F.array_join("path", "/").alias("path"), "value")


@query(f"""WITH f AS (SELECT doc_id, replace(fullkey, ']', '') AS p FROM documents, json_tree({_TREE}) WHERE type NOT IN ('OBJECT', 'ARRAY')), g AS (SELECT doc_id, replace(fullkey, ']', '') AS p FROM documents, json_tree({_OTHER}) WHERE type NOT IN ('OBJECT', 'ARRAY'))
SELECT doc_id, array_to_string(string_split(replace(replace(p, '$.', ''), '[', '.'), '.'), '/') AS path FROM f WHERE (doc_id, p) NOT IN (SELECT doc_id, p FROM g)""")
def json_missing(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    a, b = (jsontree.flatten(d.select("doc_id", F.expr(x).alias("j")), "doc_id", "j") for x in (_TREE, _OTHER))
    return jsontree.missing_paths(a, b, "doc_id").select("doc_id", F.array_join("path", "/").alias("path"))


_LAST = "CASE WHEN doc_id % 2 = 0 THEN 'null' ELSE 'true' END"


@query(f"""SELECT doc_id, '{{"a":{{"b":{{"0":' || doc_id % 7 || ',"1":{{"c":"' || source || '"}}}},"e":{{}}}},"k' || doc_id % 2 || '":' || CASE WHEN doc_id % 6 < 2 THEN {_LAST} ELSE '{{"z":1}},"k' || doc_id % 3 || '":' || {_LAST} END || '}}' AS result FROM documents""")
def json_merge(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.expr(_OTHER).alias("l"), F.expr(_TREE).alias("r"))
    return jsontree.map_pairs(d, "l", "r", ["doc_id"], "merge")


@query(f"""SELECT doc_id, '{{"a":{{"b":{{"1":{{"c":"' || source || '"}}}},"e":{{}}}}' || CASE WHEN doc_id % 6 < 2 THEN '' ELSE ',"k' || doc_id % 3 || '":' || {_LAST} END || '}}' AS result FROM documents""")
def json_subtract(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.expr(_TREE).alias("l"), F.expr(_OTHER).alias("r"))
    return jsontree.map_pairs(d, "l", "r", ["doc_id"], "missing")


# --- runs and streams ------------------------------------------------------------------------------------

@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1000.0 AS arr, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT event_id, user_id, n, arr AS start_ms FROM e WHERE n = 1 UNION ALL SELECT e.event_id, e.user_id, e.n, greatest(e.arr, s.start_ms + 600000.0) FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT event_id, round(start_ms)::BIGINT AS start_ms FROM s""")
def rpm_schedule(spark, sf_dir):
    """One request in ten minutes for each user."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0).alias("at"), F.struct("ts", "event_id").alias("o"))
    return run.paced(e, "at", "o", 0.1, "user_id").select("event_id", F.round("start_ms").cast("long").alias("start_ms"))


_JIT = "CAST(event_id % 1000 AS DOUBLE)"


@query(f"SELECT event_id, CASE WHEN event_id % 4 = 0 THEN (event_id % 7) * 1000 + {_JIT} ELSE least(60000.0, pow(2.0, event_id % 6) * 5000 + {_JIT}) END AS wait_ms, [0.2, 0.5, 0.9][least(event_id % 6 + 1, 3)]::DOUBLE AS temperature FROM events")
def backoff(spark, sf_dir):
    n = (F.col("event_id") % 6 + 1).cast("int")
    after = F.when(F.col("event_id") % 4 == 0, (F.col("event_id") % 7).cast("double"))
    values = F.array(F.lit(0.2), F.lit(0.5), F.lit(0.9))
    return load(spark, sf_dir, "events").select("event_id", run.backoff(n, F.lit(5000.0), F.expr(_JIT), after).alias("wait_ms"), run.temperature(values, n, F.lit(0.7)).alias("temperature"))


@query(f"""WITH a AS (SELECT {_ATTEMPT} FROM events), b AS (SELECT *, status <> 200 OR code <> '' AS bad, {_BLOCKED} AS blocked FROM a),
c AS (SELECT *, sum(bad::INT) OVER w AS failures FROM b WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
d AS (SELECT *, bad AND (failures >= 5 OR (status IN (400, 401, 402, 403, 429, 503) AND NOT blocked)) AS abort FROM c),
e AS (SELECT *, sum(abort::INT) OVER (PARTITION BY user_id ORDER BY seq) - abort::INT AS before FROM d)
SELECT event_id, failures::BIGINT AS failures, CASE WHEN before > 0 THEN 'cancelled' WHEN abort THEN 'abort' WHEN NOT bad THEN 'ok' WHEN blocked OR attempt >= 2 THEN 'fail' ELSE 'retry' END AS decision FROM e""")
def attempt_ladder(spark, sf_dir):
    return run.ladder(attempts(spark, sf_dir), run.Limits(), "user_id", "seq").select("event_id", "failures", "decision")


@query("SELECT event_id, gap_s FROM (SELECT event_id, epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap_s FROM events) WHERE gap_s > 3600")
def idle_gap(spark, sf_dir):
    return fold.idle_gaps(load(spark, sf_dir, "events"), "user_id", ("ts", "event_id"), 3600).select("event_id", "gap_s")


_KIND = "CASE WHEN event_id % 5 = 0 THEN 'output' WHEN event_id % 7 = 0 THEN 'reasoning' WHEN event_id % 11 = 0 THEN 'conditional' ELSE 'delta' END"


@query(f"""WITH k AS (SELECT user_id, event_id, {_KIND} AS kind, event_type || ' ' AS t FROM events), s AS (SELECT *, coalesce(max((kind = 'delta')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM k),
f AS (SELECT *, kind = 'delta' OR (kind IN ('output', 'conditional') AND seen = 0) AS keep FROM s)
SELECT user_id, coalesce(string_agg(t, '' ORDER BY event_id) FILTER (WHERE keep), '') AS text, count(*) FILTER (WHERE keep) AS kept, count(*) AS events FROM f GROUP BY user_id""")
def stream_fold(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_id", F.expr(_KIND).alias("kind"), F.concat("event_type", F.lit(" ")).alias("t"))
    return fold.fold_items(e, "user_id", "event_id", "kind", "t")


@query("""SELECT user_id, string_agg(event_type || ' ', '' ORDER BY event_id) AS text, true AS ended FROM events GROUP BY user_id""")
def sse_fold(spark, sf_dir):
    """Events as a chat stream's text, parsed and folded."""
    data = F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), "event_type", F.lit(' "}}]}\n\n'))
    body = F.concat(F.lit(": hello\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", data.alias("d")))), lambda x: x["d"]), ""), F.lit("data: [DONE]\n\n"))
    return fold.fold_streams(load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("request_id")).agg(body.alias("body"))).select(F.col("request_id").alias("user_id"), "text", "ended")


_BREAKS = "[0, 500, 1200, 2500]"


@query(f"SELECT doc_id, least(len(list_filter({_BREAKS}, lambda x: x <= n_chars)), 3)::INT AS page, (n_chars // 150)::BIGINT AS location FROM documents")
def page_lookup(spark, sf_dir):
    d = load(spark, sf_dir, "documents").withColumn("breaks", F.array(*[F.lit(x) for x in json.loads(_BREAKS)]))
    return d.select("doc_id", resume.page_of("n_chars", "breaks").alias("page"), F.floor(F.col("n_chars") / 150).alias("location"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 3")
def keep_latest_caches(spark, sf_dir):
    return resume.keep_latest(load(spark, sf_dir, "events"), "user_id", ("ts", "event_id"), 3).select("user_id", "event_id")


# --- rules without SQL ---------------------------------------------------------------------------------------

@query()
def markdown_strip(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", markup.strip_markdown(F.col("text")).alias("text"))


@query("""WITH u AS (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE [ord(c)::UBIGINT for c in string_split(text, '')] END AS l FROM documents), f AS (SELECT doc_id, list_reduce(list_prepend(3735928559::UBIGINT, l), lambda a, b: (xor(a, b) * 2654435761::UBIGINT) & 4294967295::UBIGINT) AS a, list_reduce(list_prepend(1103547991::UBIGINT, l), lambda a, b: (xor(a, b) * 1597334677::UBIGINT) & 4294967295::UBIGINT) AS b FROM u),
g AS (SELECT *, xor((xor(a, a >> 16) * 2246822507::UBIGINT) & 4294967295::UBIGINT, (xor(b, b >> 13) * 3266489909::UBIGINT) & 4294967295::UBIGINT) AS x FROM f), h AS (SELECT *, xor((xor(b, b >> 16) * 2246822507::UBIGINT) & 4294967295::UBIGINT, (xor(x, x >> 13) * 3266489909::UBIGINT) & 4294967295::UBIGINT) AS y FROM g)
SELECT doc_id, printf('%x', (y & 2097151::UBIGINT) * 4294967296::UBIGINT + x) AS hash FROM h""")
def fast_hash(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", markup.hashed(F.col("text")).alias("hash"))


@query()
def display_wrap(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", markup.wrapped(F.col("text"), 60).alias("lines"), markup.string_width(F.col("source")).alias("source_width"))
