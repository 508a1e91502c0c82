"""Registered queries of files, accumulated streams, request texts, JSON tools and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import markup, text as tx
from weftline.operators import jsonl, jsontree, options, prompts, request, resume, run, segment, stats
from weftline.plans.registry import _B, _R, _STR, _TALK, _TREE, STRIP, _code_sql, junk, load, query, results, talks
from weftline.sources import files, staging
from weftline.streaming import accumulate, blocks

# --- files ----------------------------------------------------------------------------------------------


@query("SELECT (row_number() OVER (ORDER BY doc_id))::BIGINT AS n, concat('{\"custom_id\":\"request-', doc_id, '\",\"n\":', n_chars, '}') AS line FROM documents")
def jsonl_file_lines(spark, sf_dir):
    """Documents' numbers as one JSONL file, read back with line numbers over blocks."""
    path = staging.fresh_path(spark, "lines")
    rows = load(spark, sf_dir, "documents").orderBy("doc_id").coalesce(1).select(F.concat(F.lit('{"custom_id":"request-'), "doc_id", F.lit('","n":'), "n_chars", F.lit("}")).alias("line"))
    files.create_lines(rows, path)
    return files.jsonl_files(spark, path).where("v is not null").select(F.col("line_no").alias("n"), "line")


@query("SELECT item_id, regexp_replace(coalesce(text, ''), '\\n\\z', '') || chr(10) AS text FROM benchmark")
def text_file_scan(spark, sf_dir):
    """Every text as a file of its own, read whole."""
    path = staging.fresh_path(spark, "texts")
    files.write_parts(load(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("text")), path, "item_id", "text")
    return files.text_files(spark, path, recursive=True).select(F.regexp_extract("file", r"part=(-?\d+)", 1).cast("long").alias("item_id"), "text")


@query("SELECT doc_id, 'request-' || (row_number() OVER (ORDER BY h, doc_id)) AS custom_id FROM (SELECT doc_id, doc_id % 2 AS h FROM documents)")
def append_requests(spark, sf_dir):
    """Even documents make a target, odd ones are appended with ids that go on after it."""
    path = staging.fresh_path(spark, "appended")
    docs = load(spark, sf_dir, "documents").select("doc_id")
    line = lambda rows: rows.select(F.to_json(F.struct("custom_id", F.col("doc_id").alias("body"))).alias("line"))
    for side in (0, 1):
        files.append_requests(docs.where(F.col("doc_id") % 2 == side), path, line, ["doc_id"])
    return files.jsonl_files(spark, path).select(jsonl.text_at(F.col("v"), "$.body").cast("long").alias("doc_id"), jsonl.text_at(F.col("v"), "$.custom_id").alias("custom_id"))


_NAME = "CASE doc_id % 5 WHEN 0 THEN concat('src/', doc_id, '.ts') WHEN 1 THEN concat('src/a/', doc_id, '.ts') WHEN 2 THEN concat('node_modules/x/', doc_id, '.ts') WHEN 3 THEN concat('docs/', doc_id, '.md') ELSE concat(doc_id, '.txt') END"


@query(rf"SELECT doc_id FROM (SELECT doc_id, {_NAME} AS n FROM documents) WHERE regexp_full_match(n, '(.*/)?[^/]*\.ts|[^/]*\.txt') AND NOT regexp_matches(n, '^node_modules(/|$)|^src/a(/|$)')")
def glob_names(spark, sf_dir):
    """Names by pattern; an ignored folder hides all below it."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.expr(_NAME).alias("n"))
    return rows.where(files.matches(F.col("n"), ["**/*.ts", "*.txt"]) & ~files.ignored(F.col("n"), ["node_modules", "src/a"])).select("doc_id")


_MAYBE = "CASE doc_id % 6 WHEN 0 THEN concat(chr(10), ' {\"custom_id\":', doc_id, '}', chr(10), text) WHEN 1 THEN '{\"other\":1}' WHEN 2 THEN text WHEN 3 THEN '{\"body\":{}' WHEN 4 THEN '{\"error\":null}' ELSE '' END"


@query(f"SELECT doc_id, doc_id % 6 IN (0, 4) AS is_jsonl FROM (SELECT doc_id, {_MAYBE} AS t FROM documents)")
def is_jsonl_text(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", files.is_jsonl(F.expr(_MAYBE)).alias("is_jsonl"))


@query("SELECT DISTINCT 'data:image/png;base64,' || to_base64(encode(text)) AS url FROM documents WHERE doc_id % 2 = 0 AND text <> ''")
def image_data_urls(spark, sf_dir):
    """Texts as the contents of files named .png and .bin; equal contents are one image."""
    path = staging.fresh_path(spark, "images")
    docs = load(spark, sf_dir, "documents").where("text <> ''")
    named = docs.select(F.concat(F.lit("m"), F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, ".png").otherwise(".bin")).alias("name"), F.col("text").cast("binary").alias("content"))
    return files.data_urls(named.select(F.concat(F.lit(path + "/"), "name").alias("file"), "content")).select("url")


# --- requests and their texts ---------------------------------------------------------------------------

_BODY = """CASE conv_id % 5 WHEN 0 THEN to_json({messages: list({role: role, content: text} ORDER BY turn)}) WHEN 1 THEN to_json({messages: list({role: role, content: [{type: 'text', text: text}, {type: 'image_url', text: 'no'}]} ORDER BY turn)})
 WHEN 2 THEN to_json({prompt: string_agg(text, ' ' ORDER BY turn)}) WHEN 3 THEN to_json({input: string_agg(text, ' ' ORDER BY turn)}) ELSE to_json({input: list({role: role, content: [{type: 'input_text', text: text}]} ORDER BY turn)}) END"""


def request_lines(spark, sf_dir):
    """One request for each conversation, of five shapes."""
    t = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    joined = F.array_join(F.transform("t", lambda m: m["text"]), " ")
    part = lambda kind, x: F.struct(F.lit(kind).alias("type"), x.alias("text"))
    shapes = [
        F.struct(F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages")), F.struct(F.transform("t", lambda m: F.struct(m["role"].alias("role"), F.array(part("text", m["text"]), part("image_url", F.lit("no"))).alias("content"))).alias("messages")),
        F.struct(joined.alias("prompt")), F.struct(joined.alias("input")), F.struct(F.transform("t", lambda m: F.struct(m["role"].alias("role"), F.array(part("input_text", m["text"])).alias("content"))).alias("input")),
    ]
    body = F.to_json(shapes[4])
    for k in range(4):
        body = F.when(F.col("conv_id") % 5 == k, F.to_json(shapes[k])).otherwise(body)
    return t.select("conv_id", F.concat(F.lit('{"custom_id":"request-'), "conv_id", F.lit('","body":'), body, F.lit("}")).alias("line"))


@query("SELECT conv_id, CASE WHEN conv_id % 5 IN (2, 3) THEN string_agg(text, ' ' ORDER BY turn) ELSE string_agg(text, chr(10) ORDER BY turn) END AS text FROM conversations GROUP BY conv_id")
def prompt_text(spark, sf_dir):
    """What counting tokens reads of requests of every shape."""
    return jsonl.read_lines(request_lines(spark, sf_dir)).select("conv_id", prompts.prompt_text(F.col("v")).alias("text"))


@query()
def token_count_bpe(spark, sf_dir):
    """Tokens of a public byte-level BPE file, by the library on Arrow batches."""
    import public_tokenizers

    return load(spark, sf_dir, "documents").select("doc_id", markup.count_tokens(F.col("text"), public_tokenizers.path("byte_bpe_50k.json")).alias("tokens"))


_OPTION = "CASE event_id % 8 WHEN 0 THEN 'chunkSize' WHEN 1 THEN 'batchSize' WHEN 2 THEN 'rpm' WHEN 3 THEN 'maxFail' WHEN 4 THEN 'temperature' WHEN 5 THEN 'top_p' WHEN 6 THEN 'parallel' ELSE 'idleTimeout' END"


@query(f"""SELECT event_id, CASE k WHEN 'chunkSize' THEN v = floor(v) AND v BETWEEN 1 AND 500000 WHEN 'batchSize' THEN v = floor(v) AND v BETWEEN 1 AND 1000 WHEN 'rpm' THEN v > 0 WHEN 'maxFail' THEN v = floor(v) AND v >= 0 WHEN 'temperature' THEN v BETWEEN 0 AND 2
 WHEN 'top_p' THEN v BETWEEN 0 AND 1 WHEN 'parallel' THEN v = floor(v) AND v BETWEEN 1 AND 128 ELSE v >= 0.001 END AS ok FROM (SELECT event_id, {_OPTION} AS k, (event_id % 23 - 3) / 2.0 AS v FROM events)""")
def option_ranges(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", F.expr(_OPTION).alias("k"), ((F.col("event_id") % 23 - 3) / 2.0).alias("v"))
    return e.select("event_id", options.in_range(F.col("k"), F.col("v")).alias("ok"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '[\x{2028}\x{2029}\x{200B}\x{200E}\x{200F}\x{FEFF}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{0}-\x{8}\x{B}-\x{1F}\x{7F}]', '', 'g'), '(?s)<think>.*?</think>', '', 'g'), '(?m)^[ \t]*\n', '', 'g'), '\n[ \t]*\z', '') AS text FROM (SELECT doc_id, concat('<think>a', text, '</think>', chr(10), chr(10), text, chr(10), ' ') AS t FROM documents)")
def strip_pipeline(spark, sf_dir):
    """Delimited parts go, then empty lines, in one pass over the text."""
    t = F.concat(F.lit("<think>a"), "text", F.lit("</think>\n\n"), "text", F.lit("\n "))
    return load(spark, sf_dir, "documents").select("doc_id", tx.strip_pipeline(t, "<think>", "</think>", empty=True).alias("text"))


# --- streams ------------------------------------------------------------------------------------------------

_CHAT = """concat('{"id":"c', user_id, '","model":"m', event_id % 3, '","provider":"p', event_id % 2, '","choices":[{"index":', event_id % 2, ',"native_finish_reason":', CASE WHEN event_id % 9 = 0 THEN '"end"' ELSE 'null' END, ',"delta":{"role":"assistant","content":"', event_type, ' "',
 CASE WHEN event_id % 5 = 0 THEN ',"reasoning_content":"why "' ELSE '' END, CASE WHEN event_id % 4 = 0 THEN concat(',"reasoning_details":[{"type":"reasoning.text","index":', event_id % 3, ',"text":"t', event_id % 10, '"}]') ELSE '' END, '},"finish_reason":', CASE WHEN event_id % 7 = 0 THEN '"stop"' ELSE 'null' END, '}]',
 CASE WHEN event_id % 11 = 0 THEN concat(',"usage":{"prompt_tokens":', event_id % 97, '}') WHEN event_id % 13 = 0 THEN concat(',"usage":{"completion_tokens":', event_id % 31, '}') ELSE '' END, '}')"""


def stream_events(spark, sf_dir, data):
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"), F.expr(data).alias("data"))


_HEAD = """h AS (SELECT user_id, arg_max('m' || event_id % 3, event_id) AS model, arg_max((event_id % 97)::VARCHAR, event_id) FILTER (WHERE event_id % 11 = 0) AS prompt_tokens, arg_max((event_id % 31)::VARCHAR, event_id) FILTER (WHERE event_id % 13 = 0 AND event_id % 11 <> 0) AS completion_tokens FROM events GROUP BY user_id)"""


@query(f"""WITH {_HEAD}, c AS (SELECT user_id, (event_id % 2)::INT AS idx, string_agg(event_type || ' ', '' ORDER BY event_id) AS content, string_agg('why ', '') FILTER (WHERE event_id % 5 = 0) AS reasoning, max(CASE WHEN event_id % 7 = 0 THEN 'stop' END) AS finish FROM events GROUP BY 1, 2)
SELECT user_id, 'c' || user_id AS id, model, prompt_tokens, completion_tokens, idx, content, reasoning, finish FROM c JOIN h USING (user_id)""")
def accumulate_chat(spark, sf_dir):
    rows = accumulate.accumulate_chat(stream_events(spark, sf_dir, _CHAT)).select("*", F.explode("choices").alias("c"))
    return rows.select(F.col("request_id").alias("user_id"), "id", "model", F.col("usage")["prompt_tokens"].alias("prompt_tokens"), F.col("usage")["completion_tokens"].alias("completion_tokens"), F.col("c.index").alias("idx"), F.col("c.content").alias("content"), F.col("c.reasoning_content").alias("reasoning"), F.col("c.finish_reason").alias("finish"))


@query("""WITH p AS (SELECT user_id, arg_max('p' || event_id % 2, event_id) AS provider FROM events GROUP BY 1), c AS (SELECT user_id, (event_id % 2)::INT AS idx, string_agg('why ', '') FILTER (WHERE event_id % 5 = 0) AS flat, max(CASE WHEN event_id % 9 = 0 THEN 'end' END) AS native FROM events GROUP BY 1, 2),
d AS (SELECT user_id, (event_id % 2)::INT AS idx, event_id % 3 AS part, min(event_id) AS first, string_agg('t' || event_id % 10, '' ORDER BY event_id) AS t FROM events WHERE event_id % 4 = 0 GROUP BY 1, 2, 3), e AS (SELECT user_id, idx, string_agg(part || '=' || t, ';' ORDER BY first) AS details FROM d GROUP BY 1, 2)
SELECT user_id, provider, idx, CASE WHEN details IS NULL THEN flat END AS reasoning, native, details FROM c JOIN p USING (user_id) LEFT JOIN e USING (user_id, idx)""")
def accumulate_router(spark, sf_dir):
    rows = accumulate.accumulate_chat(stream_events(spark, sf_dir, _CHAT), router=True).select("*", F.explode("choices").alias("c"))
    shown = F.array_join(F.transform("c.reasoning_details", lambda d: F.concat(d["index"], F.lit("="), d["text"])), ";")
    return rows.select(F.col("request_id").alias("user_id"), "provider", F.col("c.index").alias("idx"), F.col("c.reasoning").alias("reasoning"), F.col("c.native_finish_reason").alias("native"), shown.alias("details"))


_PLAIN = """concat('{"id":"t","model":"m', event_id % 3, '","choices":[{"text":"', event_type, ' "', CASE WHEN event_id % 7 = 0 THEN ',"finish_reason":"length"' ELSE '' END, '}]}')"""


@query("SELECT user_id, arg_max('m' || event_id % 3, event_id) AS model, string_agg(event_type || ' ', '' ORDER BY event_id) AS text, max(CASE WHEN event_id % 7 = 0 THEN 'length' END) AS finish FROM events GROUP BY user_id")
def accumulate_completions(spark, sf_dir):
    rows = accumulate.accumulate_completions(stream_events(spark, sf_dir, _PLAIN))
    c = F.element_at("choices", 1)
    return rows.select(F.col("request_id").alias("user_id"), "model", c["text"].alias("text"), c["finish_reason"].alias("finish"))


_RESPONSES = """CASE WHEN event_id % 10 = 9 AND user_id % 2 = 0 THEN concat('{"type":"response.completed","response":{"id":"r', event_id, '","status":"completed","model":"z","usage":{"total_tokens":', event_id % 50, '},"output":[{"id":', event_id, '}]}}') ELSE concat('{"type":"response.output_text.delta","delta":"', event_type, ' "}') END"""


@query("""WITH e AS (SELECT *, event_id % 10 = 9 AND user_id % 2 = 0 AS whole FROM events), g AS (SELECT user_id, max(event_id) FILTER (WHERE whole) AS l, string_agg(event_type || ' ', '' ORDER BY event_id) FILTER (WHERE NOT whole) AS text FROM e GROUP BY 1)
SELECT user_id, 'r' || l AS id, CASE WHEN l IS NOT NULL THEN 'z' END AS model, 'completed' AS status, (l % 50)::VARCHAR AS total_tokens, coalesce('[{"id":' || l || '}]', '[{"type":"message","role":"assistant","content":[{"type":"output_text","text":"' || text || '"}]}]') AS output FROM g""")
def accumulate_responses(spark, sf_dir):
    rows = accumulate.accumulate_responses(stream_events(spark, sf_dir, _RESPONSES))
    return rows.select(F.col("request_id").alias("user_id"), "id", "model", "status", F.col("usage")["total_tokens"].alias("total_tokens"), "output")


# --- JSON tools -----------------------------------------------------------------------------------------


@query("""SELECT doc_id, '{"a":{"b":[' || doc_id % 7 || ',{"c":"' || source || '"}],"e":{}},"k' || doc_id % 3 || '":' || CASE WHEN doc_id % 2 = 0 THEN 'null' ELSE 'true' END || '}' AS sorted FROM documents""")
def json_sorted(spark, sf_dir):
    """Keys in byte order at every level, from a text with other orders and white space."""
    mixed = F.expr("""concat('{ "k', doc_id % 3, '": ', CASE WHEN doc_id % 2 = 0 THEN 'null' ELSE 'true' END, ', "a": {"e": {}, "b": [', doc_id % 7, ', {"c": "', source, '"}]}}')""")
    return load(spark, sf_dir, "documents").select("doc_id", jsontree.sorted_json(mixed).alias("sorted"))


@query("""SELECT doc_id, unnest(['a.b', 'k' || doc_id % 3]) AS key, unnest(['[' || doc_id % 7 || ',{"c":"' || source || '"}]', CASE WHEN doc_id % 2 = 0 THEN 'null' ELSE 'true' END]) AS value FROM documents""")
def json_keys(spark, sf_dir):
    """Dotted keys; arrays are leaves."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.expr(_TREE).alias("j"))
    return jsontree.flatten(d, "doc_id", "j", arrays=False).select("doc_id", F.array_join("path", ".").alias("key"), "value")


@query("SELECT DISTINCT source || '.' || (doc_id % 4) AS key FROM documents WHERE NOT starts_with(source, 'src0') AND doc_id % 4 = 3")
def unused_keys(spark, sf_dir):
    """Keys that no source text holds, exempt prefixes aside."""
    docs = load(spark, sf_dir, "documents")
    keys = docs.select(F.concat("source", F.lit("."), (F.col("doc_id") % 4).cast("string")).alias("key")).distinct()
    texts = docs.where(F.col("doc_id") % 4 < 3).select(F.concat("text", F.lit(" t('"), "source", F.when(F.col("doc_id") % 2 == 0, "?.").otherwise("."), (F.col("doc_id") % 4).cast("string"), F.lit("')")).alias("text"))
    return jsontree.unused_keys(keys, texts, ["src0"])


# --- runs ---------------------------------------------------------------------------------------------------


def mock(line, attempt, temperature):
    """Scenarios by length: a passing error, a moderated text, a stream that fails half way."""
    kind = len(line or "") % 10
    if kind == 0 and attempt == 1:
        return run.Outcome(502, code="API_ERROR_502", retry_after=3.0)
    if kind == 1:
        return run.Outcome(403, message="blocked for safety")
    return run.Outcome(200, code="STREAM_FAILED", message="response.failed") if kind == 2 else run.Outcome(text=(line or "")[:10])


def _requests(spark, sf_dir):
    return load(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("n"), F.concat(F.lit("request-"), "doc_id").alias("custom_id"), F.col("text").alias("line"))


@query("""SELECT doc_id + 1 AS n, 'request-' || doc_id AS custom_id, CASE k WHEN 1 THEN 'fail' WHEN 2 THEN 'fail' ELSE 'ok' END AS decision, CASE WHEN k IN (0, 2) THEN 2 ELSE 1 END::INT AS attempts, CASE k WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END::INT AS failures, CASE k WHEN 0 THEN 3500.0 WHEN 2 THEN 5500.0 ELSE 0.0 END::DOUBLE AS waited_ms,
 CASE WHEN k NOT IN (1, 2) THEN substr(text, 1, 10) END AS text, CASE k WHEN 1 THEN 'max_retries' WHEN 2 THEN 'STREAM_FAILED' END AS error_code, CASE k WHEN 1 THEN 'blocked for safety' WHEN 2 THEN 'response.failed' END AS error_message FROM (SELECT *, length(coalesce(text, '')) % 10 AS k FROM documents)""")
def run_batch_mock(spark, sf_dir):
    """A whole run without a failure limit against a deterministic model: what each request came to, and what it waited."""
    path = staging.fresh_path(spark, "run")
    run.run_batches(_requests(spark, sf_dir), mock, run.Limits(batch_size=1 << 40, max_fail=0, parallel=8), path, 1, sleep=lambda s: None, jitter=lambda: 500.0)
    return run.results_of(spark, path).drop("batch")


@query("""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents), t AS (SELECT count(*) // 2 AS stop, greatest(1, count(*) // 4) AS size FROM d)
SELECT n, 'request-' || doc_id AS custom_id, CASE WHEN n < stop THEN 'ok' WHEN n = stop THEN 'abort' ELSE 'cancelled' END AS decision FROM d, t WHERE (n - 1) // size <= (stop - 1) // size""")
def run_batch_abort(spark, sf_dir):
    """An account-wide status in the middle: its batch is saved, what was left of it is cancelled, later batches never run."""
    from weftline.operators.request import global_ids

    docs = global_ids(load(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])
    rows = staging.staged(docs.select("n", F.concat(F.lit("request-"), "doc_id").alias("custom_id"), F.col("n").cast("string").alias("line")), "requests")
    total = rows.count()
    at, size, path = str(total // 2), max(1, total // 4), staging.fresh_path(spark, "run")
    run.run_batches(rows, lambda line, attempt, t: run.Outcome(429) if line == at else run.Outcome(text="fine"), run.Limits(batch_size=size), path, -(-total // size), sleep=lambda s: None)
    return run.results_of(spark, path).select("n", "custom_id", "decision")


# --- smaller operators ---------------------------------------------------------------------------------


@query("SELECT doc_id, pos::INT AS pos, substr(text, pos * 500 + 1, 500) AS slice FROM documents, unnest(range(0, ceil(length(text) / 500.0)::BIGINT)) AS t(pos)")
def text_slices(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.posexplode(segment.slices(F.col("text"), 500)).alias("pos", "slice"))


@query("SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 7 AS batch, coalesce(min(CASE WHEN event_id % 9 > 0 THEN event_id % 9 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 5) AS lowest FROM events")
def batch_limits(spark, sf_dir):
    """Batches of seven for each user, and the lowest limit among a request and those after it."""
    from pyspark.sql import Window

    e = load(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 9).alias("m"))
    e = e.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    return run.lowest_limit(e, "user_id", "event_id", "m").select("event_id", run.batch_number(F.col("n"), 7).alias("batch"), F.col("lowest").cast("long").alias("lowest"))


@query(_TALK + """SELECT conv_id, to_json({messages: m, temperature: 0.5, provider: {allow: ['a', 'b']}, session_id: 'tc_' || conv_id, stream: true})::VARCHAR AS body FROM t""")
def payload_router(spark, sf_dir):
    provider = F.struct(F.array(F.lit("a"), F.lit("b")).alias("allow"))
    body = request.router_body(F.col("m"), {"temperature": 0.5}, provider, F.concat(F.lit("tc_"), F.col("conv_id").cast("string")), True)
    return talks(spark, sf_dir).select("conv_id", F.to_json(body).alias("body"))


@query("SELECT doc_id, source AS a, (doc_id % 9)::VARCHAR AS b, 'over' AS c FROM documents")
def body_overlay(spark, sf_dir):
    """Members of extra_body replace those of the body and join them."""
    d = load(spark, sf_dir, "documents")
    body, extra = F.to_json(F.struct(F.col("source").alias("a"), F.lit("under").alias("c"))), F.concat(F.lit('{"c":"over","b":'), F.col("doc_id") % 9, F.lit("}"))
    out = d.select("doc_id", request.overlay(body, extra).alias("j"))
    return out.select("doc_id", *(F.get_json_object("j", f"$.{k}").alias(k) for k in "abc"))


@query(f"""WITH p AS (SELECT doc_id // 2 AS pair, max(CASE WHEN doc_id % 2 = 0 THEN text END) AS a, max(CASE WHEN doc_id % 2 = 1 THEN text END) AS b FROM (SELECT doc_id, text || chr(10) || ' ' || chr(10) || 'end' AS text FROM documents) GROUP BY 1),
s AS (SELECT pair, string_split({STRIP.format('a')}, chr(10)) AS x, string_split({STRIP.format('b')}, chr(10)) AS y FROM p WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT pair, unnest(range(0, len(x)))::INT AS pos, unnest(x) AS left_line, unnest(y) AS right_line, NULL AS error FROM s WHERE len(x) = len(y) UNION ALL SELECT pair, 0, NULL, NULL, 'LINE_COUNT' FROM s WHERE len(x) <> len(y)""")
def compare_texts(spark, sf_dir):
    """Each even document against the odd one after it, without empty lines; unequal numbers of lines are an error."""
    d = load(spark, sf_dir, "documents").select(F.expr("doc_id div 2").alias("pair"), (F.col("doc_id") % 2).alias("side"), F.concat("text", F.lit("\n \nend")).alias("text"))
    pairs = d.groupBy("pair").agg(F.max(F.when(F.col("side") == 0, F.col("text"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("text"))).alias("b")).where("a is not null and b is not null")
    return resume.compare_texts(pairs, "pair", "a", "b")


@query(f"WITH {_R} SELECT {_STR(_B + '.provider')} AS provider, count(*) AS n, min(doc_id) AS first_seen FROM (SELECT *, {_code_sql(True)} AS o FROM v) WHERE o IS NULL AND nullif({_STR(_B + '.provider')}, '') IS NOT NULL GROUP BY 1")
def batch_by_provider(spark, sf_dir):
    return stats.counts_by(stats.batch_rows(results(spark, sf_dir)), "provider", "doc_id")


_NAMES = "CASE doc_id % 5 WHEN 0 THEN 'FRANCAIS' WHEN 1 THEN 'français' WHEN 2 THEN 'Francés' WHEN 3 THEN 'Français' ELSE 'francais' END"


@query(f"SELECT doc_id, strip_accents(lower({_NAMES})) = 'francais' AS same FROM documents")
def collated_equality(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", tx.same_collated(F.expr(_NAMES), F.lit("Français")).alias("same"))


@query("""SELECT doc_id + 1 AS n, CASE WHEN length(coalesce(text, '')) % 10 IN (1, 2) THEN to_json({custom_id: 'request-' || doc_id, response: NULL, error: {code: CASE WHEN length(text) % 10 = 1 THEN 'max_retries' ELSE 'STREAM_FAILED' END, message: CASE WHEN length(text) % 10 = 1 THEN 'blocked for safety' ELSE 'response.failed' END}})
 ELSE to_json({custom_id: 'request-' || doc_id, response: {status_code: 200, request_id: 'batch', body: {choices: [{message: {content: substr(text, 1, 10)}}]}}, error: NULL}) END::VARCHAR AS line FROM documents""")
def run_lines(spark, sf_dir):
    """The result lines of a run, of good and failed requests."""
    path = staging.fresh_path(spark, "run")
    run.run_batches(_requests(spark, sf_dir), mock, run.Limits(batch_size=1 << 40, max_fail=0, parallel=8), path, 1, sleep=lambda s: None, jitter=lambda: 0.0)
    body = F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices"))
    return run.response_lines(run.results_of(spark, path), body)


_PACE = "(event_id % 3 + 1) / 100.0"


@query(f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1000.0 AS arr, 60000.0 / ({_PACE}) AS gap, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT event_id, user_id, n, arr AS start_ms FROM e WHERE n = 1 UNION ALL SELECT e.event_id, e.user_id, e.n, greatest(e.arr, s.start_ms + e.gap) FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT event_id, round(start_ms)::BIGINT AS start_ms FROM s""")
def rpm_schedule_varying(spark, sf_dir):
    """Each request has a rate of its own."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0).alias("at"), F.struct("ts", "event_id").alias("o"), F.expr(_PACE).cast("double").alias("rate"))
    return run.paced(e, "at", "o", F.col("rate"), "user_id").select("event_id", F.round("start_ms").cast("long").alias("start_ms"))


_SCRIPTS = "concat(text, CASE doc_id % 4 WHEN 0 THEN ' 中文字符' WHEN 1 THEN ' ☀🙂' WHEN 2 THEN ' 𝔘𝔫' ELSE ' éß' END)"


@query(f"SELECT doc_id, ceil(CASE doc_id % 4 WHEN 0 THEN 4 * 1.5 ELSE 0 END + CASE doc_id % 4 WHEN 1 THEN 2 * 2.0 ELSE 0 END + 2.0 * len(regexp_extract_all(text, '[#*0-9]')) + (len(regexp_replace(text, '[#*0-9]', '', 'g')) + 1 + CASE doc_id % 4 WHEN 2 THEN 4 WHEN 3 THEN 2 ELSE 0 END) / 4.0)::BIGINT AS tokens, length(text) + CASE doc_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 5 ELSE 3 END AS units FROM documents")
def token_scripts(spark, sf_dir):
    """Tokens and UTF-16 units of texts with CJK, symbols, astral letters and accents."""
    t = F.expr(_SCRIPTS)
    return load(spark, sf_dir, "documents").select("doc_id", tx.approximate_tokens(t).alias("tokens"), tx.utf16_length(t).cast("long").alias("units"))


@query(r"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\s`]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, unnest(['one' || chr(10) || chr(10), t || chr(10), '```py' || chr(10) || t || chr(10) || '```' || chr(10), 'end ' || t]) AS text, unnest([0, 1, 2, 3])::INT AS pos, unnest([false, false, true, false]) AS is_code FROM d""")
def stream_blocks(spark, sf_dir):
    """Whole texts streamed in four pieces, as a paragraph, a line, code and a last line."""
    t = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\s`]+", " ")
    cut = F.array(F.lit("one\n\n"), t, F.concat(F.lit("\n```py\n"), t), F.concat(F.lit("\n```\nend "), t))
    rows = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(cut).alias("seq", "text"))
    return blocks.fold_blocks(rows, "doc_id", "seq", "text")


@query("""SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'From ' || lang || ' to xx.' END AS system, CASE doc_id % 4 WHEN 0 THEN 'Read ' || text || ' first' WHEN 1 THEN 'Translate from ' || lang || chr(10) || chr(10) || text WHEN 2 THEN text END AS prompt, CASE doc_id % 8 WHEN 7 THEN 'So, xx:' END AS prefill, CASE doc_id % 8 WHEN 3 THEN 'PROMPT_MISSING' END AS error
FROM (SELECT doc_id, coalesce(lang, '') AS lang, 't ' || coalesce(text, '') AS text FROM documents)""")
def prompt_assembly(spark, sf_dir):
    """System text, prompt with context and prefill of a translating batch, by what is switched on."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.concat(F.lit("t "), F.coalesce("text", F.lit(""))).alias("text"))
    case = F.col("doc_id") % 4
    asked = F.when(case == 0, "Read {{ .ContextualInformation }} first").when(case == 1, "Translate from {{ .LanguageSource }}")
    made = prompts.assemble(F.when(F.col("doc_id") % 2 == 0, "From {{ .LanguageSource }} to {{.LanguageTarget}}."), asked, F.when(F.col("doc_id") % 8 == 7, "So, {{ .LanguageTarget }}:"), F.when(case < 3, F.col("text")), F.col("lang"), F.lit("xx"))
    return d.select("doc_id", made.alias("m")).select("doc_id", "m.*")


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'reasoning' ELSE 'instruct' END WHEN 1 THEN 'default' END AS variant FROM documents""")
def model_variants(spark, sf_dir):
    """Which part of a model's configuration counts: asking turns a default of reasoning round."""
    n = F.col("doc_id")
    kind = F.when(n % 3 == 0, "reason_and_instruct").when(n % 3 == 1, "reason_only").otherwise("other")
    return load(spark, sf_dir, "documents").select(n, options.variant_name(kind, options.uses_reasoning(n % 4 < 2, (n % 4 == 1) | (n % 4 == 2))).alias("variant"))


@query("""SELECT doc_id, source AS kept, CASE doc_id % 3 WHEN 0 THEN NULL ELSE 'high' END AS reasoning_effort, CASE doc_id % 3 WHEN 0 THEN '0.9' WHEN 1 THEN '0.25' END AS top_p, CASE doc_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.5 ELSE 0.1 END::DOUBLE AS temperature, CASE doc_id % 3 WHEN 0 THEN 64 END::INT AS max_tokens FROM documents WHERE source IS NOT NULL""")
def sent_bodies(spark, sf_dir):
    """Bodies of lines without settings, with some that replace members, and with a temperature that no retry has changed."""
    d = load(spark, sf_dir, "documents").where("source is not null")
    n = F.col("doc_id") % 3
    body = F.to_json(F.struct(F.col("source").alias("kept"), F.lit("high").alias("reasoning_effort"), F.when(n != 0, F.lit(0.1)).otherwise(F.lit(0.7)).alias("temperature")))
    meta = F.when(n == 1, F.lit('{"top_p":0.25,"rpm":5}')).when(n == 2, F.lit('{"temperature":0.1}'))
    sent = request.sent_body(body, meta, F.when(n != 2, F.lit(0.5)), ("temperature", "top_p", "max_tokens"), {"top_p": 0.9, "max_tokens": 64, "seed": 3})
    out = d.select("doc_id", sent.alias("j"))
    got = {k: F.get_json_object("j", f"$.{k}") for k in ("kept", "reasoning_effort", "top_p", "temperature", "max_tokens")}
    return out.select("doc_id", *(c.cast({"temperature": "double", "max_tokens": "int"}.get(k, "string")).alias(k) for k, c in got.items()))


@query("""SELECT doc_id, 'Processed ' || (doc_id + 1) || ' of ' || (SELECT count(*) FROM documents) || CASE WHEN doc_id % 5 = 0 THEN ' [FAILED: request-' ELSE ' [OK: request-' END || doc_id || ']' AS line FROM documents""")
def progress_lines(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id")
    total = d.count()
    return d.select("doc_id", run.progress(F.col("doc_id") + 1, F.lit(total), F.concat(F.lit("request-"), "doc_id"), F.col("doc_id") % 5 == 0, "Processed {{ .Processed }} of {{ .Total }}").alias("line"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'max_tokens' WHEN 2 THEN 'error' WHEN 3 THEN 'malformed' END AS error_code, CASE doc_id % 4 WHEN 0 THEN text END AS text FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""")
def whole_answers(spark, sf_dir):
    """Answers that came whole: the checks and readers of result lines hold for them."""
    n = F.col("doc_id") % 4
    said = F.to_json(F.struct(F.array(F.struct(F.struct(F.coalesce("text", F.lit("")).alias("content")).alias("message"), F.when(n == 1, "length").otherwise("stop").alias("finish_reason"))).alias("choices"), F.when(n == 2, F.struct(F.lit("busy").alias("message"))).alias("error")))
    raw = F.when(n == 3, F.concat(said, F.lit("}},{"))).otherwise(said)
    rows = load(spark, sf_dir, "documents").select("doc_id", jsonl.as_result(raw, F.col("doc_id").cast("string")).alias("v"))
    return jsonl.parse_results(rows).select("doc_id", "error_code", "text")


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN rpad('text ' || doc_id, 40, ' ') ELSE '字' || doc_id || repeat('　', (38 - length(doc_id::VARCHAR)) // 2) || repeat(' ', (38 - length(doc_id::VARCHAR)) % 2) END || ' - ' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'to ' || doc_id END AS line FROM documents""")
def compare_layout(spark, sf_dir):
    """Two files side by side: the left is padded to 40 columns, by wide spaces in files with wide characters."""
    d, even = load(spark, sf_dir, "documents"), F.col("doc_id") % 2 == 0
    left = F.concat(F.when(even, "text ").otherwise("字"), F.col("doc_id").cast("string"))
    right = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("to "), F.col("doc_id").cast("string")))
    return d.select("doc_id", F.explode(markup.side_by_side(left, right, 40, ~even)).alias("line"))
