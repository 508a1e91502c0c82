"""Files in and out, options, prompts, streams and runs on small cases."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.functions import markup, text as tx
from weftline.operators import jsonl, jsontree, options, prompts, request, run
from weftline.sources import files, staging
from weftline.streaming import accumulate, blocks


def test_lines_over_blocks(spark, tmp_path):
    """Numbers are those of the file, however many tasks read it."""
    rows = [f'{{"n": {i}}}' if i % 5 else "" for i in range(2000)]
    (tmp_path / "a.jsonl").write_text("\n".join(rows))
    (tmp_path / "b.jsonl").write_text("x\n{}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = files.jsonl_files(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    a = sorted((r.line_no, r.line) for r in got if r.file.endswith("a.jsonl"))
    assert a == [(i + 1, t) for i, t in enumerate(rows) if t]
    assert {(r.line_no, r.v is None) for r in got if r.file.endswith("b.jsonl")} == {(1, True), (2, False)}


def test_checks_and_literals(spark, tmp_path):
    path = tmp_path / "p.txt"
    path.write_text("from the file\n")
    for args, code in (((str(tmp_path / "none"), None), "ENOENT"), ((str(path), str(path)), "SOURCE_TARGET_SAME"), ((str(path), None, 3), "FILE_TOO_LARGE")):
        with pytest.raises(files.FileProblem, match=code):
            files.validate(spark, *args)
    files.validate(spark, str(path), str(tmp_path / "other"))
    read = lambda v: files.file_or_literal(spark, v)
    assert [read(None), read("  "), read("a\nb"), read(str(path)), read("no such")] == ["", "", "a\nb", "from the file\n", "no such"]
    (tmp_path / "ignore").write_text("# all\n*.log\n\n dist \n*.log\n")
    assert files.pattern_list(spark, str(tmp_path / "ignore")) == ["*.log", "dist"] and files.pattern_list(spark, "a:b:a") == ["a", "b"]


def test_listing(spark, tmp_path):
    for name in ("a.ts", "src/b.ts", "src/deep/c.ts", "dist/d.ts", "src/e.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    names = lambda p, i=(): sorted(r.name for r in files.list_files(spark, str(tmp_path), p, i).collect())
    assert names(["**/*.ts"], ["dist"]) == ["a.ts", "src/b.ts", "src/deep/c.ts"]
    assert names(["*.{ts,md}"]) == ["a.ts"] and names(["src/*"]) == ["src/b.ts", "src/e.md"] and names(["src/**"], ["src/deep"]) == ["src/b.ts", "src/e.md"]


def test_sinks(spark, tmp_path):
    rows, path = spark.createDataFrame([("a",), ("b",)], "line string"), str(tmp_path / "out")
    files.create_lines(rows, path)
    with pytest.raises(files.FileProblem, match="TARGET_EXISTS"):
        files.create_lines(rows, path)
    files.replace_lines(rows.limit(1), path)
    assert spark.read.text(path).count() == 1
    files.replace_text(spark, str(tmp_path / "t"), "one é")
    files.replace_text(spark, str(tmp_path / "t"), "two é")
    assert (tmp_path / "t").read_text() == "two é"
    assert files.take_lock(spark, str(tmp_path / "lock")) and not files.take_lock(spark, str(tmp_path / "lock"))
    files.drop_lock(spark, str(tmp_path / "lock"))
    assert files.take_lock(spark, str(tmp_path / "lock"))


def test_config(spark, tmp_path):
    path = str(tmp_path / "c.json")
    assert files.load_config(spark, path, {"TEMPLATES": {"A": "x\r\n{{B}}", "B": "y"}, "p": ["{{A}} {{C}}"]})["p"] == ["x\n{{B}} {{C}}"]
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(files.FileProblem, match="INVALID_JSON"):
        files.load_config(spark, str(tmp_path / "bad.json"), {})
    assert files.json_file(spark, str(tmp_path / "bad.json")).first().error == "INVALID_JSON"


def test_media(spark, tmp_path):
    for name in ("a.png", "b.PNG", "c.bin"):
        (tmp_path / name).write_bytes(b"same")
    assert [r.url for r in files.image_urls(spark, str(tmp_path)).collect()] == ["data:image/png;base64,c2FtZQ=="]
    with pytest.raises(files.FileProblem, match="UNSUPPORTED_AUDIO"):
        files.audio_part(spark, str(tmp_path / "c.bin"))
    (tmp_path / "s.mp3").write_bytes(b"s")
    assert tuple(files.audio_part(spark, str(tmp_path / "s.mp3")).first()) == ("cw==", "mp3")
    shown = spark.range(1).select(F.to_json(prompts.media_parts(F.lit("t"), images=F.array(F.lit("u")))).alias("j")).first().j
    assert json.loads(shown) == [{"type": "image_url", "image_url": {"url": "u"}}, {"type": "text", "text": "t"}]
    for kind, code in (({"images": F.array(), "audio": F.lit(1)}, "MUTUALLY"), ({"images": F.array(), "endpoint": "completions"}, "MEDIA_NOT"), ({"audio": F.lit(1), "endpoint": "responses"}, "AUDIO_NOT")):
        with pytest.raises(ValueError, match=code):
            prompts.media_parts(F.lit("t"), **kind)


def test_options(spark):
    cases = [("chunkSize", 0), ("chunkSize", 1), ("chunkSize", 1.5), ("parallel", 129), ("rpm", 0), ("rpm", 0.1), ("temperature", 2.1), ("seed", 0), ("maxFail", 0), ("idleTimeout", 0.0001), ("nothing", 1)]
    rows = spark.createDataFrame([(k, float(v)) for k, v in cases], "k string, v double")
    got = {(r.k, r.v): (r.ok, r.code) for r in rows.select("*", options.in_range(F.col("k"), F.col("v")).alias("ok"), options.error_code(F.col("k"), F.col("v")).alias("code")).collect()}
    for k, v in cases:
        want = options.RANGES[k].holds(v) if k in options.RANGES else False
        assert got[k, float(v)] == (want, None if want or k == "nothing" else options.RANGES[k].code)
    options.check({"batchSize": 5, "endpoint": "chat", "tempValues": [0, 1.5], "url": "https://x"})
    for bad, code in (({"batchSize": True}, "INVALID_BATCH_SIZE"), ({"endpoint": "x"}, "INVALID_ENDPOINT"), ({"tempValues": [3]}, "INVALID_TEMP_VALUE"), ({"url": "ftp://x"}, "INVALID_URL_SCHEME")):
        with pytest.raises(ValueError, match=code):
            options.check(bad)
    assert options.first_given("7", 1, 2) == 7.0 and options.first_given(None, None, 2) == 2 and options.number("x") != options.number("x")
    assert options.common_params(("a", "b", "c"), {"a": (True, 1), "b": (False, 2)}, {"c": (False, 3)}) == {"a": 1, "c": 3}


def test_tasks_of_a_run():
    """The four scenarios, a limit of 0, a request's own settings, pacing, and what is cancelled."""
    slept = []
    task = lambda model, limits=None: run.Task(model, limits or run.Limits(), 0, slept.append, clock=lambda: 0.0, jitter=lambda: 10.0)
    once = lambda line, attempt, t: run.Outcome(502, code="API_ERROR_502", retry_after=3.0) if attempt == 1 else run.Outcome(text="ok")
    assert task(once).request("x") == ("ok", 2, 1, 3010.0, "ok", None, None) and slept == [3.01]
    assert task(lambda *a: run.Outcome(403, message="Safety first")).request("x")[:2] == ("fail", 1)
    assert task(lambda *a: run.Outcome(200, code="STREAM_FAILED")).request("x")[0] == "fail"
    for status in (429, 402, 503):
        t = task(lambda *a, status=status: run.Outcome(status))
        assert t.request("x")[0] == "abort" and t.request("y")[:3] == ("cancelled", 0, 0)
    always = lambda *a: run.Outcome(502)
    assert [task(always, run.Limits(max_fail=0)).request("x")[:2] for _ in range(3)] == [("fail", 2)] * 3
    t = task(always, run.Limits(max_fail=3))
    assert [t.request("x")[0] for _ in range(3)] == ["fail", "abort", "cancelled"]
    assert t.request("x")[5] == "ABORTED" and task(always, run.Limits(max_fail=1)).request("x")[5] == "MAX_FAIL_REACHED"
    assert task(always).request("x", {"max_attempts": 4, "retry_delay_ms": 1.0, "unknown": 3})[:2] == ("fail", 4)
    assert task(always, run.Limits(failure_ends_run=True)).request("x")[0] == "abort"
    slept.clear()
    t = task(lambda *a: run.Outcome(text=""), run.Limits(per_minute=60))
    assert [t.request("x")[3] for _ in range(2)] == [0.0, 1000.0] and slept == [1.0]


def test_runs_resume(spark):
    """Batches that are saved are not run again; failures count over batches."""
    path = staging.fresh_path(spark, "run")
    rows = spark.createDataFrame([(i, f"request-{i}", "bad" if i in (2, 5) else "x") for i in range(1, 9)], "n long, custom_id string, line string")
    model = lambda line, attempt, t: run.Outcome(502) if line == "bad" else run.Outcome(text=line)
    go = lambda limits: run.run_batches(rows, model, limits, path, 4, sleep=lambda s: None, jitter=lambda: 0.0)
    assert go(run.Limits(batch_size=2, max_attempts=1, max_fail=2)) == "aborted"
    first = {(r.n, r.decision) for r in run.results_of(spark, path).collect()}
    assert first == {(1, "ok"), (2, "fail"), (3, "ok"), (4, "ok"), (5, "abort"), (6, "cancelled")}
    assert run.run_batches(rows, lambda *a: run.Outcome(500), run.Limits(batch_size=2, max_fail=2), path, 4) == "aborted"
    assert {(r.n, r.decision) for r in run.results_of(spark, path).collect()} == first


def test_request_texts(spark):
    lines = [
        ({"messages": [{"role": "user", "content": "a"}, {"content": [{"type": "text", "text": "b"}, {"type": "image_url"}, {"type": "text", "text": 5}]}, {"content": None}]}, "a\nb\n"), ({"prompt": "p"}, "p"), ({"input": "i"}, "i"),
        ({"input": [{"content": "lost"}, {"content": [{"type": "input_text", "text": "x"}, {"type": "output_text", "text": "y"}]}]}, "\nxy"), ({"other": 1}, ""),
    ]
    rows = spark.createDataFrame([(k, json.dumps({"custom_id": "r", "body": b})) for k, (b, _) in enumerate(lines)], "k int, line string")
    got = {r.k: r.t for r in jsonl.read_lines(rows).select("k", prompts.prompt_text(F.col("v")).alias("t")).collect()}
    assert got == {k: t for k, (_, t) in enumerate(lines)}
    one = spark.range(1).select(prompts.completed_text(F.lit("why"), F.lit("t")).alias("a"), prompts.completed_text(F.lit(None), F.lit("t")).alias("b"), prompts.with_context(F.lit("p"), F.lit("c")).alias("c"), prompts.with_context(F.lit("p {{ .ContextualInformation }}!"), F.lit("c")).alias("d")).first()
    assert tuple(one) == ("why\nt", "t", "p\n\nc", "p c!")


def test_accumulated_details(spark):
    events = [{"id": "1", "provider": "p", "choices": [{"delta": {"content": "a", "reasoning": "r", "reasoning_details": [{"type": "t", "index": 0, "text": "x"}]}}]}, {"choices": [{"index": 0, "delta": {"reasoning_details": [{"type": "t", "index": 0, "text": "y"}, {"type": "u", "index": 0, "data": "z"}]}, "finish_reason": "stop"}], "usage": {"a": 1}}, {"usage": {"b": {"c": 2}}}]
    rows = spark.createDataFrame([(7, k, json.dumps(e)) for k, e in enumerate(events)] + [(7, 9, "not json"), (8, 0, "{}")], "request_id long, seq int, data string")
    got = {r.request_id: r for r in accumulate.accumulate_chat(rows, router=True).collect()}
    c = got[7].choices[0]
    assert (got[7].id, got[7].provider, got[7].usage, c.content, c.reasoning, c.finish_reason) == ("1", "p", {"a": "1", "b": '{"c":2}'}, "a", None, "stop")
    assert [tuple(d) for d in c.reasoning_details] == [("t", 0, "xy", None, None), ("u", 0, None, None, "z")]
    assert got[8].choices is None and got[8].id is None


def test_json_tools(spark):
    deep = {"a": [{"b": {"c": [1, {"d": {"e": {"f": {"g": {"h": {"i": [5, {}]}}}}}}]}}], "z": "é"}
    rows = spark.createDataFrame([(1, json.dumps(deep)), (2, None), (3, "{"), (4, "7"), (5, "[]")], "id long, j string")
    got = Counter((r.id, "/".join(r.path), r.value) for r in jsontree.flatten(rows, "id", "j").collect())
    assert got == Counter([(1, "a/0/b/c/0", "1"), (1, "a/0/b/c/1/d/e/f/g/h/i/0", "5"), (1, "z", '"é"'), (4, "", "7")])
    pairs = spark.createDataFrame([(1, None, "{}"), (2, "{", "{}"), (3, "5", '{"a":1}'), (4, '{"a":1}', "[]")], "k int, l string, r string")
    assert {r.k: r.result for r in jsontree.map_pairs(pairs, "l", "r", ["k"], "missing").collect()} == {1: None, 2: None, 3: None, 4: '{"a":1}'}
    assert {r.k: r.result for r in jsontree.map_pairs(pairs, "l", "r", ["k"], "merge").collect()} == {1: "{}", 2: "{}", 3: '{"a":1}', 4: '{"a":1}'}
    assert jsontree.merge_whole({"a": [1, 2], "b": {"c": 1}}, {"a": [3], "b": {"d": 2}}) == {"a": [3], "b": {"c": 1, "d": 2}}
    assert jsontree.strict_schema({"a": [{"b": 1}], "c": []})["properties"]["a"]["items"]["required"] == ["b"]
    assert jsontree.put_text({"choices": [{"message": {"content": "x"}}]}, "y")["choices"][0]["message"]["content"] == "y"
    assert jsontree.put_text({"output": [{"type": "message", "content": [{"type": "output_text", "text": "a"}, {"type": "output_text", "text": "b"}]}]}, "y")["output"][0]["content"][0]["text"] == "y"
    keys = spark.createDataFrame([("CN", "a"), ("CN", "b"), ("EN", "a"), ("EN", "c"), ("FR", "a"), ("FR", "b")], "prefix string, suffix string")
    assert [tuple(r) for r in jsontree.prefix_differences(keys, "CN").collect()] == [("EN", ["b"], ["c"])]
    assert jsontree.unflatten([(["a", "b"], 1), (["a"], 2)]) == {"a": 2}


def test_known_hashes_and_small_functions(spark):
    # fixed: published values of the hash
    assert markup.fast_hash("a") == f"{7929297801672961:x}" and markup.fast_hash("b") == f"{8684336938537663:x}"
    one = spark.range(1).select(tx.normalize_locale(F.lit("en_US.UTF-8")).alias("a"), tx.merge_pattern(F.lit("./x.txt")).alias("b"), tx.approximate_tokens(F.lit("中🙂a1 é")).alias("d"), tx.graphemes(F.lit("e\u0301👩\u200d👩")).alias("e")).first()
    assert tuple(one)[:2] == ("en-US", "**/x.txt")
    assert (one.d, one.e) == (7, 2)
    assert tx.delimiters("think", ("a", "b")) == ("<think>", "</think>") and tx.delimiters("[,]", ("a", "b")) == ("[", "]") and tx.delimiters(None, ("a", "b")) == ("a", "b")


def test_smaller_operators(spark):
    from weftline.operators import request, resume, segment, stats

    one = spark.range(1).select(
        segment.slices(F.lit("abcde"), 2).alias("a"), segment.slices(F.lit(""), 2).alias("b"), segment.chunk_size(F.lit(None), F.lit(None), F.lit(7), 9).alias("c"),
        request.overlay(F.lit('{"a":1,"b":{"c":2}}'), F.lit('{"b":{"d":3}}')).alias("d"), request.overlay(F.lit('{"a":1}'), F.lit(None).cast("string")).alias("e"),
        tx.match_locale(F.lit("fr-CA"), {"en-US": "en", "fr-FR": "fr"}).alias("f"), tx.match_locale(F.lit("xx"), {"en-US": "en"}).alias("g"), *(c.alias(k) for k, c in zip("hi", resume.with_defaults(F.lit("u"), F.lit("e"), F.lit(False), "U", "E"), strict=True)),
    ).first()
    assert one.a == ["ab", "cd", "e"] and one.b == [] and one.c == 7 and json.loads(one.d) == {"a": 1, "b": {"d": 3}} and json.loads(one.e) == {"a": 1}
    assert (one.f, one.g, one.h, one.i) == ("fr-FR", None, "U", "E")
    sums = spark.createDataFrame([(1_500_000, 1_500_000, 7, 0)], "cost_nano long, upstream_nano long, prompt_tokens long, total_tokens long")
    assert {r.name: r.shown for r in stats.shown_sums(sums).collect()} == {"upstream_nano": "0.001500", "prompt_tokens": "7"}
    pairs = spark.createDataFrame([(1, "a\n\nb", "a\nc"), (2, "a", "a\nb")], "k int, l string, r string")
    got = lambda force: sorted(map(tuple, resume.compare_texts(pairs, "k", "l", "r", force).collect()), key=str)
    assert got(False) == [(1, 0, "a", "a", None), (1, 1, "b", "c", None), (2, 0, None, None, "LINE_COUNT")]
    assert got(True)[-1] == (2, 1, "", "b", None)


def test_plans(spark):
    """Compiling requests shuffles nothing, token counts are read once, and a tree is scanned once."""
    from weftline.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for name in ("compile_fixed", "compile_regex", "split_parts", "avg_line_length"):
        assert "Exchange" not in plan(QUERIES[name][0](spark, sf)), name
    flat = plan(QUERIES["json_flatten"][0](spark, sf))
    assert "Exchange" not in flat and flat.count("FileScan") <= 2  # the second feeds what is nested too deep
    assert "documents.parquet" not in plan(QUERIES["token_outliers"][0](spark, sf))


def test_one_json_value(spark):
    """What follows a value makes a line malformed, whatever it is."""
    good = ['{"a":1}', "null", "1", '"s"', ' {"a":[1,2]} ', "[]"]
    bad = ['{"a":1} x', '{"a":1}}', '{"a":1},{', '{"a":1}],[', "1 2", '{"a":1}\n{"b":2}', "", " ", None, '{"a":1},5', "1,2"]
    rows = spark.createDataFrame([(t,) for t in good + bad], "t string").select("t", tx.parsed_json(F.col("t")).isNotNull().alias("ok")).collect()
    assert [r.t for r in rows if r.ok] == good
    line = spark.createDataFrame([('{"custom_id":"a","response":{"status_code":200,"body":{"choices":[{"text":"x"}]}}} junk',)], "line string")
    assert jsonl.parse_results(jsonl.read_lines(line)).first().error_code == "malformed"


@pytest.mark.parametrize("pieces, want", [
    (["a\n\nb"], [("a\n\n", False), ("b", False)]),
    (["say\n```py\nx\n\ny\n```\nend"], [("say\n", False), ("```py\nx\n\ny\n```\n", True), ("end", False)]),
    (["a\n\nb\n```\nx\n"], [("a\n\nb\n", False), ("```\nx\n", True)]),  # an opening fence comes first
    (["a\n\nb\n", "```\nx\n"], [("a\n\n", False), ("b\n", False), ("```\nx\n", True)]),
    (["a\n", None, " \n", "\nb"], [("a\n \n", False), ("\nb", False)]),
    (["```\n```\n", "z"], [("```\n```\n", True), ("z", False)]),
    (["", None], []),
])
def test_blocks(spark, tmp_path, pieces, want):
    rows = spark.createDataFrame([("r", i, p) for i, p in enumerate(pieces)], "request_id string, seq int, text string")
    got = blocks.fold_blocks(rows, "request_id", "seq", "text").orderBy("pos").collect()
    assert [(r.text, r.is_code) for r in got] == want and [r.pos for r in got] == list(range(len(want)))


def test_plain_lines_and_live_blocks(spark, tmp_path):
    assert blocks.cut("a\nb\nc", False, False) == ([("a\n", False), ("b\n", False)], "c", False)
    kind = "request_id string, seq int, text string"
    for part, rows in enumerate(([("r", 0, "a\n\nb\n"), ("q", 0, "x")], [("r", 1, "```\nc\n"), ("q", 1, None)], [("r", 2, "```\nd"), ("r", 3, None)])):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live = blocks.blocks_live(spark.readStream.schema(kind).parquet(str(tmp_path / "in")))
        q = live.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        try:
            assert q.awaitTermination(90), part
        finally:
            q.stop()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("request_id", "pos").collect()
    assert [tuple(r) for r in got] == [("q", 0, "x", False), ("r", 0, "a\n\n", False), ("r", 1, "b\n", False), ("r", 2, "```\nc\n```\n", True), ("r", 3, "d", False)]


def test_variants_and_prompts(spark):
    models = {"m": {"reasoningType": "reason_and_instruct", "reasoning": {"x": 1}, "instruct": {"x": 2}}, "n": {"reasoningType": "odd"}}
    assert options.pick_variant(models, "m", True) == {"x": 1} and options.pick_variant(models, "m", False) == {"x": 2}
    for name, code in (("none", "UNDEFINED_PARAM"), ("n", "INVALID_REASONING_TYPE")):
        with pytest.raises(ValueError, match=code):
            options.pick_variant(models, name, True)
    given = [(None, "sys", "ask", "", None), ("mine", "sys", None, "preset", None), (None, None, "a", "b", None), (None, None, None, None, "pre"), (None, None, " ", None, None)]
    rows = spark.createDataFrame(given, "g string, s string, p string, e string, f string").select(prompts.assemble_given(*map(F.col, "gspef")).alias("m")).select("m.*").collect()
    assert [tuple(r) for r in rows] == [("sys", "ask", None, None), ("mine", "preset", None, None), (None, "a", None, "MUTUALLY_EXCLUSIVE_INPUTS"), (None, None, "pre", None), (None, " ", None, "PROMPT_MISSING")]


def test_sent_body(spark):
    """A retry's temperature replaces a base one; without a base, settings send none."""
    cases = [('{"temperature":0.2,"seed":1}', "{}", 0.9, {"temperature": 0.9, "seed": 1}), ('{"seed":1}', "{}", 0.9, {"seed": 1}), ('{"seed":1}', '{"seed":4,"rpm":2}', None, {"seed": 4}),
             ('{"temperature":0.2,"grammar":"g"}', None, None, {"seed": 7}), ('{"temperature":0.2,"x":1}', None, 0.4, {"x": 1, "temperature": 0.4, "seed": 7})]
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, b string, m string, t double")
    sent = request.sent_body(F.col("b"), F.col("m"), F.col("t"), ("temperature", "seed"), {"seed": 7, "top_k": 1})
    assert [json.loads(r.j) for r in rows.select("i", sent.alias("j")).orderBy("i").collect()] == [c[3] for c in cases]
