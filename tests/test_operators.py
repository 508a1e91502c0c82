"""Operators on small cases: properties of chunks and trees, the ladder, streams."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import jsonl, jsontree, request, resume, run, segment
from weftline.sources.staging import fresh_path
from weftline.streaming import fold


def chunks(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column).first()[0]


@pytest.mark.parametrize("text", ["", "a", "a\nb\nc\nd\ne", "\n\n", "a\n\nb\n"])
def test_fixed_chunks_rejoin(spark, text):
    for n in (1, 2, 7):
        assert "\n".join(chunks(spark, segment.fixed_chunks(F.col("t"), n), text)) == text


@pytest.mark.parametrize("text", ["", "intro\n1. a\n22. b", "1. a", "no match"])
def test_pattern_chunks_rejoin(spark, text):
    got = chunks(spark, segment.pattern_chunks(F.col("t"), r"^\d+\."), text)
    assert "".join(got) == text
    assert "" not in got


def test_size_parts(spark):
    text = "aaaa\nbb\ncccccccccccc\nd"
    got = chunks(spark, segment.size_parts(F.col("t"), 8), text)
    assert got == ["aaaa\nbb\n", "cccccccccccc\n", "d"]
    assert "".join(got) == text


def test_bad_chunk_size():
    with pytest.raises(ValueError, match="INVALID_CHUNK_SIZE"):
        segment.fixed_chunks(F.lit("x"), 0)


def test_prompts(spark):
    say = lambda prompt, chunk: spark.range(1).select(request.user_content(F.lit(prompt), F.lit(chunk))).first()[0]
    assert say("Do:  \n", "\nx\r\n") == "Do:\n\nx"
    assert say("a {{ .TextToInject }} b", "x\n") == "a x b"
    assert say("", "x") == "x"


def test_result_lines(spark):
    ok, bad = spark.range(1).select(request.result_line(F.lit("r"), F.struct(F.lit(1).alias("a")), None), request.result_line(F.lit("r"), None, F.struct(F.lit("c").alias("code")))).first()
    assert json.loads(ok) == {"custom_id": "r", "response": {"status_code": 200, "request_id": "batch", "body": {"a": 1}}, "error": None}
    assert json.loads(bad) == {"custom_id": "r", "response": None, "error": {"code": "c"}}


def test_parse_request(spark):
    rows = ['{"custom_id":"a","body":{"x":1}}', '{"custom_id":"a","body":[1]}', '{"custom_id":"a","response":{},"body":{}}', '{"body":{}}', "nope", " ", '{"custom_id":"b","error":"e","body":{},"url":"/u"}']
    got = jsonl.parse_request(jsonl.read_lines(spark.createDataFrame([(r,) for r in rows], "line string"))).select("custom_id", "method", "url").collect()
    assert sorted(map(tuple, got)) == [("a", "POST", ""), ("b", "POST", "/u")]


def test_merge_retries(spark):
    row = "custom_id string, line_no long, line string, is_error boolean"
    old = spark.createDataFrame([("a", 0, "a0", True), ("b", 1, "b0", False), ("a", 2, "a2", False)], row)
    new = spark.createDataFrame([("a", 0, "A", True), ("a", 1, "A!", False), ("z", 2, "Z", False), ("b", 3, "B", True)], row)
    assert [r[0] for r in resume.merge_retries(old, new).orderBy("part", "ord").collect()] == ["A!", "b0", "A!", "Z"]


def test_trees():
    a, b = {"x": {"y": [1, {"z": 2}]}, "k": 1}, {"x": {"y": [5]}, "k": 2}
    missing = jsontree.find_missing(a, b)
    assert missing == {"x": {"y": {"1": {"z": 2}}}}
    merged = jsontree.deep_merge(b, missing)
    assert jsontree.find_missing(a, merged) is None
    assert merged == {"x": {"y": {"0": 5, "1": {"z": 2}}}, "k": 2}
    tree = {"a": {"b": "c" * 30}, "d": "e" * 30, "f": "g" * 90}
    parts = jsontree.split_tree(tree, 0.08)
    assert len(parts) == 3
    assert {k: v for p in parts for k, v in p.items()} == tree
    assert jsontree.split_tree({}) == []


@pytest.mark.parametrize(("outcome", "attempt", "fails", "want"), [
    (run.Outcome(), 1, 0, "ok"), (run.Outcome(403, message="Safety"), 1, 1, "fail"), (run.Outcome(403, message="no"), 1, 1, "abort"), (run.Outcome(429), 1, 1, "abort"), (run.Outcome(503), 1, 1, "abort"), (run.Outcome(402), 1, 1, "abort"),
    (run.Outcome(502), 1, 1, "retry"), (run.Outcome(502), 2, 2, "fail"), (run.Outcome(502), 1, 5, "abort"), (run.Outcome(code="TIMEOUT_ERROR"), 1, 1, "retry"),
])
def test_decide(outcome, attempt, fails, want):
    assert run.decide(outcome, attempt, fails, run.Limits()) == want


def test_waits():
    assert 3000 <= run.wait_ms(1, 5000, 500, 3) < 4100
    assert run.wait_ms(9, 5000, 0) == 60000
    assert run.wait_ms(2, 5000, 10) == 10010


def test_run_aborts_after_a_saved_batch(spark):
    rows = spark.createDataFrame([(i, f"request-{i}", str(i)) for i in range(1, 7)], "n long, custom_id string, line string")
    model = lambda line, attempt, t: run.Outcome(429) if line == "3" else run.Outcome(text=line)
    path = fresh_path(spark, "run")
    state = run.run_batches(rows, model, run.Limits(batch_size=2), path, 3)
    assert state == "aborted"
    saved = run.results_of(spark, path).collect()
    assert sorted((r.custom_id, r.decision) for r in saved) == [("request-1", "ok"), ("request-2", "ok"), ("request-3", "abort"), ("request-4", "cancelled")]


def test_events():
    assert fold.parse_events(": c\n\ndata: a\ndata: b\n\ndata: [DONE]\n\ndata: x") == (["a\nb"], "", True)
    assert fold.parse_events("data: a\n\ndata: b") == (["a"], "data: b", False)
    delta, done = '{"type":"response.output_text.delta","delta":"hi"}', '{"type":"response.output_text.done","text":"hi"}'
    assert fold.fold([delta, done])["text"] == "hi"
    assert fold.fold([done])["text"] == "hi"
    assert fold.fold(["{bad"])["error"] == "{bad"
    assert fold.fold(['{"type":"response.failed"}'])["error"]


def test_live_fold_agrees(spark, tmp_path):
    rows = [(f"r{k}", i, f'{{"choices":[{{"delta":{{"content":"{i} "}}}}]}}') for k in range(3) for i in range(4)] + [(f"r{k}", 9, "[DONE]") for k in range(3)]
    spark.createDataFrame(rows, "request_id string, seq int, data string").write.parquet(str(tmp_path / "in"))
    live = fold.fold_live(spark.readStream.schema("request_id string, seq int, data string").parquet(str(tmp_path / "in")), None)
    q = live.writeStream.format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
    assert sorted(map(tuple, spark.sql("select request_id, text from folded").collect())) == [(f"r{k}", "0 1 2 3 ") for k in range(3)]


def test_global_ids_over_sampled_ranges(spark):
    """Ranges come from a sample that differs from job to job; ids stay consecutive, in order, with nulls last."""
    rows = spark.range(0, 400_000, 1, 4).select(F.when(F.col("id") % 100_000 != 7, (F.col("id") * 7919) % 400_009).alias("k"))
    held, adaptive = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = request.global_ids(rows, ["k"], 5).toPandas().sort_values("n")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert got["n"].tolist() == list(range(5, 400_005))
    assert got["k"].iloc[:-4].is_monotonic_increasing and got["k"].iloc[-4:].isna().all()
    assert (got["custom_id"] == "request-" + got["n"].astype(str)).all()


def test_global_ids_of_no_rows(spark):
    assert request.global_ids(spark.range(0), ["id"]).count() == 0


def test_fixed_chunks_split_a_text_once(spark):
    """Chunks, nulls and blanks as before, with ids over them in order."""
    docs = spark.createDataFrame([(1, "a\nb\nc"), (2, None), (3, ""), (4, "\n \n\nd")], "doc_id long, text string")
    rows = segment.explode_chunks(docs, segment.fixed_chunks(F.col("text"), 2))
    assert sorted(map(tuple, rows.collect())) == [(1, 0, "a\nb"), (1, 1, "c"), (3, 0, ""), (4, 0, "\n "), (4, 1, "\nd")]
    plan = docs.select(segment.fixed_chunks(F.col("text"), 2).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 1
