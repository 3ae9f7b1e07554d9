import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillrun.functions import errors, ids, prompts, requests, responses, structured, tokens
from quillrun.operators.packing import chunk_numbers
from quillrun.plans import providers


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).coalesce(1).select(column).collect()]


def test_budgets():
    limits = tokens.EnqueueLimits(1000, 0.7, 50)
    assert limits.inflight_budget() == 700 == limits.batch_limit()
    assert tokens.EnqueueLimits(1000, 0.7, 50, 500).batch_limit() == 500
    assert tokens.EnqueueLimits().batch_limit() is None
    for bad in ({"target_ratio": 0}, {"headroom": -1}):
        with pytest.raises(ValueError):
            tokens.EnqueueLimits(**bad)


def test_claim_window_and_delays():
    assert [tokens.claim_window(n) for n in (0, 20, 50_000)] == [1, 100, 8192]
    policy = tokens.RetryPolicy(3, 1, 10)
    assert [policy.delay(n) for n in (0, 1, 2, 100)] == [0, 1, 2, 10]


@pytest.mark.parametrize(
    "rows, limits, wanted",
    [
        ([(1, 3), (1, 3), (1, 2)], (10, 20, 5), [0, 1, 1]),
        ([(1, 10), (1, 2)], (10, 100, 5), [0, 1]),
        ([(1, 1)] * 4, (2, 1000, None), [0, 0, 1, 1]),
        ([(11, 99), (1, 1)], (5, 10, 10), [0, 1]),
        ([(4, 4), (6, 6)], (5, 10, 10), [0, 0]),
    ],
)
def test_chunks(rows, limits, wanted):
    assert list(chunk_numbers(rows, *limits)) == wanted


def test_chunks_need_positive_sizes():
    with pytest.raises(ValueError):
        list(chunk_numbers([(0, 1)], 1, 1, 1))


@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 30)), max_size=60), st.integers(1, 5), st.integers(5, 40), st.integers(5, 40))
@settings(max_examples=200, deadline=None)
def test_chunks_against_a_loop(rows, most, size, total):
    want, open_ = [], []
    number = -1
    for b, t in rows:
        if open_ and (len(open_) == most or sum(x for x, _ in open_) + b > size or sum(y for _, y in open_) + t > total):
            open_ = []
        if not open_:
            number += 1
        want.append(number)
        open_ = [] if b > size or t > total else [*open_, (b, t)]
    assert list(chunk_numbers(rows, most, size, total)) == want


def test_estimates(spark):
    assert values(spark, ["", None, "abcd", "abcde"], tokens.estimate_tokens(F.col("x"))) == [0, 0, 1, 2]


ENQUEUE = ["enqueue token limit exceeded", "enqueued prompt token limit reached", "enqueued token exceeded limit", "enqueue exceeded token limit now"]


@pytest.mark.parametrize("shape", [errors.deep_fragments, errors.shallow_fragments])
def test_enqueue_limits(spark, shape):
    assert values(spark, [*ENQUEUE, "quota exceeded", None, ""], errors.is_enqueue_limit(shape(F.col("x")))) == [True] * 4 + [False] * 3


def test_classes(spark):
    said = ['{"status":429,"error":{"code":"insufficient_quota"}}', '{"code":429,"m":"Rate limit reached for requests per minute"}', "timeout talking to API", "boom", None]
    want = ["openai_insufficient_quota", "control_plane_transient", "control_plane_transient", "batch_error", "batch_error"]
    assert values(spark, said, errors.classify(errors.deep_fragments(F.col("x")))) == want


def test_known_short_ids(spark):
    known = ["b525575f3ea077094fb3f5f3de2fbab850d5b5db5", "b3dfa78c04a9678358e0ba53f3cf4b9723be1df2a"]
    assert values(spark, ["row1:a1", "row2:a1"], ids.short_id(F.col("x"))) == known


def test_schema_names_and_scopes():
    assert ids.schema_name("_ClassificationResult") == "classification_result"
    assert ids.quota_scope("m", "  ") == "openai:m:default" and ids.quota_scope("m", " a ") == "openai:m:label:a"


def test_templates(spark):
    df = spark.createDataFrame([("1", "a")], "id string, text string")
    assert prompts.with_prompt(df, template="{{{text}}} {id}").first().prompt == "{a} 1"
    with pytest.raises(ValueError):
        prompts.with_prompt(df, template="{text}", field="text")
    with pytest.raises(Exception, match="missing fields: title"):
        prompts.with_prompt(df, field="title").collect()


def test_lineage_of_the_caller_wins(spark):
    df = spark.createDataFrame([({"lineage": '{"source_ref":"mine"}', "a": "b"},), (None,)], "m map<string,string>")
    got = [r[0] for r in df.coalesce(1).select(prompts.with_lineage(F.col("m"), F.lit("ours"), F.lit(7))).collect()]
    assert got[0]["a"] == "b" and json.loads(got[0]["lineage"]) == {"source_ref": "mine", "source_item_index": "7"}
    assert json.loads(got[1]["lineage"])["source_ref"] == "ours"


def test_request_lines_keep_any_text(spark):
    odd = ['q"\\   \x85 \x01 \U0001f600', "", "\n\t"]
    for make in (requests.responses_line, requests.chat_line, requests.gemini_line, requests.anthropic_line):
        for line, text in zip(values(spark, odd, make(F.lit("1:a1"), F.col("x"))), odd):
            assert text in str(list(walk(json.loads(line)))) or text in list(walk(json.loads(line)))


def walk(x):
    if isinstance(x, dict):
        for v in x.values():
            yield from walk(v)
    elif isinstance(x, list):
        for v in x:
            yield from walk(v)
    else:
        yield x


def test_structured_request_and_replay(spark):
    schema = {"type": "object", "properties": {"a": {"type": "string"}}, "required": ["a"], "additionalProperties": False}
    line = values(spark, ["p"], requests.responses_line(F.lit("1:a1"), F.col("x"), output=requests.OutputSchema("n", schema), effort="low"))[0]
    body = json.loads(line)["body"]
    assert body["text"]["format"] == {"type": "json_schema", "name": "n", "strict": True, "schema": schema} and body["reasoning"] == {"effort": "low"}
    again = values(spark, [line], requests.with_correlation_id(F.col("x"), F.lit("1:a2"), provider="openai"))[0]
    assert json.loads(again) == json.loads(line) | {"custom_id": "1:a2"}


@pytest.mark.parametrize(
    "line, text",
    [
        ({"response": {"body": {"output": [{"content": [{"text": "hello"}]}, {"content": [{"text": "world"}]}]}}}, "hello\nworld"),
        ({"response": {"body": {"choices": [{"message": {"content": [{"text": "alpha"}, {"text": {"value": "beta"}}]}}]}}}, "alpha\nbeta"),
        ({"response": {"body": {}}}, ""),
        ({}, ""),
    ],
)
def test_openai_texts(spark, line, text):
    assert values(spark, [json.dumps(line)], responses.openai_text(F.parse_json("x"))) == [text]


def test_other_texts(spark):
    gemini = {"key": "k", "response": {"candidates": [{"content": {"parts": [{"text": "hello"}, {"text": ""}]}}, {"content": {"parts": [{"text": "world"}]}}]}}
    assert values(spark, [json.dumps(gemini)], responses.gemini_text(F.parse_json("x"))) == ["hello\nworld"]
    claude = {"custom_id": "b", "result": {"type": "succeeded", "message": {"content": [{"type": "text", "text": "a"}, {"type": "tool"}, {"type": "text", "text": ""}]}}}
    assert values(spark, [json.dumps(claude)], responses.anthropic_text(F.parse_json("x"))) == ["a\n"]


def test_last_line_wins_and_bad_lines_fail(spark):
    ok = lambda t: json.dumps({"custom_id": "1:a1", "response": {"status_code": 200, "body": {"output_text": t}}})
    rows = [("b", ok("old"), False, 1), ("b", ok("new"), False, 2), ("b", '{"custom_id":""}', False, 3), ("b", "  ", False, 4), ("b", ok("err"), True, 5), ("c", ok("other"), False, 1)]
    df = spark.createDataFrame(rows, "provider_batch_id string, value string, from_error_file boolean, line_number long")
    got = responses.split_outputs(responses.parse_lines(df), "openai")
    found = {(r.provider_batch_id, r.is_error): r.t for r in got.withColumn("t", responses.openai_text(F.col("record"))).collect()}
    assert found == {("b", False): "new", ("b", True): "err", ("c", False): "other"}
    with pytest.raises(Exception, match="not a JSON object"):
        responses.parse_lines(df.withColumn("value", F.lit("[1]"))).collect()


def test_fences(spark):
    texts = ["```json\n{}\n```", "```jSoN\n{}\n```", "```\n{}\n```", " {} ", "```json {}", None]
    assert values(spark, texts, structured.strip_fence(F.col("x"))) == ["{}", "{}", "{}", "{}", "```json {}", None]


def test_strict_schemas():
    closed = {"type": "object", "properties": {"a": {"type": "string"}}, "required": ["a"], "additionalProperties": False}
    structured.check_schema(closed)
    for bad in (
        {"type": "array"}, {"anyOf": [closed]}, {"type": "object", "properties": {}}, closed | {"required": []}, closed | {"properties": {"a": {"anyOf": []}}},
        closed | {"properties": {"a": {"type": "object"}}},
    ):
        with pytest.raises(ValueError):
            structured.check_schema(bad)
    assert structured.close_schema({"type": "object", "items": [{"type": "object"}]}) == {
        "type": "object", "items": [{"type": "object", "additionalProperties": False}], "additionalProperties": False,
    }


def test_validation(spark):
    schema = {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": ["array", "null"], "items": {"type": "boolean"}}}}
    texts = ['{"a":1,"b":[true]}', '{"a":"7","b":null}', '{"a":1.5,"b":null}', '{"a":1}', '{"a":1,"b":[1]}', "", "null", "{", None]
    wrong = "structured_output_validation_failed"
    want = [None, None, wrong, wrong, wrong, "empty_response_text", wrong, "invalid_json", "empty_response_text"]
    assert values(spark, texts, structured.validate(F.col("x"), schema)["error_class"]) == want


def test_input_modes():
    assert providers.gemini_input_mode("auto", 10) == "inline" and providers.gemini_input_mode("auto", providers.INLINE_BYTES) == "file"
    assert providers.gemini_input_mode("auto", 1, vertex=True, bucket="b") == "gcs"
    for bad in ({"mode": "inline", "size": providers.INLINE_BYTES}, {"mode": "gcs", "size": 1}, {"mode": "file", "size": 1, "vertex": True}, {"mode": "x", "size": 1}):
        with pytest.raises(ValueError):
            providers.gemini_input_mode(**bad)


def test_provider_payload_round_trip():
    c = providers.ProviderConfig("gemini", limits=tokens.EnqueueLimits(10))
    assert providers.ProviderConfig.from_payload(json.loads(json.dumps(c.payload()))) == c


def test_a_document_is_parsed_once_for_all_of_its_schema(spark):
    schema = {"type": "object", "properties": {"label": {"type": "string"}, "score": {"type": "number"}}, "required": ["label", "score"], "additionalProperties": False}
    texts = ['{"label":"a","score":1}', '{"label":1,"score":1}', '{"label":"a"}', "not json", "", "null"]
    checked = spark.createDataFrame([(x,) for x in texts], "x string").select(structured.validate(F.col("x"), schema).alias("r"))
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1
    bad = "structured_output_validation_failed"
    assert [r.r.error_class for r in checked.collect()] == [None, bad, bad, "invalid_json", "empty_response_text", bad]
