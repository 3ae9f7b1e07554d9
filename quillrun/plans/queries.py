"""The engine's queries over the test tables, and the same in SQL.

Items are documents in the order of their ids. ``LocalProvider``'s outcomes are a
function of a document's id and the round, so the SQL has them in closed form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, prompts, requests, structured, tokens
from ..functions.ordinals import dense_order
from ..functions.requests import OutputSchema
from ..operators import ordering, packing
from ..sources.files import CompositeSource, FrameSource, Part
from . import lifecycle_queries
from .query_data import DOCS, LABEL_SCHEMA, ROW_SCHEMA, documents, table

SPLIT_TOKENS = 400
SYSTEM = "Be brief."
PACK = {"max_requests": 50, "max_bytes": 200_000, "max_tokens": 20_000}
WINDOW = tokens.claim_window(PACK["max_requests"])


def _prompt() -> Column:
    return F.concat(F.lit("Summarize: "), F.col("text"))


def _cid() -> Column:
    return ids.custom_id(F.col("item_id"), F.lit(0))


def scan_items_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their metadata and lineage; a lineage key that the row gives wins."""
    d = documents(spark, sf_dir)
    given = F.create_map(F.lit("lang"), F.col("lang"), F.lit("lineage"), F.when(F.col("item_index") % 2 == 0, F.lit('{"source_ref":"mine"}')))
    meta = prompts.with_lineage(given, F.lit("documents"), F.col("item_index"), primary_key=F.col("doc_id"))
    line = lambda key: F.get_json_object(F.try_element_at("m", F.lit("lineage")), f"$.{key}")
    return d.withColumn("m", meta).select(
        "item_id", "item_index", F.try_element_at("m", F.lit("lang")).alias("lang"), line("source_ref").alias("source_ref"),
        line("source_item_index").cast("bigint").alias("source_item_index"), line("source_primary_key").alias("source_primary_key"),
    )


def resume_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a source has left after a checkpoint at row 100."""
    source = FrameSource(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "documents")
    return source.rows_from(source.checkpoint_after(99)).select("row_index", "doc_id", "lang")


def _parts(spark: SparkSession, sf_dir: str) -> list[Part]:
    def part(name: str, key: str, text: str) -> Part:
        df = table(spark, sf_dir, name).select(key, text)
        return Part(FrameSource(df, key, name), F.col(key).cast("string"), F.struct(F.col(text).alias("text")))

    return [part("documents", "doc_id", "text"), part("benchmark", "item_id", "text"), part("pages", "page_id", "url")]


def composite_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources one after another whose ids collide."""
    rows = CompositeSource(_parts(spark, sf_dir)).rows()
    return rows.select(
        F.col("source_index").cast("bigint").alias("source_index"), F.col("child_index").alias("row_index"), "item_id",
        F.try_element_at("metadata", F.lit("source_primary_key")).alias("source_primary_key"), F.length("payload.text").cast("bigint").alias("n_chars"),
    )


def prompt_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = prompts.with_prompt(documents(spark, sf_dir), field="text", system=SYSTEM)
    return d.select("item_id", "prompt", "system_prompt")


def prompt_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    d = prompts.with_prompt(orders, template="Order {o_orderkey} of {{customer}} {o_custkey}: {o_orderstatus}/{o_orderpriority}")
    return d.select(F.col("o_orderkey").cast("string").alias("item_id"), "prompt")


def required_field_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which needed fields rows lack, where every third text and fifth language is null."""
    d = documents(spark, sf_dir).withColumns(
        {"text": F.when(F.col("item_index") % 3 != 0, F.col("text")), "lang": F.when(F.col("item_index") % 5 != 0, F.col("lang"))}
    )
    lacks = prompts.missing_fields(["text", "lang", "title"], d.columns)
    return d.select("item_id", F.array_join(lacks, ",").alias("missing"))


def _line(kind: str, output: OutputSchema | None = None) -> Column:
    system = F.when(F.col("item_index") % 2 == 0, F.lit(SYSTEM)).otherwise(F.lit(""))
    make = {
        "responses": requests.responses_line, "chat": requests.chat_line, "anthropic": requests.anthropic_line, "gemini": requests.gemini_line,
    }[kind]
    return make(_cid(), _prompt(), system, output=output)


def _request_query(kind: str, output: OutputSchema | None = None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return documents(spark, sf_dir).select("item_id", _line(kind, output).alias("request_line"))

    return query


def request_line_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    line = requests.gemini_line(_cid(), _prompt(), None, vertex=True, config={"temperature": 0})
    return d.select("item_id", line.alias("request_line")).withColumn("correlation_id", requests.correlation_id(F.col("request_line"), provider="gemini"))


def request_line_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored request under its second attempt's id; the body is as it was."""
    d = documents(spark, sf_dir).withColumn("line", _line("responses"))
    again = requests.with_correlation_id(F.col("line"), ids.custom_id(F.col("item_id"), F.lit(1)), provider="openai")
    return d.select("item_id", again.alias("request_line"))


def gemini_inline_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    line = requests.gemini_line(_cid(), _prompt(), None, config={"temperature": 0})
    return d.select("item_id", requests.gemini_inline(line).alias("request_line"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("request_line")
    return documents(spark, sf_dir).select("item_id", "item_index", _cid().alias("custom_id"), requests.responses_line(_cid(), _prompt()).alias("request_line")).withColumns(
        {"request_sha256": requests.request_sha256(line), "request_bytes": requests.request_bytes(line), "submission_tokens": tokens.estimate_tokens(line)}
    )


def request_sha256_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir).select("item_id", "request_sha256", "request_bytes")


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    line = requests.responses_line(_cid(), _prompt())
    return d.select("item_id", tokens.estimate_tokens(F.col("text")).alias("text_tokens"), tokens.estimate_tokens(line).alias("request_tokens"))


def oversize_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests over the batch's token limit, with their failure, and those within."""
    within, over = tokens.split_oversized(_requests(spark, sf_dir), SPLIT_TOKENS)
    failure = tokens.oversized_failure(F.col("submission_tokens"), SPLIT_TOKENS)
    cols = ["item_id", "submission_tokens"]
    bad = over.select(*cols, F.lit(True).alias("oversized"), failure["error_class"].alias("error_class"), failure["raw_error"].alias("raw_error"))
    none = F.lit(None).cast("string")
    return within.select(*cols, F.lit(False).alias("oversized"), none.alias("error_class"), none.alias("raw_error")).union(bad)


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all requests that a batch can hold, those of each claim window packed on their own, in parallel."""
    within, _ = tokens.split_oversized(_requests(spark, sf_dir), PACK["max_tokens"])
    return packing.pack(within, **PACK, window=WINDOW)


def pack_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch plan: rendered, measured, packed."""
    columns = ["item_id", "item_index", "custom_id", "request_sha256", "request_bytes", "submission_tokens", "cycle", "batch_ordinal", "line_number"]
    return _packed(spark, sf_dir).select(*columns)


def pack_batches_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.batch_totals(_packed(spark, sf_dir))


def work_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the event log by ingest slice of 1,000."""
    e = dense_order(table(spark, sf_dir, "events").select("event_id"), "event_id", name="item_index")
    sliced = ordering.work_slices(e)
    return sliced.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


def strip_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fences of several kinds around short texts."""
    body = F.format_string('{"id":%d}', F.col("doc_id"))
    k = F.col("item_index") % 5
    wrapped = (
        F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 1, F.concat(F.lit("  ```JSON\n"), body, F.lit("```  ")))
        .when(k == 2, F.concat(F.lit("```\n"), body, F.lit("\n```\n"))).when(k == 3, F.concat(F.lit("```json "), body)).otherwise(F.concat(F.lit(" "), body))
    )
    return documents(spark, sf_dir).select("item_id", structured.strip_fence(wrapped).alias("stripped"))


def structured_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers built from labels against a schema: valid, of wrong types, broken, empty."""
    d = documents(spark, sf_dir)
    k = F.col("item_index") % 6
    answer = (
        F.when(k == 0, F.format_string('{"label":"l%d","score":0.5}', F.col("doc_id"))).when(k == 1, F.format_string('{"label":%d,"score":0.5}', F.col("doc_id")))
        .when(k == 2, "not json").when(k == 3, "").when(k == 4, F.format_string('```json\n{"label":"l%d","score":"%d"}\n```', F.col("doc_id"), F.col("doc_id")))
        .otherwise('{"label":"x"}')
    )
    checked = structured.validate(answer, LABEL_SCHEMA)
    return d.select("item_id", checked["error_class"].alias("error_class"), checked["output_json"].isNotNull().alias("valid"))


def conversation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat requests whose messages are a conversation's turns in order."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    said = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    item = F.col("conv_id").cast("string")
    line = requests.chat_line(ids.custom_id(item, F.lit(0)), F.lit(""), conversation=said)
    return turns.select(item.alias("item_id"), line.alias("request_line"))


QUERIES = {
    f.__name__: f
    for f in (
        scan_items_lineage, resume_suffix, composite_namespace, prompt_field, prompt_template, required_field_missing, request_line_vertex,
        request_line_replayed, gemini_inline_requests, request_sha256_bytes, token_estimates, oversize_split, pack_batches, pack_batches_summary,
        work_slices, strip_fence, structured_checks, conversation_prompts,
    )
} | {
    "request_line_responses": _request_query("responses"), "request_line_chat": _request_query("chat"),
    "request_line_anthropic": _request_query("anthropic"), "request_line_gemini": _request_query("gemini"),
    "request_line_structured": _request_query("responses", OutputSchema("row", ROW_SCHEMA)),
} | lifecycle_queries.QUERIES

_PROMPT = "to_json('Summarize: ' || text)"
_CID = "doc_id || ':a1'"
_EVEN = "item_index % 2 = 0"
_SHORT = f"'b' || substr(sha256({_CID}), 1, 40)"
_PLAIN = f"""'{{"custom_id":"' || {_CID} || '","method":"POST","url":"/v1/responses","body":{{"model":"m","input":' || {_PROMPT} || '}}}}'"""
_REQUESTS = f"""(SELECT item_id, item_index, {_CID} AS custom_id, line, sha256(line) AS request_sha256, strlen(line) + 1 AS request_bytes,
  ceil(length(line) / 4.0)::BIGINT AS submission_tokens FROM (SELECT *, {_PLAIN} AS line FROM {DOCS}))"""


def _responses_sql(tail: str = "", attempt: int = 1) -> str:
    return f"""SELECT item_id, '{{"custom_id":"' || doc_id || ':a{attempt}","method":"POST","url":"/v1/responses","body":{{"model":"m","input":' || {_PROMPT}
      || CASE WHEN {_EVEN} THEN ',"instructions":"{SYSTEM}"' ELSE '' END || '{tail}}}}}' AS request_line FROM {DOCS}"""


_PACKED = f"""WITH RECURSIVE r AS (SELECT *, item_index // {WINDOW} AS cycle, row_number() OVER (PARTITION BY item_index // {WINDOW} ORDER BY item_index) AS pos
  FROM {_REQUESTS} WHERE submission_tokens <= {PACK["max_tokens"]}),
p AS (
  SELECT cycle, pos, 1::BIGINT AS batch_ordinal, 1::BIGINT AS line_number, request_bytes AS b, submission_tokens AS t FROM r WHERE pos = 1
  UNION ALL
  SELECT r.cycle, r.pos,
    CASE WHEN line_number >= {PACK["max_requests"]} OR b + request_bytes > {PACK["max_bytes"]} OR t + submission_tokens > {PACK["max_tokens"]} THEN batch_ordinal + 1 ELSE batch_ordinal END,
    CASE WHEN line_number >= {PACK["max_requests"]} OR b + request_bytes > {PACK["max_bytes"]} OR t + submission_tokens > {PACK["max_tokens"]} THEN 1 ELSE line_number + 1 END,
    CASE WHEN line_number >= {PACK["max_requests"]} OR b + request_bytes > {PACK["max_bytes"]} OR t + submission_tokens > {PACK["max_tokens"]} THEN request_bytes ELSE b + request_bytes END,
    CASE WHEN line_number >= {PACK["max_requests"]} OR b + request_bytes > {PACK["max_bytes"]} OR t + submission_tokens > {PACK["max_tokens"]} THEN submission_tokens ELSE t + submission_tokens END
  FROM p JOIN r ON r.cycle = p.cycle AND r.pos = p.pos + 1)"""

ORACLES = {
    "scan_items_lineage": f"SELECT item_id, item_index, lang, CASE WHEN {_EVEN} THEN 'mine' ELSE 'documents' END AS source_ref, item_index AS source_item_index, item_id AS source_primary_key FROM {DOCS}",
    "resume_suffix": f"SELECT item_index AS row_index, doc_id, lang FROM {DOCS} WHERE item_index >= 100",
    "composite_namespace": "\nUNION ALL ".join(
        f"SELECT {i}::BIGINT AS source_index, row_number() OVER (ORDER BY {key}) - 1 AS row_index, 'src_' || substr(sha256('{i}' || chr(0) || 'dataframe' || chr(0) || '{name}'), 1, 12) || '__' || {key} AS item_id, {key}::VARCHAR AS source_primary_key, length({text})::BIGINT AS n_chars FROM {name}"
        for i, (name, key, text) in enumerate((("documents", "doc_id", "text"), ("benchmark", "item_id", "text"), ("pages", "page_id", "url")))
    ),
    "prompt_field": f"SELECT item_id, text AS prompt, '{SYSTEM}' AS system_prompt FROM {DOCS}",
    "prompt_template": "SELECT o_orderkey::VARCHAR AS item_id, 'Order ' || o_orderkey || ' of {customer} ' || o_custkey || ': ' || o_orderstatus || '/' || o_orderpriority AS prompt FROM orders",
    "required_field_missing": f"SELECT item_id, concat_ws(',', CASE WHEN item_index % 3 = 0 OR text IS NULL THEN 'text' END, CASE WHEN item_index % 5 = 0 OR lang IS NULL THEN 'lang' END, 'title') AS missing FROM {DOCS}",
    "request_line_responses": _responses_sql(),
    "request_line_structured": _responses_sql(
        ',"text":{"format":{"type":"json_schema","name":"row","strict":true,"schema":{"type":"object","properties":{"label":{"type":"string"}},"required":["label"],"additionalProperties":false}}}'
    ),
    "request_line_replayed": _responses_sql(attempt=2),
    "request_line_chat": f"""SELECT item_id, '{{"custom_id":"' || {_CID} || '","method":"POST","url":"/v1/chat/completions","body":{{"model":"m","messages":['
      || CASE WHEN {_EVEN} THEN '{{"role":"system","content":"{SYSTEM}"}},' ELSE '' END || '{{"role":"user","content":' || {_PROMPT} || '}}]}}}}' AS request_line FROM {DOCS}""",
    "request_line_anthropic": f"""SELECT item_id, '{{"custom_id":"' || {_SHORT} || '","body":{{"model":"m","max_tokens":1024,"messages":[{{"role":"user","content":' || {_PROMPT} || '}}]'
      || CASE WHEN {_EVEN} THEN ',"system":"{SYSTEM}"' ELSE '' END || '}}}}' AS request_line FROM {DOCS}""",
    "request_line_gemini": f"""SELECT item_id, '{{"key":"' || {_CID} || '","request":{{"contents":[{{"role":"user","parts":[{{"text":' || {_PROMPT} || '}}]}}]'
      || CASE WHEN {_EVEN} THEN ',"system_instruction":{{"parts":[{{"text":"{SYSTEM}"}}]}}' ELSE '' END || '}}}}' AS request_line FROM {DOCS}""",
    "request_line_vertex": f"""SELECT item_id, '{{"request":{{"contents":[{{"role":"user","parts":[{{"text":' || {_PROMPT} || '}}]}}],"generation_config":{{"temperature":0}},"labels":{{"{requests.LABEL}":"' || {_SHORT} || '"}}}}}}' AS request_line,
      {_SHORT} AS correlation_id FROM {DOCS}""",
    "gemini_inline_requests": f"""SELECT item_id, '{{"contents":[{{"role":"user","parts":[{{"text":' || {_PROMPT} || '}}]}}],"metadata":{{"key":"' || {_CID} || '"}},"config":{{"temperature":0}}}}' AS request_line FROM {DOCS}""",
    "request_sha256_bytes": f"SELECT item_id, request_sha256, request_bytes FROM {_REQUESTS}",
    "token_estimates": f"SELECT item_id, ceil(length(text) / 4.0)::BIGINT AS text_tokens, ceil(length({_PLAIN}) / 4.0)::BIGINT AS request_tokens FROM {DOCS}",
    "oversize_split": f"""SELECT item_id, submission_tokens, submission_tokens > {SPLIT_TOKENS} AS oversized, CASE WHEN submission_tokens > {SPLIT_TOKENS} THEN 'openai_request_exceeds_batch_token_limit' END AS error_class,
      CASE WHEN submission_tokens > {SPLIT_TOKENS} THEN '{{"submission_tokens":' || submission_tokens || ',"limit":{SPLIT_TOKENS},"limit_type":"batch"}}' END AS raw_error FROM {_REQUESTS}""",
    "pack_batches": f"{_PACKED} SELECT item_id, item_index, custom_id, request_sha256, request_bytes, submission_tokens, cycle, batch_ordinal, line_number FROM p JOIN r USING (cycle, pos)",
    "pack_batches_summary": f"""{_PACKED} SELECT cycle, batch_ordinal, count(*) AS requests, sum(request_bytes)::BIGINT AS bytes, sum(submission_tokens)::BIGINT AS tokens, min(item_index) AS first_index, max(item_index) AS last_index
      FROM p JOIN r USING (cycle, pos) GROUP BY cycle, batch_ordinal""",
    "work_slices": "SELECT (i // 1000)::BIGINT AS slice, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) GROUP BY 1",
    "strip_fence": f"""SELECT item_id, CASE WHEN item_index % 5 = 3 THEN '```json ' ELSE '' END || '{{"id":' || doc_id || '}}' AS stripped FROM {DOCS}""",
    "structured_checks": f"""SELECT item_id, CASE item_index % 6 WHEN 1 THEN 'structured_output_validation_failed' WHEN 5 THEN 'structured_output_validation_failed' WHEN 2 THEN 'invalid_json' WHEN 3 THEN 'empty_response_text' END AS error_class,
      item_index % 6 IN (0, 4) AS valid FROM {DOCS}""",
    "conversation_prompts": """SELECT conv_id::VARCHAR AS item_id, '{"custom_id":"' || conv_id || ':a1","method":"POST","url":"/v1/chat/completions","body":{"model":"m","messages":['
      || string_agg('{"role":' || to_json(role) || coalesce(',"content":' || to_json(text), '') || '}', ',' ORDER BY turn) || ']}}' AS request_line FROM conversations GROUP BY conv_id""",
} | lifecycle_queries.ORACLES
