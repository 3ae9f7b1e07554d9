"""Queries over what happens to items: outputs, outcomes, transitions, capacity, runs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import errors, ids, prompts, responses, tokens
from ..functions.requests import OutputSchema
from ..operators import ingest, ordering, outcomes, results, summary, transitions
from ..schemas import BATCHES, INTENTS, ITEMS, PENDING, SUBMITTED
from ..sources.files import FrameSource
from ..streaming.ingest import event_counts
from ..workspace import materialize, new_path, spread
from .ledger import ParquetLedger, latest
from .providers import LocalProvider, local_output
from .query_data import DOCS, LABEL_SCHEMA, documents, table
from .runner import Job, Runner

NOW = datetime(2024, 1, 1)
MAX_ATTEMPTS = 3
BATCH = 100


def _shaped(df: DataFrame, ddl: str, given: dict[str, Column]) -> DataFrame:
    return df.select(*((given[n] if n in given else F.lit(None)).cast(k).alias(n) for n, k in ingest._columns(ddl)))


def _items(df: DataFrame, **given: Column) -> DataFrame:
    base = {"run_id": F.lit("run"), "item_id": F.col("item_id"), "item_index": F.col("item_index"), "status": F.lit(PENDING), "attempt_count": F.lit(0)}
    return _shaped(df, ITEMS, base | given)


def _batch_id() -> Column:
    return F.concat(F.lit("b"), F.floor(F.col("item_index") / BATCH).cast("string"))


def _submitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as items submitted in batches of 100."""
    tokens_ = F.length("source") + 1
    return _items(
        documents(spark, sf_dir, "source"), status=F.lit(SUBMITTED), active_batch_id=_batch_id(),
        active_custom_id=ids.custom_id(F.col("item_id"), F.lit(0)), active_submission_tokens=tokens_,
    )


def _lines(items: DataFrame, round_: int, *, provider: str = "openai", structured: bool = False) -> DataFrame:
    """The provider's output lines for items submitted, written and read as a
    provider's files would be."""
    cid = F.col("active_custom_id")
    sent = ids.short_id(cid) if provider == "anthropic" else cid
    out = local_output(sent, F.col("item_id").cast("bigint"), F.lit(round_), structured=structured, provider=provider)
    lines = items.select(
        F.col("active_batch_id").alias("provider_batch_id"), out.alias("value"), F.lit(False).alias("from_error_file"), F.col("item_index").alias("line_number")
    ).where("value is not null")
    return materialize(spread(lines, "line_number"), "outputs")


def _split(items: DataFrame, round_: int = 1, **options) -> DataFrame:
    return responses.split_outputs(responses.parse_lines(_lines(items, round_, **options)), options.get("provider", "openai"))


def _parse(provider: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _split(_submitted(spark, sf_dir), provider=provider).select("provider_batch_id", "custom_id", "is_error")

    return query


def _extract(provider: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _split(_submitted(spark, sf_dir), provider=provider).where("not is_error")
        return found.select("custom_id", responses.extract_text(F.col("record"), provider).alias("text"))

    return query


def extract_text_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shapes a text may have in one answer, in the order that counts."""
    d = documents(spark, sf_dir, "source")
    i = F.col("doc_id").cast("string")
    s = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    k = F.col("item_index") % 6
    line = (
        F.when(k == 0, s('{"custom_id":"x","response":{"body":{"output":[{"content":"a', i, '"},{"content":[{"text":"b"},{"text":{"value":"c"}},"d"],"text":"e"}]}}}'))
        .when(k == 1, s('{"custom_id":"x","response":{"body":{"output_text":"t', i, '","choices":[{"message":{"content":"u"}}]}}}'))
        .when(k == 2, s('{"custom_id":"x","body":{"choices":[{"message":{"content":[{"text":"v', i, '"},{"text":""}]}}]}}'))
        .when(k == 3, s('{"custom_id":"x","response":{"body":{"output":["', i, '",7,null]}}}'))
        .when(k == 4, s('{"custom_id":"x","response":{"body":{"output":{"text":"', i, '"}}}}'))
        .otherwise(s('{"custom_id":"x","response":7,"body":{"output":[{"text":{"value":"w', i, '"}}]}}'))
    )
    return d.select("item_id", responses.openai_text(F.parse_json(line)).alias("text"))


def batch_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Providers' batch states, given to orders by their key, in the engine's words."""
    states = ["JOB_STATE_SUCCEEDED", "BATCH_STATE_FAILED", "JOB_STATE_CANCELLED", "BATCH_STATE_EXPIRED", "JOB_STATE_RUNNING", "JOB_STATE_PARTIALLY_SUCCEEDED"]
    raw = F.element_at(F.array(*map(F.lit, states)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    mine = F.when(F.col("o_orderkey") % 2 == 0, "ended").otherwise("canceling")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey"), responses.normal_status(raw, "gemini").alias("gemini"), responses.normal_status(mine, "anthropic").alias("anthropic"),
        responses.normal_status(F.col("o_orderstatus"), "openai").alias("openai"),
    )


ERRORS = [
    ('{"error":{"message":"Enqueued token limit reached for m"}}', "enqueue_token_limit"),
    ('{"a":["enqueue  TOKEN\\n limit exceeded"]}', "enqueue_token_limit"),
    ('{"status_code":429,"error":{"code":"insufficient_quota"}}', "openai_insufficient_quota"),
    ('{"status_code":"429","error":{"message":"You exceeded your current quota"}}', "openai_insufficient_quota"),
    ('{"status_code":429,"error":{"message":"Rate limit reached for requests per minute"}}', "control_plane_transient"),
    ("timeout talking to API", "control_plane_transient"),
    ("quota exceeded", "batch_error"),
    ("boom", "batch_error"),
    ('{"message":"the token","other":"limit of enqueue"}', "batch_error"),
]


def classify_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error documents of several shapes, one an event by its id."""
    said = F.element_at(F.array(*(F.lit(e) for e, _ in ERRORS)), (F.col("event_id") % len(ERRORS) + 1).cast("int"))
    e = table(spark, sf_dir, "events").select("event_id", said.alias("e"))
    return e.select("event_id", errors.classify(errors.deep_fragments(F.col("e"))).alias("error_class"))


def backoff_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("event_id") % 16 - 1).cast("int")
    return table(spark, sf_dir, "events").select("event_id", tokens.backoff_delay(n, 0.5, 300.0).alias("delay"))


def submitted_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of items still submitted: every third item has ended meanwhile."""
    items = _submitted(spark, sf_dir)
    now = items.withColumn("status", F.when(F.col("item_index") % 3 == 0, "completed").otherwise(F.col("status")))
    return outcomes.still_submitted(_split(items), now).select("custom_id", "is_error")


def missing_rows_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _submitted(spark, sf_dir)
    return outcomes.missing_rows(items, _split(items)).select("item_id", F.col("active_custom_id").alias("custom_id"))


def _outcomes(spark: SparkSession, sf_dir: str, structured: bool = False) -> DataFrame:
    items = _submitted(spark, sf_dir)
    return outcomes.classify_outcomes(items, _split(items, structured=structured), schema=LABEL_SCHEMA if structured else None)


def outcomes_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _outcomes(spark, sf_dir)
    return o.select("item_id", "custom_id", "outcome", "counts_attempt", F.col("error.error_class").alias("error_class"), "output_text")


def outcome_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.outcome_histogram(_outcomes(spark, sf_dir))


def structured_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _outcomes(spark, sf_dir, structured=True)
    return o.select("item_id", "outcome", F.col("error.error_class").alias("error_class"), F.get_json_object("output_json", "$.label").alias("label"))


def quota_errors_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.quota_errors(_outcomes(spark, sf_dir))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in all states by their index; a third of those open have used up attempts."""
    k = F.col("item_index") % 6
    status = F.element_at(F.array(*map(F.lit, ("pending", "queued_local", "submitted", "completed", "failed_retryable", "failed_permanent"))), (k + 1).cast("int"))
    seq = F.when(k.isin(3, 5), F.floor(F.col("item_index") / 6) * 2 + F.when(k == 3, 1).otherwise(2))
    live = k == 2
    return _items(
        documents(spark, sf_dir, "source"), status=status, attempt_count=(F.floor(F.col("item_index") / 6) % 4).cast("int"),
        active_batch_id=F.when(live, _batch_id()), active_custom_id=F.when(live, ids.custom_id(F.col("item_id"), F.lit(0))),
        active_submission_tokens=F.when(live, F.col("item_index") + 1), terminal_result_sequence=seq,
        request_artifact_path=F.when(k.isin(2, 3), F.concat(F.lit("requests/"), _batch_id())),
    )


def claim_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one cycle claims: the first items by index that are open and have attempts left."""
    claimed = transitions.claim(_mixed(spark, sf_dir), MAX_ATTEMPTS, tokens.claim_window(20))
    return claimed.select("item_id", "item_index", "status")


def _batches(items: DataFrame) -> DataFrame:
    """A batch for each hundred items; even ones have completed."""
    n = F.substring("active_batch_id", 2, 20).cast("bigint")
    made = items.where("active_batch_id is not null").select("active_batch_id", n.alias("n")).distinct()
    path = lambda kind: F.concat(F.lit(f"outputs/{kind}/"), "active_batch_id")
    return _shaped(
        made, BATCHES,
        {
            "run_id": F.lit("run"), "provider_batch_id": F.col("active_batch_id"), "local_batch_id": F.format_string("batch-%06d", "n"),
            "status": F.when(F.col("n") % 2 == 0, "completed").otherwise("submitted"), "output_artifact_path": F.when(F.col("n") % 2 == 0, path("output")),
            "error_artifact_path": F.when(F.col("n") % 4 == 0, path("error")),
        },
    )


def _intents(items: DataFrame) -> DataFrame:
    """An intent for every third batch; of these every second is released."""
    b = _batches(items).withColumn("n", F.substring("provider_batch_id", 2, 20).cast("bigint")).where("n % 3 = 0")
    scope = F.when(F.col("n") % 2 == 0, ids.quota_scope("m", "even")).otherwise(ids.quota_scope("m"))
    return _shaped(
        b, INTENTS,
        {
            "run_id": F.lit("run"), "intent_id": F.concat(F.lit("submission-"), "local_batch_id"), "quota_scope": scope, "status": F.lit("active"),
            "provider_batch_id": F.col("provider_batch_id"), "local_batch_id": F.col("local_batch_id"), "reserved_tokens": F.col("n") * 10 + 1,
            "released": F.col("n") % 6 == 0,
        },
    )


def submitted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the ids that batches were given, in their order, those still submitted."""
    items = _mixed(spark, sf_dir)
    sent = F.struct("item_index", ids.custom_id(F.col("item_id"), F.lit(0)).alias("c"))
    given = items.groupBy(_batch_id().alias("provider_batch_id")).agg(F.array_sort(F.collect_list(sent)).alias("s"))
    return summary.submitted_ids(given.withColumn("custom_ids", F.transform("s", lambda x: x["c"])), items)


def mark_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round 1's completions applied; delivered twice, they apply once."""
    items = _submitted(spark, sf_dir)
    ok = _outcomes(spark, sf_dir).where("outcome = 'completed'")
    done = transitions.complete(items, ok, 1, NOW)
    return done.select("item_id", "status", "attempt_count", "terminal_result_sequence", "output_text", F.col("active_batch_id").isNull().alias("idle"))


def mark_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round 1's failures applied to items on their last attempt."""
    items = _submitted(spark, sf_dir).withColumn("attempt_count", F.lit(2))
    bad = _outcomes(spark, sf_dir).where("outcome = 'failed'")
    failed = transitions.fail(items, bad, MAX_ATTEMPTS, 11, NOW)
    return failed.select("item_id", "status", "attempt_count", "terminal_result_sequence", F.col("error.error_class").alias("error_class"))


def batch_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch b1 has expired: its submitted items are pending again, attempts as they were."""
    raw = F.lit('{"id":"b1","status":"expired"}')
    failure = errors.batch_failure(errors.shallow_fragments(raw), raw, F.lit("expired"))
    reset = transitions.reset_batch(_mixed(spark, sf_dir), "b1", failure)
    return reset.select("item_id", "status", "attempt_count", F.col("error.error_class").alias("error_class"), F.col("active_batch_id").isNull().alias("idle"))


def cancel_nonterminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _mixed(spark, sf_dir)
    gone = transitions.cancel(items, summary.next_sequence(items), NOW)
    return gone.select("item_id", "status", "terminal_result_sequence", F.col("error.error_class").alias("error_class"))


def release_and_requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queued items whose ids are released, and all queued, by status before and after."""
    items = _mixed(spark, sf_dir)
    listed = items.where("item_index % 4 = 1").select("item_id")
    some = transitions.release(items, listed).groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("step", F.lit("release"))
    every = transitions.requeue(items).groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("step", F.lit("requeue"))
    return some.union(every).select("step", "status", "n")


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _mixed(spark, sf_dir)
    return summary.run_summary(items, _batches(items), _intents(items))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.status_counts(_mixed(spark, sf_dir))


def active_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where what was submitted has ended but in every fourth batch."""
    items = _mixed(spark, sf_dir)
    ended = (F.col("status") == "submitted") & (F.floor(F.col("item_index") / BATCH) % 4 != 0)
    left = items.withColumn("status", F.when(ended, "completed").otherwise(F.col("status")))
    return summary.active_batches(_batches(items), left, _intents(items)).select("provider_batch_id", "local_batch_id", "status")


def inflight_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.inflight_tokens(_mixed(spark, sf_dir))


def capacity_by_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens held by open intents, and by batches that no intent stands for."""
    items = _mixed(spark, sf_dir)
    runs = spark.createDataFrame([("run", ids.quota_scope("m"))], "run_id string, quota_scope string")
    return summary.reserved_tokens(items, runs, _intents(items))


def terminal_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions are numbered before failures, both by index."""
    o = _outcomes(spark, sf_dir)
    items = _submitted(spark, sf_dir).withColumn("attempt_count", F.lit(2))
    ok, bad = o.where("outcome = 'completed'"), o.where("outcome = 'failed'")
    first = transitions.complete(items, ok, 1, NOW)
    second = transitions.fail(items, bad, MAX_ATTEMPTS, 1 + ok.count(), NOW)
    return first.union(second).where("terminal_result_sequence is not null").select("item_id", "status", "terminal_result_sequence")


def terminal_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty ended items after number 20."""
    return ordering.terminal_page(_mixed(spark, sf_dir), 20, 50).select("item_id", "terminal_result_sequence")


def artifact_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _mixed(spark, sf_dir)
    return summary.artifact_inventory(items, _batches(items))


def ingest_replay_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replayed rows against those there: some new, some changed, some moved, some twice."""
    k = F.col("item_index") % 10
    given = {"payload_json": F.to_json(F.struct("lang")), "metadata_json": F.lit("{}")}
    d = documents(spark, sf_dir, "lang")
    there = _items(d.where(k != 1), **given)
    moved = _items(d, **(given | {"item_index": F.when(k == 3, F.col("item_index") + 1).otherwise(F.col("item_index")), "payload_json": F.when(k == 2, F.lit("{}")).otherwise(given["payload_json"])}))
    twice = moved.union(_items(d.where(k == 4), **given))
    return ingest.replay_guard(twice, there, replay_from=50).select("item_id", "action")


def ledger_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of the items, the later ones of some only."""
    items = _items(documents(spark, sf_dir, "source"))
    versions = None
    for v in range(3):
        part = items.where(F.col("item_index") % (v + 1) == 0).withColumns({"attempt_count": F.lit(v), "_version": F.lit(v).cast("bigint")})
        versions = part if versions is None else versions.union(part)
    return latest(versions, "items").select("item_id", "attempt_count")


def results_join_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with the labels of the rows they came from, by lineage."""
    d = documents(spark, sf_dir, "source")
    meta = F.to_json(prompts.with_lineage(None, F.lit("documents"), F.col("item_index"), primary_key=F.col("doc_id")))
    done = results.results(_items(d, status=F.lit("completed"), metadata_json=meta, output_text=F.concat(F.lit("answer "), "item_id")))
    joined = results.join_back(done, table(spark, sf_dir, "labels"), "doc_id")
    return joined.select("item_id", "output_text", "quality", "toxic")


def results_export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir, "lang")
    items = _items(d, status=F.lit("completed"), attempt_count=F.lit(1), output_text=F.concat(F.lit("answer "), "item_id"), metadata_json=F.to_json(F.struct("lang")))
    return results.export_lines(items)


def event_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_counts(table(spark, sf_dir, "events"))


def _simulate(spark: SparkSession, sf_dir: str, structured: bool) -> DataFrame:
    """Three rounds: claim all, submit, answer, consume. A round's state is a table."""
    items = materialize(_items(documents(spark, sf_dir, "source")), "round0")
    key = ("run_id", "item_id")
    for r in range(1, MAX_ATTEMPTS + 1):
        queued = transitions.claim(items, MAX_ATTEMPTS)
        subs = queued.select(
            "item_id", F.concat(F.lit(f"r{r}-"), _batch_id()).alias("provider_batch_id"),
            ids.custom_id(F.col("item_id"), F.col("attempt_count")).alias("custom_id"), F.lit(1).alias("submission_tokens"),
        )
        sent = materialize(transitions.submit(queued, subs), f"sent{r}")
        split = _split(sent, r, structured=structured)
        found = materialize(outcomes.classify_outcomes(sent, split, schema=LABEL_SCHEMA if structured else None), f"found{r}")
        ok, bad = found.where("outcome = 'completed'"), found.where("outcome = 'failed'")
        first = summary.next_sequence(items)
        done = transitions.complete(sent, ok, first, NOW)
        failed = transitions.fail(sent, bad, MAX_ATTEMPTS, first + ok.count(), NOW)
        changed = materialize(done.union(failed), f"changed{r}")
        items = materialize(items.join(changed.select(*key), list(key), "left_anti").select(*items.columns).union(changed), f"round{r}")
    return items


def retry_rounds_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = _simulate(spark, sf_dir, structured=False)
    return end.select("item_id", "status", "attempt_count", F.col("error.error_class").alias("error_class"), "output_text")


def retry_rounds_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = _simulate(spark, sf_dir, structured=True)
    return end.select("item_id", "status", "attempt_count", F.col("error.error_class").alias("error_class"), F.get_json_object("output_json", "$.label").alias("label"))


def run_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of all documents through the ledger, request files and local provider."""
    root = new_path(spark, "run")
    source = FrameSource(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "documents")
    job = Job(source, F.col("doc_id").cast("string"), F.struct("text"), field="text", output=OutputSchema("answer", LABEL_SCHEMA))
    clock = [0.0]

    def sleep(seconds: float) -> None:
        clock[0] += seconds

    runner = Runner(spark, ParquetLedger(spark, f"{root}/ledger"), LocalProvider(structured=True), root, clock=lambda: clock[0], sleep=sleep)
    run = runner.run_and_wait(job, "documents")
    return run.results().select("item_id", "item_index", "status", "attempt_count", F.col("error.error_class").alias("error_class"), F.col("output.label").alias("label"))


QUERIES = {
    f.__name__: f
    for f in (
        extract_text_shapes, batch_statuses, classify_errors, backoff_delay, submitted_semi_join, missing_rows_anti, outcomes_by_item, outcome_histogram,
        structured_validation, quota_errors_by_batch, claim_window, submitted_ids, mark_completed, mark_failed, batch_reset, cancel_nonterminal, release_and_requeue,
        run_summary, status_counts, active_batches, inflight_tokens, capacity_by_scope, terminal_sequence, terminal_page, artifact_inventory,
        ingest_replay_guard, ledger_latest_version, results_join_back, results_export_lines, event_stream_counts, retry_rounds_final,
        retry_rounds_structured, run_end_to_end,
    )
} | {f"parse_{p}_outputs": _parse(p) for p in responses.PROVIDERS} | {f"extract_text_{p}": _extract(p) for p in responses.PROVIDERS}

_K = "doc_id % 20"
_R1_ERROR = f"{_K} IN (5, 7, 11, 17)"
_CID = "doc_id || ':a1'"
_SHORT = f"'b' || substr(sha256({_CID}), 1, 40)"
_BATCH_SQL = f"'b' || item_index // {BATCH}"
_CLASS1 = f"""CASE {_K} WHEN 3 THEN 'batch_output_missing_row' WHEN 7 THEN 'openai_insufficient_quota' WHEN 11 THEN 'enqueue_token_limit'
  WHEN 5 THEN 'provider_item_error' WHEN 17 THEN 'provider_item_error' END"""
_MIXED = f"""(SELECT *, item_index % 6 AS k, (item_index // 6) % 4 AS attempt_count, {_BATCH_SQL} AS batch,
  CASE item_index % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'queued_local' WHEN 2 THEN 'submitted' WHEN 3 THEN 'completed' WHEN 4 THEN 'failed_retryable' ELSE 'failed_permanent' END AS status,
  CASE WHEN item_index % 6 = 3 THEN (item_index // 6) * 2 + 1 WHEN item_index % 6 = 5 THEN (item_index // 6) * 2 + 2 END AS seq FROM {DOCS})"""
_BATCHES_SQL = f"""(SELECT batch, item_index // {BATCH} AS n, min(printf('batch-%06d', (item_index // {BATCH})::INT)) AS local_batch_id,
  CASE WHEN n % 2 = 0 THEN 'completed' ELSE 'submitted' END AS status FROM {_MIXED} WHERE k = 2 GROUP BY 1, 2)"""
_FINAL = f"""CASE WHEN {_K} = 5 THEN 3 WHEN {_K} = 17 THEN 2 ELSE 1 END"""


def _final_structured(columns: str) -> str:
    return f"""SELECT {columns}, CASE WHEN {_K} IN (5, 13) THEN 'failed_permanent' ELSE 'completed' END AS status,
      CASE WHEN {_K} IN (5, 13) THEN 3 WHEN {_K} = 17 THEN 2 ELSE 1 END::INT AS attempt_count, CASE {_K} WHEN 5 THEN 'provider_item_error' WHEN 13 THEN 'invalid_json' END AS error_class,
      CASE WHEN {_K} NOT IN (5, 13) THEN 'l' || doc_id END AS label FROM {DOCS}"""


def _parse_sql(cid: str) -> str:
    return f"SELECT {_BATCH_SQL} AS provider_batch_id, {cid} AS custom_id, {_R1_ERROR} AS is_error FROM {DOCS} WHERE {_K} <> 3"


def _extract_sql(cid: str) -> str:
    return f"SELECT {cid} AS custom_id, 'answer ' || doc_id AS text FROM {DOCS} WHERE {_K} <> 3 AND NOT {_R1_ERROR}"


_ERROR_CASES = " ".join(f"WHEN {i} THEN '{c}'" for i, (_, c) in enumerate(ERRORS))

ORACLES = {
    "parse_openai_outputs": _parse_sql(_CID), "parse_anthropic_outputs": _parse_sql(_SHORT), "parse_gemini_outputs": _parse_sql(_CID),
    "extract_text_openai": _extract_sql(_CID), "extract_text_anthropic": _extract_sql(_SHORT), "extract_text_gemini": _extract_sql(_CID),
    "extract_text_shapes": f"""SELECT item_id, CASE item_index % 6 WHEN 0 THEN 'a' || doc_id || chr(10) || 'b' || chr(10) || 'c' || chr(10) || 'd' || chr(10) || 'e'
      WHEN 1 THEN 't' || doc_id || chr(10) || 'u' WHEN 2 THEN 'v' || doc_id WHEN 3 THEN '' WHEN 4 THEN '' ELSE 'w' || doc_id END AS text FROM {DOCS}""",
    "batch_statuses": """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'cancelled' WHEN 3 THEN 'expired' WHEN 4 THEN 'submitted' ELSE 'completed' END AS gemini,
      CASE WHEN o_orderkey % 2 = 0 THEN 'completed' ELSE 'in_progress' END AS anthropic, o_orderstatus AS openai FROM orders""",
    "classify_errors": f"SELECT event_id, CASE event_id % {len(ERRORS)} {_ERROR_CASES} END AS error_class FROM events",
    "backoff_delay": "SELECT event_id, CASE WHEN event_id % 16 - 1 > 0 THEN least(0.5::DOUBLE * pow(2, least(event_id % 16 - 2, 10)), 300) ELSE 0 END::DOUBLE AS delay FROM events",
    "submitted_semi_join": f"SELECT {_CID} AS custom_id, {_R1_ERROR} AS is_error FROM {DOCS} WHERE {_K} <> 3 AND item_index % 3 <> 0",
    "missing_rows_anti": f"SELECT item_id, {_CID} AS custom_id FROM {DOCS} WHERE {_K} = 3",
    "outcomes_by_item": f"""SELECT item_id, {_CID} AS custom_id, CASE WHEN e IS NULL THEN 'completed' ELSE 'failed' END AS outcome, e IS NULL OR e = 'provider_item_error' AS counts_attempt, e AS error_class,
      CASE WHEN e IS NULL THEN 'answer ' || doc_id END AS output_text FROM (SELECT *, {_CLASS1} AS e FROM {DOCS})""",
    "outcome_histogram": f"SELECT CASE WHEN e IS NULL THEN 'completed' ELSE 'failed' END AS outcome, coalesce(e, '') AS error_class, count(*) AS n FROM (SELECT {_CLASS1} AS e FROM {DOCS}) GROUP BY 1, 2",
    "structured_validation": f"""SELECT item_id, CASE WHEN e IS NULL THEN 'completed' ELSE 'failed' END AS outcome, e AS error_class, CASE WHEN e IS NULL THEN 'l' || doc_id END AS label
      FROM (SELECT *, coalesce({_CLASS1}, CASE WHEN {_K} = 13 THEN 'invalid_json' END) AS e FROM {DOCS})""",
    "quota_errors_by_batch": f"SELECT {_BATCH_SQL} AS provider_batch_id, count(*) FILTER ({_K} = 7) AS quota_errors FROM {DOCS} GROUP BY 1",
    "claim_window": f"SELECT item_id, item_index, 'queued_local' AS status FROM {_MIXED} WHERE k IN (0, 4) AND attempt_count < {MAX_ATTEMPTS} ORDER BY item_index LIMIT 100",
    "submitted_ids": f"SELECT (item_index % {BATCH})::INT AS pos, {_CID} AS custom_id FROM {_MIXED} WHERE k = 2",
    "mark_completed": f"""SELECT item_id, 'completed' AS status, 1::INT AS attempt_count, row_number() OVER (ORDER BY item_index) AS terminal_result_sequence, 'answer ' || doc_id AS output_text, true AS idle
      FROM {DOCS} WHERE {_CLASS1} IS NULL""",
    "mark_failed": f"""SELECT item_id, CASE WHEN p THEN 'failed_permanent' ELSE 'failed_retryable' END AS status, CASE WHEN p THEN 3 ELSE 2 END::INT AS attempt_count,
      CASE WHEN p THEN 10 + row_number() OVER (PARTITION BY p ORDER BY item_index) END AS terminal_result_sequence, e AS error_class
      FROM (SELECT *, {_CLASS1} AS e, {_CLASS1} = 'provider_item_error' AS p FROM {DOCS}) WHERE e IS NOT NULL""",
    "batch_reset": f"SELECT item_id, 'pending' AS status, attempt_count::INT AS attempt_count, 'batch_terminal_expired' AS error_class, true AS idle FROM {_MIXED} WHERE k = 2 AND batch = 'b1'",
    "cancel_nonterminal": f"""SELECT item_id, 'failed_permanent' AS status, (SELECT max(seq) FROM {_MIXED}) + row_number() OVER (ORDER BY item_index) AS terminal_result_sequence, 'run_cancelled' AS error_class
      FROM {_MIXED} WHERE k IN (0, 1, 4)""",
    "release_and_requeue": f"""SELECT 'release' AS step, 'pending' AS status, count(*) AS n FROM {_MIXED} WHERE k = 1 AND item_index % 4 = 1
      UNION ALL SELECT 'requeue', 'pending', count(*) FROM {_MIXED} WHERE k = 1""",
    "run_summary": f"""SELECT count(*) AS total_items, count(*) FILTER (k = 3) AS completed_items, count(*) FILTER (k = 5) AS failed_items,
      (SELECT count(*) FROM {_BATCHES_SQL}) AS active_batches, 'running' AS status FROM {_MIXED}""",
    "status_counts": f"SELECT status, count(*) AS n FROM {_MIXED} GROUP BY status",
    "active_batches": f"""SELECT batch AS provider_batch_id, local_batch_id, status FROM {_BATCHES_SQL} b WHERE status = 'submitted'
      OR EXISTS (SELECT 1 FROM {_MIXED} m WHERE m.k = 2 AND m.batch = b.batch AND (m.item_index // {BATCH}) % 4 = 0) OR (n % 3 = 0 AND n % 6 <> 0)""",
    "inflight_tokens": f"SELECT coalesce(sum(item_index + 1), 0)::BIGINT AS tokens FROM {_MIXED} WHERE k = 2",
    "capacity_by_scope": f"""SELECT quota_scope, sum(tokens)::BIGINT AS tokens FROM (
      SELECT CASE WHEN n % 2 = 0 THEN 'openai:m:label:even' ELSE 'openai:m:default' END AS quota_scope, n * 10 + 1 AS tokens FROM {_BATCHES_SQL} WHERE n % 3 = 0 AND n % 6 <> 0
      UNION ALL SELECT 'openai:m:default', item_index + 1 FROM {_MIXED} WHERE k = 2 AND (item_index // {BATCH}) % 3 <> 0) GROUP BY 1""",
    "terminal_sequence": f"""SELECT item_id, CASE WHEN {_CLASS1} IS NULL THEN 'completed' ELSE 'failed_permanent' END AS status,
      row_number() OVER (ORDER BY {_CLASS1} IS NOT NULL, item_index) AS terminal_result_sequence FROM {DOCS} WHERE {_CLASS1} IS NULL OR {_CLASS1} = 'provider_item_error'""",
    "terminal_page": f"SELECT item_id, seq AS terminal_result_sequence FROM {_MIXED} WHERE seq > 20 ORDER BY seq LIMIT 50",
    "artifact_inventory": f"""SELECT DISTINCT 'request' AS kind, 'requests/' || batch AS path FROM {_MIXED} WHERE k IN (2, 3)
      UNION ALL SELECT 'output', 'outputs/output/' || batch FROM {_BATCHES_SQL} WHERE n % 2 = 0 UNION ALL SELECT 'error', 'outputs/error/' || batch FROM {_BATCHES_SQL} WHERE n % 4 = 0""",
    "ingest_replay_guard": f"""SELECT item_id, CASE WHEN k IN (2, 3, 4) THEN 'duplicate' WHEN k = 1 THEN 'insert' WHEN item_index >= 50 THEN 'skip' ELSE 'duplicate' END AS action
      FROM (SELECT item_id, item_index, item_index % 10 AS k FROM {DOCS} UNION ALL SELECT item_id, item_index, item_index % 10 FROM {DOCS} WHERE item_index % 10 = 4)""",
    "ledger_latest_version": f"SELECT item_id, CASE WHEN item_index % 3 = 0 THEN 2 WHEN item_index % 2 = 0 THEN 1 ELSE 0 END::INT AS attempt_count FROM {DOCS}",
    "results_join_back": "SELECT doc_id::VARCHAR AS item_id, 'answer ' || doc_id AS output_text, quality, toxic FROM labels JOIN documents USING (doc_id)",
    "results_export_lines": f"""SELECT item_index, '{{"item_id":"' || doc_id || '","status":"completed","attempt_count":1,"output_text":"answer ' || doc_id || '","error":null,"metadata":{{"lang":"' || lang || '"}},"raw_response":null}}' AS value FROM {DOCS}""",
    "event_stream_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "retry_rounds_final": f"""SELECT item_id, CASE WHEN {_K} = 5 THEN 'failed_permanent' ELSE 'completed' END AS status, {_FINAL}::INT AS attempt_count,
      CASE WHEN {_K} = 5 THEN 'provider_item_error' END AS error_class, CASE WHEN {_K} <> 5 THEN 'answer ' || doc_id END AS output_text FROM {DOCS}""",
    "retry_rounds_structured": _final_structured("item_id"),
    "run_end_to_end": _final_structured("item_id, item_index"),
}


