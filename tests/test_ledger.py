from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillrun.operators import ingest, outcomes, summary, transitions
from quillrun.plans.ledger import CommitConflict, MemoryLedger, ParquetLedger, RunState, backfill_markers, open_ledger

NOW = datetime(2024, 1, 1)


@pytest.fixture(params=["parquet", "memory"])
def ledger(request, spark, tmp_path):
    return open_ledger(request.param, spark, **({"root": f"file://{tmp_path}/ledger"} if request.param == "parquet" else {}))


def items(spark, n=3, first=0):
    rows = [(f"row{i}", i, (f"t{i}",), {"source": "a"}, f"prompt {i}", None) for i in range(first, first + n)]
    df = spark.createDataFrame(rows, "item_id string, item_index long, payload struct<text:string>, metadata map<string,string>, prompt string, system_prompt string")
    return ingest.pending_items(df, "r")


def apply(ledger, delta):
    ledger.commit("r", {"items": delta}, ledger.state("r"))
    return ledger.current("r", "items")


def states(df):
    return {r.item_id: (r.status, r.attempt_count) for r in df.collect()}


def submitted(spark, ledger):
    ledger.create_run(RunState("r"), items(spark))
    now = apply(ledger, transitions.claim(ledger.current("r", "items"), 3, 10))
    subs = now.select("item_id", F.lit("b").alias("provider_batch_id"), F.concat("item_id", F.lit(":a1")).alias("custom_id"), F.lit(5).alias("submission_tokens"))
    return apply(ledger, transitions.submit(now, subs))


def failures(spark, *ids, counts=True, retryable=True):
    rows = [(f"{i}:a1", "b", ("boom", "m", retryable, None), counts) for i in ids]
    return spark.createDataFrame(rows, "custom_id string, provider_batch_id string, error struct<error_class:string,message:string,retryable:boolean,raw_error:string>, counts_attempt boolean")


def test_create_and_replay(spark, ledger):
    ledger.create_run(RunState("r", next_index=3), items(spark))
    assert ledger.has_run("r") and not ledger.has_run("s") and ledger.runs() == ["r"]
    with pytest.raises(ValueError):
        ledger.create_run(RunState("r"))
    there = ledger.current("r", "items")
    assert ingest.to_insert(items(spark, 3), there, replay_from=0).count() == 0
    assert [r.item_id for r in ingest.to_insert(items(spark, 2, 2), there, replay_from=2).collect()] == ["row3"]
    with pytest.raises(Exception, match="duplicate item_id"):
        ingest.to_insert(items(spark, 1, 1), there, replay_from=2).collect()


def test_life_of_items(spark, ledger):
    now = submitted(spark, ledger)
    assert summary.inflight_tokens(now).first().tokens == 15
    done = spark.createDataFrame([("row0:a1", "b", "out", None, "{}"), ("row1:a1", "other", "x", None, "{}")], "custom_id string, provider_batch_id string, output_text string, output_json string, raw_response_json string")
    one = transitions.complete(now, done, 1, NOW)
    now = apply(ledger, one)
    now = apply(ledger, transitions.fail(now, failures(spark, "row1"), 1, summary.next_sequence(now), NOW))
    now = apply(ledger, transitions.fail(now, failures(spark, "row2", counts=False), 1, summary.next_sequence(now), NOW))
    assert states(now) == {"row0": ("completed", 1), "row1": ("failed_permanent", 1), "row2": ("failed_retryable", 0)}
    assert {r.item_id: r.terminal_result_sequence for r in now.collect()} == {"row0": 1, "row1": 2, "row2": None}
    # The same outcomes delivered again do nothing.
    assert transitions.complete(now, done, 9, NOW).count() == 0
    assert transitions.fail(now, failures(spark, "row1", "row2"), 1, 9, NOW).count() == 0


def test_permanent_and_cancelled(spark, ledger):
    now = submitted(spark, ledger)
    now = apply(ledger, transitions.fail(now, failures(spark, "row0", retryable=False), 3, 1, NOW))
    now = apply(ledger, transitions.reset_batch(now, "b", F.lit(None)).where("item_id = 'row1'"))
    assert states(now) == {"row0": ("failed_permanent", 1), "row1": ("pending", 0), "row2": ("submitted", 0)}
    now = apply(ledger, transitions.cancel(now, 2, NOW))
    assert states(now) == {"row0": ("failed_permanent", 1), "row1": ("failed_permanent", 0), "row2": ("submitted", 0)}


def test_requests_shed_prompts_and_release(spark, ledger):
    ledger.create_run(RunState("r"), items(spark))
    now = apply(ledger, transitions.claim(ledger.current("r", "items"), 3, 2))
    pointers = spark.createDataFrame([("row0", "p", 1, "s")], "item_id string, path string, line int, sha256 string")
    now = apply(ledger, transitions.record_requests(now, pointers))
    first = now.where("item_id = 'row0'").first()
    assert (first.prompt, first.payload_json, first.request_artifact_path) == ("", None, "p")
    now = apply(ledger, transitions.release(now, spark.createDataFrame([("row0",), ("row2",)], "item_id string")))
    assert states(now) == {"row0": ("pending", 0), "row1": ("queued_local", 0), "row2": ("pending", 0)}
    assert transitions.requeue(now).count() == 1
    assert transitions.clear_request_pointers(now, ["p"]).first().request_artifact_path is None


def test_summary_of_an_empty_run(spark, ledger):
    ledger.create_run(RunState("r"), items(spark, 0))
    args = [ledger.current("r", t) for t in ("items", "batches", "intents")]
    assert summary.run_summary(*args).first().status == "completed"
    assert summary.run_summary(*args, ingested=False).first().status == "running"
    assert summary.run_summary(*args, backoff=1).first().status == "running"


def test_backoff_state():
    s = RunState("r")
    for now, n, delay in ((0, 1, 1), (0.5, 2, 2), (10, 1, 1)):
        s.failed(now, lambda k: float(2 ** (k - 1)))
        assert (s.failures, s.last_delay) == (n, delay)
    assert s.backoff(10.5) == 0.5 and s.total_failures == 3
    s.clear_backoff()
    assert s.backoff(0) == 0 and s.total_failures == 3


def test_what_no_manifest_names_is_not_there(spark, tmp_path):
    ledger = ParquetLedger(spark, f"file://{tmp_path}/l")
    ledger.create_run(RunState("r"), items(spark))
    ledger._write("r", "items", 1, transitions.claim(ledger.current("r", "items"), 3, 10))  # a crash before the manifest
    assert {s for s, _ in states(ledger.current("r", "items")).values()} == {"pending"}
    apply(ledger, transitions.claim(ledger.current("r", "items"), 3, 1))
    with pytest.raises(CommitConflict):
        ledger.commit("r", {}, ledger.state("r"), expected=1)
    with pytest.raises(CommitConflict):
        ledger._create("r", 1, {}, ledger.state("r"))
    assert states(ledger.current("r", "items", 0))["row0"] == ("pending", 0)
    before = states(ledger.current("r", "items"))
    ledger.compact("r")
    assert len(ledger.manifest("r")["tables"]["items"]) == 1 and ledger.vacuum("r") == 3
    assert states(ledger.current("r", "items")) == before
    with pytest.raises(ValueError):
        ledger.files.path("../x")
    with pytest.raises(KeyError):
        ledger.state("none")


def test_memory_ledger_conflicts(spark):
    ledger = MemoryLedger(spark)
    ledger.create_run(RunState("r"), items(spark))
    with pytest.raises(CommitConflict):
        ledger.commit("r", {}, RunState("r"), expected=0)
    with pytest.raises(ValueError):
        open_ledger("none", spark)


def test_markers(spark):
    one = lambda *r: spark.createDataFrame([(x,) for x in r], "run_id string")
    got = backfill_markers(one("a", "b", "c"), one("b"), one("a", "a", "b")).collect()
    assert {(r.run_id, r.next_index, r.ingested) for r in got} == {("a", 2, False), ("c", 0, False)}  # none is known to have read its whole source


def test_a_file_is_there_whole_or_not_at_all(spark, tmp_path):
    files = ParquetLedger(spark, f"file://{tmp_path}/l").files
    files.create("r/_commits/00000000.json", "{}")
    with pytest.raises(FileExistsError):
        files.create("r/_commits/00000000.json", "[]")
    assert files.read("r/_commits/00000000.json") == "{}" and [n for n in files.names("r/_commits") if not n.startswith(".")] == ["00000000.json"]


def test_reservations_of_two_runs(ledger):
    assert ledger.capacity("q") == (-1, [])
    ledger.reserve("q", 0, [["a", "b1", 5]])
    with pytest.raises(CommitConflict):
        ledger.reserve("q", 0, [["b", "b1", 5]])
    ledger.reserve("q", 1, [["a", "b1", 5], ["b", "b1", 5]])
    assert ledger.capacity("q") == (1, [["a", "b1", 5], ["b", "b1", 5]]) and ledger.capacity("other") == (-1, [])


def test_deltas_are_folded(spark, tmp_path):
    ledger = ParquetLedger(spark, f"file://{tmp_path}/l")
    ledger.DELTAS = 2
    ledger.create_run(RunState("r"), items(spark))
    for _ in range(2):
        apply(ledger, transitions.claim(ledger.current("r", "items"), 3, 1))
        ledger.tidy("r")
    before = states(ledger.current("r", "items"))
    assert len(ledger.manifest("r")["tables"]["items"]) == 1 and sorted(s for s, _ in before.values()) == ["pending", "queued_local", "queued_local"]


def test_claiming_all_and_classifying_are_not_left_to_one_task(spark):
    """A limit, or a table of few bytes, would bring all items to one or two tasks."""
    df = items(spark, 40).coalesce(1)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    everything = transitions.claim(df, 3)
    assert everything.count() == 40 and "Limit" not in plan(everything) and "TakeOrdered" not in plan(everything)
    outputs = spark.createDataFrame([], "provider_batch_id string, custom_id string, is_error boolean, value string")
    found = outcomes.classify_outcomes(everything.withColumns({"status": F.lit("submitted"), "active_custom_id": F.col("item_id"), "active_batch_id": F.lit("b")}), outputs)
    assert "REPARTITION_BY_NUM" in plan(found) and found.count() == 40
