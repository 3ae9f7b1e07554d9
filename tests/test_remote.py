"""The adapters against clients of our own."""

import json
from types import SimpleNamespace as Obj

import pytest
from pyspark.sql import functions as F

from quillrun.functions import responses
from quillrun.plans import remote
from quillrun.plans.ledger import ParquetLedger
from quillrun.plans.providers import ProviderConfig
from quillrun.plans.runner import Job, Runner
from quillrun.sources.files import FrameSource


class OpenAI:
    """Keeps files and batches; answers every request with its input in capitals."""

    def __init__(self):
        self.stored, self.made = {}, {}
        self.files = Obj(create=self._upload, content=lambda name: Obj(text=self.stored[name]))
        self.batches = Obj(create=self._create, retrieve=lambda i: self.made[i])

    def _upload(self, file, purpose):
        assert purpose == "batch"
        name = f"f{len(self.stored)}"
        self.stored[name] = file[1].decode()
        return Obj(id=name)

    def _create(self, input_file_id, endpoint, completion_window, metadata):
        rows = [json.loads(x) for x in self.stored[input_file_id].splitlines()]
        out = [{"custom_id": r["custom_id"], "response": {"status_code": 200, "body": {"output_text": r["body"]["input"].upper()}}} for r in rows]
        self.stored["out"] = "".join(json.dumps(x) + "\n" for x in out)
        b = Obj(id=f"batch_{len(self.made)}", status="completed", output_file_id="out", error_file_id=None)
        self.made[b.id] = b
        return Obj(id=b.id, status="validating")


class Anthropic:
    def __init__(self):
        self.sent = []
        self.messages = Obj(batches=Obj(create=self._create, retrieve=lambda i: Obj(id=i, processing_status="ended"), results=self._results))

    def _create(self, requests):
        self.sent = requests
        return Obj(id="msgbatch", processing_status="in_progress")

    def _results(self, batch_id):
        for r in self.sent:
            text = r["params"]["messages"][0]["content"].upper()
            yield {"custom_id": r["custom_id"], "result": {"type": "succeeded", "message": {"content": [{"type": "text", "text": text}]}}}


class Gemini:
    def __init__(self):
        self.files = Obj(upload=self._upload, download=lambda file: self.data)
        self.batches = Obj(create=self._create, get=lambda name: self.batch)

    def _upload(self, file, config):
        rows = [json.loads(x) for x in file.decode().splitlines()]
        self.data = "".join(json.dumps({"key": r["key"], "response": {"text": r["request"]["contents"][0]["parts"][0]["text"].upper()}}) + "\n" for r in rows).encode()
        return Obj(name="files/1")

    def _create(self, model, src, config):
        if isinstance(src, str):
            dest = Obj(file_name="files/out")
        else:
            answers = [Obj(metadata=r["metadata"], response={"text": r["contents"][0]["parts"][0]["text"].upper()}, error=None) for r in src]
            dest = Obj(inlined_responses=answers)
        self.batch = Obj(name="batches/1", state=Obj(name="JOB_STATE_SUCCEEDED"), dest=dest)
        return Obj(name="batches/1", state="JOB_STATE_PENDING")


@pytest.mark.parametrize("kind, client, options", [("openai", OpenAI, {}), ("anthropic", Anthropic, {}), ("gemini", Gemini, {"mode": "inline"}), ("gemini", Gemini, {"mode": "file"})])
def test_a_run(spark, tmp_path, kind, client, options):
    root = f"file://{tmp_path}"
    provider = remote.open_provider(ProviderConfig(kind), client(), f"{root}/outputs", **options)
    df = spark.createDataFrame([(1, "alpha"), (2, "beta")], "id long, text string")
    job = Job(FrameSource(df, "id"), F.col("id").cast("string"), F.struct("text"), field="text")
    run = Runner(spark, ParquetLedger(spark, f"{root}/ledger"), provider, root, sleep=lambda _: None).run_and_wait(job, "run", timeout=300)
    assert {r.item_id: r.output_text for r in run.results().collect()} == {"1": "ALPHA", "2": "BETA"}


def test_keys():
    assert remote.api_key("openai", " k ", {}) == "k" and remote.api_key("gemini", None, {"GOOGLE_API_KEY": "g"}) == "g"
    with pytest.raises(ValueError):
        remote.api_key("anthropic", "", {})
    with pytest.raises(ValueError):
        remote.OpenAIProvider(ProviderConfig("gemini"), None, "x")


def test_states_are_those_of_the_columns(spark):
    states = ["ended", "JOB_STATE_SUCCEEDED", "BATCH_STATE_FAILED", "job_state_cancelled", "JOB_STATE_EXPIRED", "JOB_STATE_PARTIALLY_SUCCEEDED", "JOB_STATE_RUNNING", "completed"]
    df = spark.createDataFrame([(s,) for s in states], "s string")
    for kind in responses.PROVIDERS:
        for r in df.select("s", responses.normal_status(F.col("s"), kind).alias("n")).collect():
            assert remote.status_of(r.s, kind) == r.n
