"""Providers: request lines as Columns, batches as driver calls."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import requests
from ..functions.requests import OutputSchema
from ..functions.tokens import EnqueueLimits
from ..sources.files import output_lines
from ..workspace import new_path

INLINE_BYTES = 20_000_000
INPUT_MODES = ("auto", "inline", "file", "gcs")


def gemini_input_mode(mode: str, size: int, *, vertex: bool = False, bucket: str | None = None) -> str:
    """How an input of ``size`` bytes reaches the provider."""
    if mode not in INPUT_MODES:
        raise ValueError(f"no such input mode: {mode}")
    if vertex:
        if mode not in ("auto", "gcs") or not bucket:
            raise ValueError("Vertex takes input from a bucket, which must be named")
        return "gcs"
    if mode == "gcs":
        raise ValueError("the developer API takes no input from a bucket")
    if mode == "inline" and size >= INLINE_BYTES:
        raise ValueError("inline input must be smaller than 20 MB")
    return ("inline" if size < INLINE_BYTES else "file") if mode == "auto" else mode


@dataclass(frozen=True)
class ProviderConfig:
    """Settings without secrets: credentials come from the environment when a client is made."""

    kind: str = "openai"
    model: str = "m"
    endpoint: str = requests.RESPONSES
    effort: str | None = None
    max_tokens: int = 1024
    params: dict | None = None
    vertex: bool = False
    limits: EnqueueLimits = EnqueueLimits()

    def __post_init__(self):
        if self.kind not in ("openai", "anthropic", "gemini"):
            raise ValueError(f"no such provider: {self.kind}")
        if self.endpoint not in (requests.RESPONSES, requests.CHAT):
            raise ValueError(f"no such endpoint: {self.endpoint}")
        if self.max_tokens <= 0 or not self.model:
            raise ValueError("a model and positive max_tokens are needed")

    def line(self, custom_id: Column, prompt: Column, system: Column, output: OutputSchema | None = None) -> Column:
        if self.kind == "anthropic":
            return requests.anthropic_line(custom_id, prompt, system, model=self.model, max_tokens=self.max_tokens, params=self.params, output=output)
        if self.kind == "gemini":
            return requests.gemini_line(custom_id, prompt, system, vertex=self.vertex, config=self.params, output=output)
        if self.endpoint == requests.CHAT:
            return requests.chat_line(custom_id, prompt, system, model=self.model, output=output)
        return requests.responses_line(custom_id, prompt, system, model=self.model, effort=self.effort, output=output)

    def payload(self) -> dict:
        return {"kind": self.kind, "model": self.model, "endpoint": self.endpoint, "effort": self.effort, "max_tokens": self.max_tokens, "params": self.params, "vertex": self.vertex, "limits": self.limits.__dict__}

    @classmethod
    def from_payload(cls, data: dict) -> ProviderConfig:
        return cls(**{**data, "limits": EnqueueLimits(**data.get("limits", {}))})


@dataclass
class Batch:
    """A provider's view of a batch."""

    id: str
    status: str
    outputs: str | None = None
    errors: str | None = None
    failure: str | None = None


class Provider(ABC):
    """The calls that reach the provider; all run on the driver."""

    #: Batches that may be asked after at once.
    threads = 1

    def __init__(self, config: ProviderConfig):
        self.config = config

    @abstractmethod
    def create(self, spark: SparkSession, path: str, metadata: dict) -> Batch: ...

    @abstractmethod
    def get(self, batch_id: str) -> Batch: ...

    def new_cycle(self) -> None:
        """A submission cycle begins."""

    def lines(self, spark: SparkSession, batches: list[Batch]) -> DataFrame:
        """``provider_batch_id, value, from_error_file, line_number`` of all batches' outputs in one scan."""
        known = {p.rstrip("/"): (b.id, err) for b in batches for p, err in ((b.outputs, False), (b.errors, True)) if p}
        if not known:
            return spark.createDataFrame([], "provider_batch_id string, value string, from_error_file boolean, line_number bigint")
        raw = output_lines(spark, list(known))
        folder = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), r"/[^/]+$", "")
        clean = [(p.removeprefix("file://"), i, e) for p, (i, e) in known.items()]
        whose = spark.createDataFrame(clean, "_folder string, provider_batch_id string, from_error_file boolean")
        j = raw.withColumn("_folder", folder).join(F.broadcast(whose), "_folder", "left")
        return j.select("provider_batch_id", "value", "from_error_file", "line_number")


def outcome_of(number: Column, round_: Column, structured: bool) -> Column:
    """The local provider's deterministic outcome of an item in a round."""
    k = number % 20
    return (
        F.when((k == 3) & (round_ == 1), "missing").when(k == 5, "error").when((k == 7) & (round_ == 1), "quota")
        .when((k == 11) & (round_ == 1), "enqueue").when((k == 13) & F.lit(structured), "invalid")
        .when((k == 17) & (round_ == 1), "error").otherwise("ok")
    )


def local_output(custom_id: Column, number: Column, round_: Column, *, structured: bool = False, provider: str = "openai") -> Column:
    """The output line of a request; null where the provider loses it."""
    what = outcome_of(number, round_, structured)
    answer = F.when(what == "invalid", "not json").otherwise(
        F.format_string('{"label":"l%d","score":0.5}', number) if structured else F.concat(F.lit("answer "), number.cast("string"))
    )
    said = F.when(what == "quota", "You exceeded your current quota, please check your plan").when(what == "enqueue", "Enqueued token limit reached for model").otherwise("boom")
    code = F.when(what == "quota", "insufficient_quota").when(what == "enqueue", "token_limit_exceeded").otherwise("server_error")
    bad = ~what.isin("ok", "invalid")
    error = F.struct(code.alias("code"), said.alias("message"))
    if provider == "anthropic":
        good = F.struct(F.lit("succeeded").alias("type"), F.struct(F.array(F.struct(F.lit("text").alias("type"), answer.alias("text"))).alias("content")).alias("message"))
        ok = F.to_json(F.struct(custom_id.alias("custom_id"), good.alias("result")))
        no = F.to_json(F.struct(custom_id.alias("custom_id"), F.struct(F.lit("errored").alias("type"), error.alias("error")).alias("result")))
    elif provider == "gemini":
        parts = F.array(F.struct(F.struct(F.array(F.struct(answer.alias("text"))).alias("parts")).alias("content")))
        ok = F.to_json(F.struct(custom_id.alias("key"), F.struct(parts.alias("candidates")).alias("response")))
        no = F.to_json(F.struct(custom_id.alias("key"), error.alias("error")))
    else:
        body = F.struct(F.array(F.struct(F.array(F.struct(answer.alias("text"))).alias("content"))).alias("output"))
        ok = F.to_json(F.struct(custom_id.alias("custom_id"), F.struct(F.lit(200).alias("status_code"), body.alias("body")).alias("response")))
        fail = F.struct(F.when(what == "quota", 429).otherwise(400).alias("status_code"), F.struct(error.alias("error")).alias("body"))
        no = F.to_json(F.struct(custom_id.alias("custom_id"), fail.alias("response")))
    return F.when(what == "missing", F.lit(None)).when(bad, no).otherwise(ok)


class LocalProvider(Provider):
    """Answers from the request files by ``outcome_of``; the item's number is what
    its id begins with, and its round how many batches of its run have asked for it,
    whatever cycle they are of. Batches complete at the first look."""

    def __init__(self, config: ProviderConfig | None = None, *, structured: bool = False, number: Callable[[Column], Column] | None = None):
        super().__init__(config or ProviderConfig())
        self.structured, self.batches, self._answered = structured, {}, []
        self.number = number or (lambda cid: F.regexp_extract(cid, r"^(\d+):", 1).cast("bigint"))

    def create(self, spark: SparkSession, path: str, metadata: dict) -> Batch:
        b = Batch(f"local-{len(self.batches) + 1:06d}", "in_progress")
        self.batches[b.id] = (b, path, metadata.get("run_id"), len(self.batches) + 1)
        return b

    def get(self, batch_id: str) -> Batch:
        b, path, *_ = self.batches[batch_id]
        b.status, b.outputs = "completed", path
        return b

    def lines(self, spark: SparkSession, batches: list[Batch]) -> DataFrame:
        """Outputs are computed from the requests of all batches in one scan, and written
        as a provider's would be. The table has a row a request, those without an
        answer too: it tells later batches whom earlier ones asked for."""
        raw = super().lines(spark, batches)
        if not batches:
            return raw
        kind = self.config.kind
        of = spark.createDataFrame([(b.id, *self.batches[b.id][2:]) for b in batches], "provider_batch_id string, _run string, _ordinal bigint")
        asked = raw.withColumn("_cid", requests.correlation_id(F.col("value"), provider=kind)).drop("value")
        asked = asked.withColumn("_number", self.number(F.col("_cid"))).join(F.broadcast(of), "provider_batch_id")
        round_ = F.lit(1)
        if self._answered:
            key = ["_run", "_number"]
            earlier = spark.read.parquet(*self._answered).where("_number is not null")
            asked = asked.join(earlier.groupBy(*key).agg(F.collect_set("_ordinal").alias("_earlier")), key, "left")
            round_ = 1 + F.size(F.filter(F.coalesce("_earlier", F.array().cast("array<bigint>")), lambda o: o < F.col("_ordinal")))
        out = local_output(F.col("_cid"), F.col("_number"), round_, structured=self.structured, provider=kind)
        path = new_path(spark, "outputs")
        asked.select("provider_batch_id", out.alias("value"), "from_error_file", "line_number", "_run", "_number", "_ordinal").write.parquet(path)
        self._answered.append(path)
        return spark.read.parquet(path).where("value is not null").select(*raw.columns)
