"""Command line: start, status, wait, results, export-artifacts, prune-artifacts."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import ChunkPolicy
from ..session import session
from ..sources.files import CompositeSource, Part, source_for
from .ledger import ParquetLedger
from .providers import LocalProvider, Provider
from .runner import Job, Runner


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillrun", description=__doc__)
    p.add_argument("--root", required=True, help="folder of ledger and artifacts")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("start")
    s.add_argument("inputs", nargs="+", help=".csv, .jsonl or .parquet; several are read one after another")
    s.add_argument("--id-field", required=True)
    g = s.add_mutually_exclusive_group(required=True)
    g.add_argument("--prompt-field")
    g.add_argument("--prompt-template")
    s.add_argument("--system")
    s.add_argument("--max-requests", type=int, default=ChunkPolicy().max_requests)
    s.add_argument("--run-id")
    for name in ("status", "wait"):
        sub.add_parser(name).add_argument("run_id")
    for name in ("results", "export-artifacts"):
        s = sub.add_parser(name)
        s.add_argument("run_id")
        s.add_argument("destination")
    s = sub.add_parser("prune-artifacts")
    s.add_argument("run_id")
    s.add_argument("--raw-outputs", action="store_true")
    return p


def job_of(spark: SparkSession, a: argparse.Namespace) -> Job:
    sources = [source_for(spark, p) for p in a.inputs]

    def columns(source) -> tuple:
        rows = source.rows()
        if source.kind == "jsonl":
            text = F.col("value")
            fields = [a.prompt_field] if a.prompt_field else []
            if a.prompt_template:
                from ..functions.prompts import template_fields

                fields = template_fields(a.prompt_template)
            pick = F.struct(*(F.get_json_object(text, f"$.{f}").alias(f) for f in fields))
            return F.get_json_object(text, f"$.{a.id_field}"), pick
        names = [c for c in rows.columns if c != "row_index"]
        return F.col(f"`{a.id_field}`").cast("string"), F.struct(*names)

    chunks = ChunkPolicy(max_requests=a.max_requests)
    common = {"field": a.prompt_field, "template": a.prompt_template, "system": a.system, "chunks": chunks}
    if len(sources) == 1:
        item_id, payload = columns(sources[0])
        return Job(sources[0], item_id, payload, **common)
    both = CompositeSource([Part(s, *columns(s)) for s in sources])
    return Job(both, F.col("item_id"), F.col("payload"), metadata=F.col("metadata"), **common)


def main(argv: list[str] | None = None, *, spark: SparkSession | None = None, provider: Provider | None = None) -> dict:
    a = parser().parse_args(argv)
    spark = spark or session()
    runner = Runner(spark, ParquetLedger(spark, f"{a.root}/ledger"), provider or LocalProvider(), f"{a.root}/artifacts")
    if a.command == "start":
        run = runner.start(job_of(spark, a), a.run_id)
        out = run.refresh()
    else:
        run = runner.get_run(a.run_id)
        if a.command == "status":
            out = run.snapshot()
        elif a.command == "wait":
            out = run.wait()
        elif a.command == "results":
            run._ended()
            from ..operators.results import export_lines

            schema = run._structured()
            export_lines(run.items(), structured=bool(schema), output_key="output").orderBy("item_index").select("value").write.mode("overwrite").text(a.destination)
            out = {"run_id": a.run_id, "destination": a.destination}
        elif a.command == "export-artifacts":
            out = run.export(a.destination)
        else:
            out = run.prune(raw_outputs=a.raw_outputs)
    print(json.dumps(out, default=str))
    return out


if __name__ == "__main__":
    main()
