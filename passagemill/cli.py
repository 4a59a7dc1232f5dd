"""Command line: chunk files into Markdown."""

from __future__ import annotations

import argparse
import os
import sys

from . import __version__
from .config import Config
from .errors import ChunkingError


#: Events shown at most; all are in the result.
SHOWN = 100


# The options' names, short forms and defaults.
def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="passagemill", description="Cut documents into passages with metadata.")
    p.add_argument("input_file", help="file, folder or glob to chunk")
    p.add_argument("-o", "--output-dir", default="./output")
    p.add_argument("-m", "--model", default="gpt-4o")
    p.add_argument("-k", "--api-key", default=os.environ.get("OPENAI_API_KEY"))
    p.add_argument("-c", "--config", help="YAML settings; the options below are then ignored")
    p.add_argument("-t", "--threshold", type=float, default=0.5)
    p.add_argument("--min-tokens", type=int, default=50)
    p.add_argument("--max-tokens", type=int, default=500)
    p.add_argument("--plan-granularity", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--dry-run", action="store_true", help="no calls of a language model")
    p.add_argument("--version", action="version", version=__version__)
    return p


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from .plans.pipeline import Chunker
    from .sinks import export_markdown

    a = parser().parse_args(argv)
    if not a.api_key and not a.dry_run:
        print("an API key is needed: set OPENAI_API_KEY or use --api-key", file=sys.stderr)
        return 1
    try:
        config = Config.from_yaml(a.config) if a.config else Config(
            similarity_threshold=a.threshold, min_chunk_tokens=a.min_tokens, max_chunk_tokens=a.max_tokens, granularity_planning_enabled=a.plan_granularity, verbose=a.verbose,
        )
        spark = SparkSession.builder.appName("passagemill").getOrCreate()
        chunker = Chunker(spark, config) if a.dry_run else Chunker.with_api(spark, a.api_key, a.model, config)
        show = (lambda name, done: print(f"{done:4.0%} {name}")) if a.verbose else None
        # The table is read twice below; caching asks a model once.
        result = chunker.chunk_files(a.input_file, None, a.dry_run, show)
        result.documents = result.documents.cache()
        files = export_markdown(result.documents, a.output_dir)
    except ChunkingError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    events = result.events.limit(SHOWN + 1).collect()
    for event in events[:SHOWN]:
        print(f"{event['level']}: {event['doc_id']}: {event['message']}", file=sys.stderr)
    if len(events) > SHOWN:
        print("... and more", file=sys.stderr)
    print(f"{result.chunk_count()} chunks, {result.total_tokens()} tokens, {len(files)} files")
    for error in result.errors:
        print(f"error: {error}", file=sys.stderr)
    return 0 if result.success and files else 1


if __name__ == "__main__":
    sys.exit(main())
