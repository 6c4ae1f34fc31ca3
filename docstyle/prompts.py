"""Excerpts and continuation prompts from the command line: python -m docstyle.prompts INPUT EXCERPTS PROMPTS [options].

INPUT is JSON lines (.jsonl, .json), Parquet or CSV with a key and a text column; EXCERPTS is written as CSV or Parquet, PROMPTS as
JSON lines (id, prompt)."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.corpus import excerpts_and_prompts
from .sources.io import load_jsonl, read_table, write_jsonl, write_table


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="docstyle.prompts", description=__doc__)
    for name in ("input", "excerpts", "prompts"):
        p.add_argument(name)
    p.add_argument("--key", default="id")
    p.add_argument("--text", default="text")
    for name, value in (("chunks", 3), ("least", 500), ("most", 600), ("seed", 19)):
        p.add_argument(f"--{name}", type=int, default=value)
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    records = load_jsonl(spark, a.input) if a.input.endswith((".jsonl", ".json")) else read_table(spark, a.input)
    if records is None:
        p.error(f"nothing at {a.input}")
    found, prompts, skipped = excerpts_and_prompts(records, a.key, a.text, a.chunks, a.least, a.most, a.seed)
    if found.isEmpty():
        raise RuntimeError(f"no excerpt: {skipped.count()} of {records.count()} texts have under {a.least} words")
    write_table(found, a.excerpts)
    write_jsonl(prompts, a.prompts)
    print(f"{prompts.count()} prompts, {skipped.count()} texts skipped")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
