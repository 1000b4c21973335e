"""Score files or stdin and fail a build on flagged ones: `python -m quillspark [--json] [--ml --reference PATH...] PATH... | -`."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .api import lint
from .operators.gate import exit_code, gate
from .operators.heuristic import top_issues_column
from .sources import readers


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillspark", description=__doc__)
    parser.add_argument("paths", nargs="*")
    parser.add_argument("--json", action="store_true", help="an array with a result a text")
    parser.add_argument("--ml", action="store_true", help="add the combiner's probability; needs --reference")
    parser.add_argument("--reference", nargs="+", default=[], metavar="PATH", help="text files on which the n-gram pair of --ml is fitted")
    parser.add_argument("--model", help="a combiner's JSON file")
    parser.add_argument("--threshold", type=float, default=3.0)
    parser.add_argument("--prob", type=float, default=0.5)
    parser.add_argument("--quiet", action="store_true")
    args = parser.parse_args(argv)
    if not args.paths:
        parser.print_help()
        return 2
    spark = spark or SparkSession.builder.appName("quillspark").getOrCreate()
    files = [p for p in args.paths if p != "-"]
    texts = readers.read_texts(spark, files)
    if "-" in args.paths:
        texts = texts.union(readers.literal_text(spark, sys.stdin.read()))
    scored = gate(lint(texts, ml=args.ml, model=args.model, reference=readers.read_texts(spark, args.reference) if args.reference else None), args.threshold, args.prob).persist()
    try:
        if args.json:
            print("[" + ",\n".join(r[0] for r in scored.select(readers.result_json(scored, ["name", "flagged"])).toLocalIterator()) + "]")
        elif not args.quiet:
            shown = scored.withColumn("top", F.to_json(top_issues_column(F.col("signals")))).select("name", "score", "verdict", *(["probability"] if "probability" in scored.columns else []), "low_confidence", "word_count", "sentence_cv", "type_token_ratio", "top")
            for r in shown.toLocalIterator():
                print("\n".join(readers.console_lines(r.asDict())))
        return exit_code(scored)
    finally:
        scored.unpersist()
