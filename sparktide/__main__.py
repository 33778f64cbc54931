"""python -m sparktide analyze FILE --column NAME ...: topics of a file's texts."""

from __future__ import annotations

import argparse
import sys

from .api import TopicOptions, run_topic_analysis
from .sources.readers import LANGUAGES, METHODS


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparktide", description="Topics of the texts in a table.")
    a = p.add_subparsers(dest="command", required=True).add_parser("analyze", help="factorize a file's texts and write the topics")
    a.add_argument("file")
    a.add_argument("--column", required=True)
    a.add_argument("--separator", default=",")
    a.add_argument("--language", default="EN", type=str.upper, choices=LANGUAGES)
    a.add_argument("--topics", type=int, default=5, help="-1 chooses them by size")
    a.add_argument("--words", type=int, default=15)
    a.add_argument("--method", default="nmf", choices=METHODS)
    a.add_argument("--lemmatize", action="store_true")
    a.add_argument("--keep-numbers", action="store_true")
    a.add_argument("--ngrams", choices=("bpe", "wordpiece"))
    a.add_argument("--merges", type=int, default=0)
    a.add_argument("--datetime-column")
    a.add_argument("--weight-column")
    a.add_argument("--grain", default="year", choices=("year", "quarter", "month", "week"))
    a.add_argument("--output", default="topics")
    a.add_argument("--name", default="analysis")
    return p


def main(args: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("sparktide").getOrCreate()
    o = TopicOptions(language=a.language, topics=a.topics, words_per_topic=a.words, method=a.method, lemmatize=a.lemmatize, keep_numbers=a.keep_numbers, ngrams=a.ngrams, merges=a.merges, datetime_col=a.datetime_column, weight_col=a.weight_column, grain=a.grain)
    try:
        result = run_topic_analysis(spark, filepath=a.file, column=a.column, separator=a.separator, options=o)
    except ValueError as x:
        print(f"error: {x}", file=sys.stderr)
        return 2
    if result.warning:
        print(result.warning, file=sys.stderr)
    for kind, path in result.save(a.output, a.name).items():
        print(kind, path)
    return 0


if __name__ == "__main__":
    sys.exit(main())
