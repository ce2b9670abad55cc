"""Command line: python -m lodegraph DIRECTORY [options]"""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.sql import SparkSession

from lodegraph import sinks
from lodegraph.operators import ranking, references, similarity
from lodegraph.plans import corpus


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodegraph", description="Rank the components of a source tree by how much they are reused.", formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    # Names, letters, choices and defaults of the options.
    p.add_argument("corpus_dir", help="directory with the sources, read with its subdirectories")
    p.add_argument("--language", "-l", choices=references.languages(), default="java", help="language of the sources")
    p.add_argument("--parser", default=None, help=f"engine, of {references.list_engines()}; the language's first if left out")
    p.add_argument("--similarity", "-s", choices=similarity.available_methods(), default="diff", help="measure that merges components")
    p.add_argument("--threshold", "-t", type=float, default=corpus.THRESHOLD, help="similarity from which components are merged")
    p.add_argument("--damping", "-p", type=float, default=ranking.DAMPING, help="weight of real references in the walk")
    p.add_argument("--epsilon", "-e", type=float, default=ranking.EPSILON, help="change at which the iteration ends")
    p.add_argument("--max-iter", type=int, default=ranking.MAX_ITER, help="most steps of the iteration")
    p.add_argument("--solver", choices=["power", "eigen"], default="power", help="power iteration, or an eigenvector of a small graph")
    p.add_argument("--output-format", "-f", choices=sinks.FORMATS, default="table", dest="output_format", help="format of the output")
    p.add_argument("--top", "-n", type=int, default=None, help="only so many of the best")
    p.add_argument("--verbose", "-v", action="store_true", help="log progress to stderr")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = build_parser()
    a = p.parse_args(argv)
    if not os.path.isdir(a.corpus_dir):
        p.error(f"there is no folder '{a.corpus_dir}'")
    if a.verbose:
        logging.basicConfig(level=logging.INFO)
    spark = spark or SparkSession.builder.appName("lodegraph").getOrCreate()
    try:
        ranked = corpus.rank_corpus(spark, a.corpus_dir, a.language, a.parser, a.similarity, a.threshold, a.damping, a.epsilon, a.max_iter, a.solver, a.verbose)
        print(sinks.format_output(ranked, a.output_format, a.top))
    except (RuntimeError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
