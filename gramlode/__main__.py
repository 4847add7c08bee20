"""Command lines: python -m gramlode build | merge | query | scan.

    build -r LIST -w INDEX --root FOLDER [-n MOST] [-z] [-0]    index the files of a path list
    merge TARGET INDEX INDEX ... [--pieces N]                   write several indexes as one; goes on after a crash
    query INDEX TEXT [--least N] [--trigrams]                   paths of the samples that can hold a text
    scan INDEX RULES -r LIST --root FOLDER [-z]                 rule, id and path of all matches
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from gramlode.operators.index import Index, merge
from gramlode.plans.verify import scan
from gramlode.sources.samples import files, path_list


def arguments(given: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="gramlode")
    kinds = parser.add_subparsers(dest="what", required=True)
    build, merged, query, rules = (kinds.add_parser(x) for x in ("build", "merge", "query", "scan"))
    build.add_argument("-w", "--write", required=True, help="folder of the index")
    build.add_argument("-n", "--most", type=int, help="take the first paths only")
    build.add_argument("-0", "--omit-zero", action="store_true", help="leave out grams with a zero byte")
    merged.add_argument("target")
    merged.add_argument("index", nargs="+")
    merged.add_argument("--pieces", type=int, default=1, help="ranges of grams that are written one after the other")
    for x in (query, rules):
        x.add_argument("index")
    query.add_argument("text")
    query.add_argument("--least", type=int, help="so many of the grams are enough")
    query.add_argument("--trigrams", action="store_true")
    rules.add_argument("rules", help="a file of rules")
    for x in (build, rules):
        x.add_argument("-r", "--read", required=True, help="a text file with a path per line")
        x.add_argument("--root", default="/", help="folder of paths that are not whole")
        x.add_argument("-z", "--gzip", action="store_true")
    return parser.parse_args(given)


def main(given: list[str] | None = None) -> int:
    a = arguments(sys.argv[1:] if given is None else given)
    spark = SparkSession.builder.appName("gramlode").getOrCreate()
    if a.what == "build":
        samples = files(spark, path_list(spark, a.read, a.most), a.root, a.gzip)
        print(Index.build(samples, a.write, a.omit_zero).numsamples)
    elif a.what == "merge":
        print(merge([Index.open(spark, x) for x in a.index], a.target, pieces=a.pieces).numsamples)
    elif a.what == "query":
        index = Index.open(spark, a.index)
        found = index.match_posting_lists(a.text, a.least) if a.least else index.get_posting_list_n3(a.text) if a.trigrams else index.get_posting_list(a.text)
        for row in index.fid2path(found).toLocalIterator() if found is not None else ():
            print(row.fid, row.path, sep="\t")
    else:
        with open(a.rules) as file:
            text = file.read()
        for row in scan(Index.open(spark, a.index), files(spark, path_list(spark, a.read), a.root, a.gzip), text).toLocalIterator():
            print(row.rule, row.fid, row.path, sep="\t")
    return 0


if __name__ == "__main__":
    sys.exit(main())
