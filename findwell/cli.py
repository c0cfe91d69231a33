"""Command line: build an index, search it, look into it.

    python -m findwell.cli build CORPUS INDEX [--name NAME] [--no-stems] [--config FILE]
    python -m findwell.cli search INDEX TEXT [--mode and|or] [--page N] [--config FILE]
    python -m findwell.cli view INDEX [--word WORD]
    python -m findwell.cli merge LEFT RIGHT INDEX
    python -m findwell.cli export INDEX FOLDER

CORPUS holds a folder for each part with one JSON object a file: url, encoding, content.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from findwell.config import Config
from findwell.operators.index import build_index, load_index, merge_indexes
from findwell.operators.indexing import page_tokens
from findwell.operators.search import page_label, page_of
from findwell.sources.pages import read_corpus


def index_name(path: str) -> str:
    """An index is named after its corpus folder."""
    return os.path.basename(os.path.normpath(path)) or "corpus"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="findwell", description="Build, search and view indexes.")
    sub = top.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build", help="index a corpus folder")
    build.add_argument("corpus")
    build.add_argument("index")
    build.add_argument("--name")
    build.add_argument("--no-stems", action="store_true")
    search = sub.add_parser("search", help="ranked results of a query")
    search.add_argument("index")
    search.add_argument("text")
    search.add_argument("--mode", choices=("and", "or"), default="and")
    search.add_argument("--page", type=int, default=1)
    view = sub.add_parser("view", help="metadata, vocabulary statistics, postings of a word")
    view.add_argument("index")
    view.add_argument("--word")
    merge = sub.add_parser("merge", help="one index of two")
    merge.add_argument("left")
    merge.add_argument("right")
    merge.add_argument("index")
    export = sub.add_parser("export", help="postings as JSON lines")
    export.add_argument("index")
    export.add_argument("folder")
    for part in (build, search):
        part.add_argument("--config", help="settings as a JSON file")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    own = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("findwell").getOrCreate()
    config = Config.from_json(own.config) if getattr(own, "config", None) else Config()
    if own.command == "build":
        pages = read_corpus(spark, own.corpus)
        index = build_index(spark, page_tokens(pages, doc_id="url", html="content"), own.index, own.name or index_name(own.corpus), not own.no_stems, config)
        index.metadata().show(truncate=False)
    elif own.command == "search":
        found = load_index(spark, own.index, config).search(own.text, own.mode, None).cache()
        for r in page_of(found, own.page, config.page_size).orderBy("rank").collect():  # a page at most
            print(f"{r['rank']}. {r['url']} ({r['score']})")
        label = page_label(found, own.page, config.page_size).first()
        print(f"{label['label']} results displayed." + " < previous" * label["has_previous"] + " next >" * label["has_next"])
        found.unpersist()
    elif own.command == "view":
        index = load_index(spark, own.index)
        index.metadata().show(truncate=False)
        index.vocab_stats().show()
        if own.word:
            rows = index.postings(own.word)
            for r in rows.withColumn("tags", F.array_join("tags", ",")).toLocalIterator():
                print(r["doc_id"], r["url"], round(r["frequency"], 6), r["tags"], r["position_v"])
    elif own.command == "merge":
        merge_indexes(spark, load_index(spark, own.left), load_index(spark, own.right), own.index, index_name(own.index)).metadata().show(truncate=False)
    else:
        load_index(spark, own.index).export_json(own.folder)


if __name__ == "__main__":
    main()
