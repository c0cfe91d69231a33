"""Web pages: reading corpora and taking the text runs out of HTML.

Only the text directly after a start tag counts, up to the next markup of any
kind; what follows an end tag, a comment or a void tag does not. Meta blocks named
title, description, author or keywords come before everything else.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
VOID_TAGS = "area base br col embed hr img input link meta param source track wbr".split()
META_NAMES = "title description author keywords".split()

PAGE_SCHEMA = T.StructType([T.StructField("url", T.StringType()), T.StructField("encoding", T.StringType()), T.StructField("content", T.StringType())])

RAW_BLOCKS = ["(?s)<!--.*?-->", "(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>"]
START_TAG = "<([a-zA-Z][a-zA-Z0-9]*)[^>]*>([^<]*)"
ENTITY = "&([a-zA-Z][a-zA-Z0-9]*;|amp|quot|lt|gt|apos|copy|middot|nbsp)"
META_TAG = "(?i)<meta[^>]*>"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a corpus folder: path/<part>/<file>, one JSON object in each file, whatever its name."""
    return spark.read.schema(PAGE_SCHEMA).option("multiLine", True).json(f"{path}/*/*")


def _attribute(tag: Column, name: str) -> Column:
    quoted = F.regexp_extract(tag, f"(?i)[\\s\"']{name}\\s*=\\s*\"([^\"]*)\"", 1)
    single = F.regexp_extract(tag, f"(?i)[\\s\"']{name}\\s*=\\s*'([^']*)'", 1)
    return F.concat(quoted, single)


def meta_texts(html: Column) -> Column:
    """Texts of the named meta tags: content, blank, value, blank."""
    tags = F.regexp_extract_all(html, F.lit(META_TAG), F.lit(0))
    named = F.filter(tags, lambda t: _attribute(t, "name").isin(*META_NAMES))
    return F.transform(named, lambda t: F.concat(_attribute(t, "content"), F.lit(" "), _attribute(t, "value"), F.lit(" ")))


def segments(html: Column) -> Column:
    """(tag, txt) of a page in document order, meta blocks first. Null html has none."""
    clean = F.coalesce(html, F.lit(""))
    for block in RAW_BLOCKS:
        clean = F.regexp_replace(clean, block, "<!>")
    tags = F.regexp_extract_all(clean, F.lit(START_TAG), F.lit(1))
    texts = F.regexp_extract_all(clean, F.lit(START_TAG), F.lit(2))
    runs = F.zip_with(tags, texts, lambda a, b: F.struct(F.lower(a).alias("tag"), F.regexp_replace(b, ENTITY, " ").alias("txt")))
    runs = F.filter(runs, lambda s: ~s["tag"].isin(*VOID_TAGS))
    metas = F.transform(meta_texts(F.coalesce(html, F.lit(""))), lambda t: F.struct(F.lit("meta").alias("tag"), F.regexp_replace(t, ENTITY, " ").alias("txt")))
    return F.concat(metas, runs)


class _Runs(HTMLParser):
    """Text runs after start tags, with all entities decoded."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.metas, self.runs, self.tag = [], [], None

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        if tag == "meta" and found.get("name") in META_NAMES:
            self.metas.append(("meta", f"{found.get('content') or ''} {found.get('value') or ''} "))
        self.tag = None if tag in VOID_TAGS or tag in ("script", "style") else tag

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.tag = None

    def handle_comment(self, data):
        self.tag = None

    def handle_data(self, data):
        if self.tag:
            self.runs.append((self.tag, data))
            self.tag = None


def parsed_segments(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, segments) by a full HTML parser, for pages whose markup the expressions do not cover."""
    kind = pages.schema[id_col].dataType.simpleString()
    shape = pa.list_(pa.struct([("tag", pa.string()), ("txt", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for html in batch.column(1).to_pylist():
                parser = _Runs()
                parser.feed(html or "")
                parser.close()
                rows.append([{"tag": a, "txt": b} for a, b in parser.metas + parser.runs])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, shape)], names=[id_col, "segments"])

    return pages.select(id_col, html_col).mapInArrow(run, f"{id_col} {kind}, segments array<struct<tag:string,txt:string>>")
