"""SimHash fingerprints and near-duplicate groups by a binary trie self-join.

Fingerprints that differ in at most four of 64 bits agree in full on one of five
bit blocks. So each distinct fingerprint goes to five groups, one for each block
and its value, and every group joins with itself through a binary trie: pairs of
nodes are followed downwards together, differing bits are added up, and a pair is
dropped once it has more than allowed. A group with many members is first split
again, by the same argument on the bits outside its block, until it is small or
the bits left bound its size. Of each group only the links of a spanning forest
leave; components are then found by alternating large-star and small-star steps.

Defined results: null and empty texts, and such without words, have fingerprint
zero and link like any other. Repeated rows and rows with a null id each return
one row; a null id never names a component unless all its ids are null. Other
columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findwell.llm._arrow import as_bytes, bounded_batches, chunks, whole_groups
from findwell.session import delete, new_path, saved, written

#: Bits of a fingerprint and most differing bits of a link.
BITS, ERRORS = 64, 4
#: Members beyond which a group is split by further blocks.
SPLIT_ROWS = 8_192
#: Node pairs followed at once by a task.
FRONT = 1_000_000


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """The fingerprint of a text's bytes as an unsigned integer."""
    parts = text.lower().split()
    if not parts:
        return 0
    n = len(parts)
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if n <= words:
        hashes = [digest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1)
        starts = (ends - np.fromiter(map(len, parts), np.int64, n) - 1).tolist()
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, (ends - 1).tolist()[words - 1 :])]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[at : at + (1 << 14)], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its fingerprint as a signed long."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            fp = np.array([fingerprint(t, words) for t in as_bytes(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


# the trie join ----------------------------------------------------------------


def trie_links(group: np.ndarray, fp: np.ndarray, errors: int = ERRORS, front: int = FRONT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions of one group whose fingerprints differ in at most `errors` bits.

    Rows are sorted by (group, fingerprint), fingerprints of a group are distinct.
    A node of the trie is a range of rows; the work list holds node pairs of one
    depth with the bits in which they differ so far.
    """
    n = len(fp)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], n]
    wide = ends - starts > 1
    a, b = starts[wide], ends[wide]
    zeros: dict[int, np.ndarray] = {}
    stack = [(0, a, b, a, b, np.zeros(len(a), np.int8))]
    while stack:
        depth, ul, uh, vl, vh, err = stack.pop()
        if len(ul) > front:
            half = len(ul) // 2
            stack += [(depth, *(x[half:] for x in (ul, uh, vl, vh, err))), (depth, *(x[:half] for x in (ul, uh, vl, vh, err)))]
            continue
        if depth not in zeros:
            zeros[depth] = np.r_[0, np.cumsum((fp >> np.uint64(BITS - 1 - depth)) & np.uint64(1) == 0)]
        z = zeros[depth]
        um, vm = ul + z[uh] - z[ul], vl + z[vh] - z[vl]
        same = ul == vl
        parts = []
        for x, y, more, keep in (((ul, um), (vl, vm), 0, None), ((um, uh), (vm, vh), 0, None), ((ul, um), (vm, vh), 1, None), ((um, uh), (vl, vm), 1, ~same)):
            ok = (x[1] > x[0]) & (y[1] > y[0]) & (err + more <= errors)
            if keep is not None:
                ok &= keep
            parts.append((x[0][ok], x[1][ok], y[0][ok], y[1][ok], err[ok] + np.int8(more)))
        ul, uh, vl, vh, err = (np.concatenate(c) for c in zip(*parts))
        su, sv = uh - ul, vh - vl
        live = ~((ul == vl) & (su == 1))
        done = live & (su * sv <= 16)
        if depth == BITS - 1:
            done = live
        if done.any():
            l, m, r, s = ul[done], su[done], vl[done], sv[done]
            size = m * s
            at = np.repeat(np.cumsum(size) - size, size)
            k = np.arange(size.sum()) - at
            width = np.repeat(s, size)
            i, j = np.repeat(l, size) + k // width, np.repeat(r, size) + k % width
            close = (i < j) & (np.bitwise_count(fp[i] ^ fp[j]) <= errors)
            if close.any():
                yield i[close], j[close]
        live &= ~done
        if live.any():
            stack.append((depth + 1, ul[live], uh[live], vl[live], vh[live], err[live]))


def _forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The first position of each row's component."""
    root = np.arange(n)
    for i, j in links:
        while True:
            while not np.array_equal(up := root[root], root):
                root = up
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j = i[apart], j[apart]
            np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
    while not np.array_equal(up := root[root], root):
        root = up
    return root


def _join_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in whole_groups(batches, "key"):
        key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order]
        root = _forest(len(fp), trie_links(key, fp))
        tied = root != np.arange(len(fp))
        yield pa.RecordBatch.from_arrays([pa.array(fp[tied].view(np.int64)), pa.array(fp[root[tied]].view(np.int64))], names=["a", "b"])


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(bits, parts)]


def _value(bits: list[int]):
    """The bits of a fingerprint at these places, packed; places in a row move together."""
    out, shift = F.lit(0).cast("bigint"), 0
    at = 0
    while at < len(bits):
        to = at + 1
        while to < len(bits) and bits[to] == bits[to - 1] + 1:
            to += 1
        run = F.shiftrightunsigned("fp", bits[at]).bitwiseAND(F.lit((1 << (to - at)) - 1))
        out = out.bitwiseOR(F.shiftleft(run, shift))
        shift += to - at
        at = to
    return out


def links(nodes: DataFrame, errors: int = ERRORS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """A spanning forest (a, b) of the links between distinct fingerprints `fp`, per group.

    Any two linked fingerprints are joined by links of the forest.
    """
    nodes = nodes.select("fp")
    level = [(tuple(), nodes, list(range(BITS)))]
    out = None
    while level:
        following = []
        for name, rows, bits in level:
            parts = _blocks(bits, errors + 1)
            keyed = rows.select(
                "fp", *[c for c in rows.columns if c != "fp"],
                F.explode(F.array(*[F.struct(F.lit(k).alias("part"), _value(p).alias("value")) for k, p in enumerate(parts)])).alias("x"),
            )
            inner = [F.col(c) for c in rows.columns if c != "fp"]
            keyed = keyed.select("fp", F.xxhash64(*inner, F.lit(str(name)), "x.part", "x.value").alias("key"), F.col("x.part").alias("part"))
            big = keyed.groupBy("key").agg(F.count("*").alias("n"), F.first("part").alias("part")).where(F.col("n") > split_rows)
            found = {r["part"] for r in big.groupBy("part").count().collect()} if len(bits) > 24 else set()
            if found:
                big = saved(big.select("key"), "hot-blocks")
                small = keyed.join(F.broadcast(big) if big.count() <= 100_000 else big, "key", "left_anti")
                for k in sorted(found):
                    rest = [b for b in bits if b not in parts[k]]
                    sub = keyed.where(F.col("part") == k).join(big, "key", "left_semi")
                    following.append(((*name, k), saved(sub.select("fp", F.col("key").alias("within")), "hot-rows"), rest))
            else:
                small = keyed
            joined = small.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(_join_groups, "a bigint, b bigint")
            out = joined if out is None else out.unionByName(joined)
        level = following
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for nodes with a link.

    Alternating large-star and small-star steps on edges (a, b) until nothing
    changes; each step leaves at most one edge for each edge before it and is
    written to the shared folder, where it replaces the one before.
    """

    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    spark = edges.sparkSession
    path = new_path(spark, "edges")
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), path)
    before = None
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = smallest(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = smallest(large)
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        following = new_path(spark, "edges")
        edges = written(small, following)
        delete(spark, path)
        path = following
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, words: int = 4, errors: int = ERRORS, split_rows: int = SPLIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex) and component_id: the smallest id reachable over links."""
    fps = saved(fingerprints(docs, words, id_col, text_col), "fingerprints")
    nodes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    of = components(links(nodes, errors, split_rows))
    named = nodes.join(of.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    per = named.join(ids, "component").select("fp", "component_id")
    return fps.join(per, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
