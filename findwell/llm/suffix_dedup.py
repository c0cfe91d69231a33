"""Removal of repeated byte strings by sorting suffixes with a difference cover.

Every string of `length` bytes that starts anywhere is judged: is there another
place, in this text or any other, where the same string starts? Suffixes are
sorted with the cover {1, 2} modulo 3: suffixes at sampled places are named by
their sorted triples, names recurse until they are unique or span `length` bytes,
the remaining suffixes are merged in, and neighbours in the order are compared.

A sieve that loses nothing keeps the sorting to places that can matter, and deals
it out. Of the hashed runs of `gram` bytes inside a string, the one with the least
hash is its anchor, so equal strings have equal anchors at equal distances.
Consecutive strings with one anchor form a stretch. A stretch whose anchor occurs
nowhere else holds no repeated string; stretches with equal bytes are repeated as
a whole, and one of them stands for all; only the different stretches of an anchor
are sent, by the anchor, to be sorted. Anchors with many different stretches are
split first: their stretches are cut into parts by the distance from the anchor, and
the parts that share all bytes which their strings have in common are sorted
together. Where such parts are still too many, they are cut down to single strings,
which are equal or not, by 128 bits of hashes. No task holds an anchor. Texts are
dealt out once to be cut, when those of crowded anchors are kept for these steps.

How rows are dealt out follows a sample of rows: anchors that are frequent there are
spread by content, and rows of a content that is frequent there, so repeated for
certain, are dealt anywhere and returned whole, while one of them stands for all.

Defined results: null texts are empty; texts shorter than `length` bytes lose
nothing; a repeated row's strings are repeated strings, and only one of its rows is
searched. Ids may be null or occur with several texts. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findwell.llm._arrow import as_bytes, bounded_batches, chunks, flat, whole_groups
from findwell.llm.decontamination import _mix, _powers_of
from findwell.llm._rows import sent
from findwell.session import saved

LENGTH, GRAM = 200, 64
#: Bytes of stretches that are sorted together, about.
SORT_BYTES = 1_200_000
#: Different stretches of an anchor beyond which its strings are counted instead of sorted.
SPLIT_STRETCHES = 2_000
#: Strings of a part, at most.
PART = 16
#: One row of so many is sampled; stretches there that make an anchor hot, or a content; parts of a hot anchor.
SAMPLE, HOT_IN_SAMPLE, HOT_CONTENT, SPREAD = 64, 100, 16, 64
_PLACE_BITS = 28
#: Values that three of fit in a key; values and lengths that two of fit.
_NARROW, _WIDE = 1 << 21, 1 << 31
#: Random numbers of bytes, for the second hash of strings.
_BYTE = np.random.default_rng(6).integers(1, 1 << 63, 256, dtype=np.uint64)


# suffix sorting ---------------------------------------------------------------


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their suffixes, up to `depth` symbols; symbols are over 0, values and length below 2^31.

    Suffixes that agree in `depth` symbols stand together in any order.
    """
    n = len(s)
    most = max(n + 2, int(s.max()) if n else 0)
    if most >= _WIDE:
        raise ValueError(f"suffixes of {n} symbols up to {most}: values and length must be below 2^31")
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.zeros(n + 3, np.int64)
    t[:n] = s
    # sampled places; one past the end where it keeps the two thirds apart
    one = np.arange(1, n + (n % 3 == 1), 3)
    two = np.arange(2, n, 3)
    sampled = np.concatenate([one, two])
    third = t[np.minimum(sampled + 2, n + 2)]
    if most < _NARROW:
        key = (t[sampled] << 42) | (t[sampled + 1] << 21) | third
    else:
        key = (np.unique((t[sampled] << 31) | t[sampled + 1], return_inverse=True)[1] << 31) | third
    order = np.argsort(key)
    new = np.empty(len(key), bool)
    new[0] = True
    np.not_equal(key[order[1:]], key[order[:-1]], out=new[1:])
    names = np.empty(len(key), np.int64)
    names[order] = np.cumsum(new)
    if not new.all() and depth > 3:
        order = suffix_order(names, -(-depth // 3))
    rank = np.zeros(n + 3, np.int64)
    rank[sampled[order]] = np.arange(1, len(order) + 1)
    if n % 3 == 1:
        rank[n] = 0
    placed = sampled[order]
    placed = placed[placed < n]
    first, second = placed[placed % 3 == 1], placed[placed % 3 == 2]
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort((t[rest] << 31) | rank[rest + 1], kind="stable")]
    before_one = np.searchsorted((t[first] << 31) | rank[first + 1], (t[rest] << 31) | rank[rest + 1])
    both = np.concatenate([second, rest])
    if most < _NARROW:
        triple = (t[both] << 42) | (t[both + 1] << 21) | rank[both + 2]
    else:
        triple = (np.unique((t[both] << 31) | t[both + 1], return_inverse=True)[1] << 31) | rank[both + 2]
    of_second, of_rest = triple[: len(second)], triple[len(second) :]
    before_two = np.maximum.accumulate(np.searchsorted(np.maximum.accumulate(of_second), of_rest)) if len(rest) else np.empty(0, np.int64)
    before_one = np.maximum.accumulate(before_one)
    out = np.empty(n, np.int64)
    at = np.arange(len(rest)) + before_one + before_two
    free = np.ones(n, bool)
    free[at] = False
    out[at] = rest
    out[free] = placed
    return out


def repeated_starts(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of `starts` begin a string of `length` bytes that another of them begins too.

    data: stretches end to end, symbols over 0 with a 0 after each.
    """
    order = suffix_order(data + 1, length)
    asked = np.zeros(len(data), bool)
    asked[starts] = True
    order = order[asked[order]]
    left, right = order[:-1], order[1:]
    same = np.arange(len(left))
    for k in range(length):
        if not len(same):
            break
        same = same[data[left[same] + k] == data[right[same] + k]]
    found = np.zeros(len(data), bool)
    found[left[same]] = found[right[same]] = True
    return found[starts]


# the sieve --------------------------------------------------------------------


def _hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums for hashes of byte ranges, and the inverse powers."""
    up, down = _powers_of(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return sums, down


def _least(key: np.ndarray, window: int) -> np.ndarray:
    """Least of `window` values from each place on."""
    span = 1
    while 2 * span <= window:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < window:
        key = np.minimum(key[: len(key) - (window - span)], key[window - span :])
    return key


def stretches(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM, salt: int = 0):
    """(row, first start, further starts, anchor hash, bytes hash, anchor's distance) of all stretches of rows laid end to end."""
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none
    sums, down = _hashes(data)
    n = len(data) - gram + 1
    h = _mix((sums[gram:] - sums[:n]) * down[:n] + np.uint64(salt * 0x51ED27 + gram))
    low = np.uint64((1 << _PLACE_BITS) - 1)
    # the last of equal hashes wins
    key = (h & ~low) | (low - np.arange(n, dtype=np.uint64))
    least = _least(key, length - gram + 1)
    anchor = (low - (least & low)).astype(np.int64)
    size = np.diff(off)
    row = np.repeat(np.arange(len(size)), np.maximum(size - length + 1, 0))
    begin = np.maximum(size - length + 1, 0)
    p = np.arange(len(row)) - np.repeat(np.cumsum(begin) - begin, begin) + off[:-1][row]
    if not len(p):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none
    a = anchor[p]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (row[1:] != row[:-1])])
    last = np.r_[new[1:], len(p)] - 1
    first, more, a = p[new], last - new, a[new]
    end = first + more + length
    content = _mix((sums[end] - sums[first]) * down[first] + (a - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + more.astype(np.uint64))
    return row[new], first - off[row[new]], more, h[a], content, a - first


_STRETCH = "anchor bigint, content bigint, doc bigint, first int, more int"


def _find_stretches(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=1 << 19):
            row, first, more, anchor, content, _ = stretches(*flat(batch.column(1)), length, gram)
            if len(row):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(batch.column(0).to_numpy()[row]), pa.array(first.astype(np.int32)), pa.array(more.astype(np.int32))],
                    names=["anchor", "content", "doc", "first", "more"],
                )

    return run


def _sieve(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor and content: repeated stretches (whole), and those to be sorted (not whole).

    Rows stream by. The first row of the present anchor and that of its present
    content go into the next step again, so both may return more than once.
    A repeated stretch returns each of its places and, if its anchor has other
    stretches, one place to be sorted. Rows of hot anchors are spread by their
    content; such anchors are taken to have other stretches elsewhere. Rows of a
    content known to be repeated return at once.
    """
    carried: pa.Table | None = None

    def step(table: pa.Table) -> tuple[pa.RecordBatch | None, pa.Table]:
        if carried is not None:
            table = pa.concat_tables([carried, table])
        table = table.combine_chunks()
        anchor, content = table["anchor"].to_numpy(), table["content"].to_numpy()
        n = len(anchor)
        same_anchor = np.r_[False, anchor[1:] == anchor[:-1]]
        same_content = same_anchor & np.r_[False, content[1:] == content[:-1]]
        whole = same_content.copy()
        whole[:-1] |= same_content[1:]
        begins = ~same_content
        starts = np.flatnonzero(~same_anchor)
        kinds = np.add.reduceat(begins.astype(np.int64), starts)
        opened = begins & (np.repeat(kinds > 1, np.diff(np.r_[starts, n])) | table["hot"].to_numpy())
        take = np.r_[np.flatnonzero(whole), np.flatnonzero(opened)]
        out = None
        if len(take):
            found = table.drop_columns(["hot"]).take(pa.array(take)).append_column("whole", pa.array(np.arange(len(take)) < whole.sum()))
            out = found.combine_chunks().to_batches()[0]
        return out, table.take(pa.array(np.unique([starts[-1], np.flatnonzero(begins)[-1]])))

    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        known = batch.column(batch.schema.get_field_index("known"))
        batch = batch.drop_columns(["known"])
        if known.true_count:
            own = batch.filter(known).drop_columns(["hot"])
            yield own.append_column("whole", pa.array(np.ones(own.num_rows, bool)))
            batch = batch.filter(pa.compute.invert(known))
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= rows:
            out, carried = step(pa.Table.from_batches(held))
            held, count = [], 0
            if out is not None:
                yield out
    if held:
        out, carried = step(pa.Table.from_batches(held))
        if out is not None:
            yield out


_PIECE = "key bigint, doc bigint, first int, more int, bytes binary"


def _cut(length: int):
    """Bytes of the stretches wanted of each text, by their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=1 << 20):
            docs = batch.column(0).to_pylist()
            keys, doc, first, more, data = [], [], [], [], []
            for d, text, wanted in zip(docs, as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                for w in wanted:
                    f, m = w["first"], w["more"]
                    keys.append(w["key"]), doc.append(d), first.append(f), more.append(m), data.append(text[f : f + m + length])
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(doc, pa.int64()), pa.array(first, pa.int32()), pa.array(more, pa.int32()), pa.array(data, pa.binary())], names=["key", "doc", "first", "more", "bytes"])

    return run


def _cut_apart(length: int):
    """As `_cut`, but texts with stretches of crowded anchors return whole, once, with the list of these."""
    cut = _cut(length)
    places = pa.list_(pa.struct([("first", pa.int32()), ("more", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(2).to_pylist()
            lists = [[[w for w in ws if w["crowded"] == c] for ws in wanted] for c in (False, True)]
            kind = batch.schema.field(2).type
            for piece in cut(iter([batch.set_column(2, batch.schema.field(2), pa.array(lists[0], kind))])):
                yield piece.append_column("wanted", pa.nulls(piece.num_rows, places))
            for part in chunks(iter([batch.set_column(2, "wanted", pa.array([[{"first": w["first"], "more": w["more"]} for w in ws] for ws in lists[1]], places)).filter(pa.array([bool(ws) for ws in lists[1]]))])):
                n, text = part.num_rows, part.column(1).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), part.column(0), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), text, part.column(2)], names=["key", "doc", "first", "more", "bytes", "wanted"])

    return run


# crowded anchors ----------------------------------------------------------------


def _expanded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and number of each of `counts` things of owners."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _wanted(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, more) of a column of lists."""
    row = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    inner = column.flatten()
    return row, inner.field("first").to_numpy().astype(np.int64), inner.field("more").to_numpy().astype(np.int64)


def parts(data: np.ndarray, off: np.ndarray, row: np.ndarray, first: np.ndarray, length: int, gram: int, part: int = PART):
    """(row, first start, further starts, key) of the parts of the stretches that start at `first` of `row`.

    Equal strings have their anchor at the same distance, so they are in parts of
    the same number; the key is a hash of the bytes that all strings of such a part
    share, whichever of them the stretch has.
    """
    part = max(1, min(part, length // 8))
    rows, begin, more, anchor, _, distance = stretches(data, off, length, gram)
    kept = np.isin((rows << 32) | begin, (row << 32) | first)
    rows, begin, more, anchor, distance = rows[kept], begin[kept], more[kept], anchor[kept], distance[kept]
    owner, k = _expanded(more + 1)
    number = (distance[owner] - k) // part
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (number[1:] != number[:-1])][: len(owner)])
    size = np.diff(np.r_[new, len(owner)])
    owner, k, number = owner[new], k[new], number[new]
    at = off[rows[owner]] + begin[owner] + distance[owner]
    sums, down = _hashes(data)
    a, b = at - number * part, at - (number + 1) * part + 1 + length
    key = _mix((sums[b] - sums[a]) * down[a] + _mix(anchor[owner] + number.astype(np.uint64)))
    return rows[owner], begin[owner] + k, size - 1, key


def _find_parts(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=1 << 19):
            wanted, starts, _ = _wanted(batch.column(2))
            row, first, more, key = parts(*flat(batch.column(1)), wanted, starts, length, gram)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(batch.column(0).to_numpy()[row]), pa.array(first.astype(np.int32)), pa.array(more.astype(np.int32))], names=["key", "doc", "first", "more"])

    return run


def _find_strings(length: int):
    """Two hashes of every string wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=1 << 19):
            data, off = flat(batch.column(1))
            row, first, more = _wanted(batch.column(2))
            owner, k = _expanded(more + 1)
            start = first[owner] + k
            p = off[row[owner]] + start
            sums, down = _hashes(data)
            other = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTE[data] * _powers_of(len(data) + 1)[0][:-1], out=other[1:])
            pair = [_mix((x[p + length] - x[p]) * down[p]).view(np.int64) for x in (sums, other)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, pair), pa.array(batch.column(0).to_numpy()[row[owner]]), pa.array(start.astype(np.int32))], names=["key", "other", "doc", "first"])

    return run


def _occurring_again(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Rows whose keys other rows have too, with the number of such rows; counts start before the shuffle, so that no key is hot."""
    again = saved(df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), label)
    return df.join(sent(again), keys)


def _with_wanted(docs: DataFrame, rows: DataFrame, *fields: str) -> DataFrame:
    """(doc, text, wanted) of the texts that have `rows`."""
    return docs.join(rows.groupBy("doc").agg(F.collect_list(F.struct(*fields)).alias("wanted")), "doc").select("doc", "text", "wanted")


def _repeated_parts(crowded: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, n, doc, first, more) of the parts of stretches `wanted` of `crowded` (doc, text, wanted) whose shared bytes occur n times."""
    found = saved(crowded.mapInArrow(_find_parts(length, gram), "key bigint, doc bigint, first int, more int"), "parts")
    return saved(_occurring_again(found, ["key"], "repeated-parts"), "parts-again")


def _repeated_strings(docs: DataFrame, parts: DataFrame, length: int) -> DataFrame:
    """(doc, a, b) of the strings of `parts` (doc, first, more) that occur in others of them."""
    strings = saved(_with_wanted(docs, parts, "first", "more").mapInArrow(_find_strings(length), "key bigint, other bigint, doc bigint, first int"), "strings")
    return _occurring_again(strings, ["key", "other"], "repeated-strings").select("doc", F.col("first").alias("a"), (F.col("first") + length).alias("b"))


def _sort(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, "key", rows=SORT_BYTES // (length + 60)):
            raw, off = flat(batch.column(4))
            key = batch.column(0).to_numpy()
            # a key on its own has nothing to compare with
            company = np.zeros(len(key), bool)
            same = key[1:] == key[:-1]
            company[1:] |= same
            company[:-1] |= same
            at = 0
            rows = np.flatnonzero(company)
            while at < len(rows):
                # whole keys up to the bound of a sort; a key alone has `split` stretches at most
                to = at + max(1, int(np.searchsorted(np.cumsum((off[rows[at:] + 1] - off[rows[at:]]) + 1), SORT_BYTES, side="right")))
                if to < len(rows):
                    cut = at + int(np.searchsorted(key[rows[at:to]], key[rows[to]], side="left")) if key[rows[to - 1]] == key[rows[to]] else to
                    to = cut if cut > at else at + int(np.searchsorted(key[rows[at:]], key[rows[at]], side="right"))
                part = rows[at:to]
                at = to
                size = off[part + 1] - off[part]
                stop = np.cumsum(size + 1)
                data = np.full(int(stop[-1]), -1, np.int64)
                source = np.repeat(off[part] - (stop - size - 1), size) + (k := np.flatnonzero(np.bincount(stop - 1, minlength=len(data)) == 0))
                data[k] = raw[source]
                data += 1
                more = batch.column(3).to_numpy()[part].astype(np.int64) + 1
                owner = np.repeat(np.arange(len(part)), more)
                begin = (stop - size - 1)[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(more) - more, more)
                hit = repeated_starts(data, begin, length)
                if not hit.any():
                    continue
                start = batch.column(2).to_numpy()[part][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(more) - more, more)
                edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
                a, b = edge[::2], edge[1::2]
                # runs end with their stretch
                inner = np.flatnonzero(hit[1:] & hit[:-1] & (owner[1:] != owner[:-1])) + 1
                a, b = np.sort(np.r_[a, inner]), np.sort(np.r_[b, inner])
                doc = batch.column(1).to_numpy()[part][owner[a]]
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start[a].astype(np.int32)), pa.array((start[b - 1] + length).astype(np.int32))], names=["doc", "a", "b"])

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, split: int = SPLIT_STRETCHES) -> DataFrame:
    """(doc, a, b) of different rows (doc, text): places [a, b) that repeated strings cover, unmerged."""
    bounded_batches(docs.sparkSession)
    long = docs.where(F.octet_length("text") >= length)
    found = long.mapInArrow(_find_stretches(length, gram), _STRETCH)
    # the sample only sets how rows are dealt
    picked = long.where(F.pmod(F.xxhash64("doc", F.monotonically_increasing_id()), F.lit(SAMPLE)) == 0)
    seen = picked.mapInArrow(_find_stretches(length, gram), _STRETCH).groupBy("anchor", "content").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("doc", "first", "more")))
    seen = saved(seen, "sampled")
    hot = saved(seen.groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_IN_SAMPLE).select("anchor", F.lit(True).alias("hot")), "hot-anchors")
    known = saved(seen.where(F.col("n") >= HOT_CONTENT).drop("n"), "hot-contents")
    found = found.join(sent(known.select("content", F.lit(True).alias("known"))), "content", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    found = found.unionByName(known.withColumn("known", F.lit(False)))
    found = found.join(sent(hot), "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    spread = F.when(F.col("known"), F.xxhash64("doc", "first")).when(F.col("hot"), F.pmod("content", F.lit(SPREAD))).otherwise(F.lit(0))
    dealt = found.select("anchor", "content", "doc", "first", "more", "hot", "known", spread.alias("spread")).repartition("anchor", "spread").sortWithinPartitions("anchor", "content")
    sieved = saved(dealt.drop("spread").mapInArrow(_sieve, _STRETCH + ", whole boolean"), "stretches")
    whole = sieved.where("whole").select("doc", F.col("first").alias("a"), (F.col("first") + F.col("more") + length).alias("b"))
    opened = sieved.where("not whole").select(F.col("anchor").alias("key"), "doc", "first", "more").distinct()
    crowded = saved(opened.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > split).select("key"), "crowded")
    spans = whole
    if crowded.count():
        # all texts are dealt out by their numbers once; those of crowded anchors are kept for what follows
        told = opened.join(sent(crowded.withColumn("crowded", F.lit(True))), "key", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
        apart = saved(_with_wanted(docs, told, "key", "first", "more", "crowded").mapInArrow(_cut_apart(length), f"{_PIECE}, wanted array<struct<first:int,more:int>>"), "pieces")
        few = apart.where(F.col("wanted").isNotNull()).select("doc", F.col("bytes").cast("string").alias("text"), "wanted")
        parts = _repeated_parts(few, length, gram)
        of_parts = _with_wanted(few.drop("wanted"), parts.where(F.col("n") <= split), "key", "first", "more").mapInArrow(_cut(length), _PIECE)
        pieces = apart.where(F.col("wanted").isNull()).drop("wanted").unionByName(of_parts)
        spans = spans.unionByName(_repeated_strings(few.drop("wanted"), parts.where(F.col("n") > split), length))
    else:
        pieces = _with_wanted(docs, opened, "key", "first", "more").mapInArrow(_cut(length), _PIECE)
    sorted_out = pieces.repartition("key").sortWithinPartitions("key").mapInArrow(_sort(length), "doc bigint, a int, b int")
    return saved(sorted_out, "sorted-spans").unionByName(spans)


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _with_spans(docs: DataFrame, length: int, gram: int, split: int, columns: list[str]) -> DataFrame:
    keyed = docs.withColumn("dedup_doc", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), "text"))
    texts = keyed.select(F.col("dedup_doc").alias("doc"), "text")
    again = saved(texts.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc"), "repeated-rows")
    if again.count():
        # of equal rows one is searched, and all of each is repeated
        one = saved(texts.join(sent(again), "doc", "left_semi").groupBy("doc").agg(F.first("text").alias("text")), "one-of-equals")
        spans = repeated_spans(texts.join(sent(again), "doc", "left_anti").unionByName(one), length, gram, split)
        size = F.octet_length("text")
        spans = spans.unionByName(one.where(size >= length).select("doc", F.lit(0).alias("a"), size.alias("b")))
    else:
        spans = repeated_spans(texts, length, gram, split)
    spans = spans.groupBy("doc").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    return keyed.join(spans.withColumnRenamed("doc", "dedup_doc"), "dedup_doc", "left").select(*columns, F.col("spans").alias("dedup_spans"))


def removal(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, split: int = SPLIT_STRETCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (the runs as first byte and end)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    runs = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows = [(_merged(s), t) for s, t in zip(batch.column(2).to_pylist(), as_bytes(batch.column(1)))]
            digest = []
            for spans, text in rows:
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                digest.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for _, t in rows], pa.int64()), pa.array([sum(b - a for a, b in s) for s, _ in rows], pa.int64()), pa.array([len(s) for s, _ in rows], pa.int64()), pa.array(digest), pa.array([[{"a": a, "b": b} for a, b in s] for s, _ in rows], runs)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"],
            )

    joined = _with_spans(docs, length, gram, split, ["doc_id", "text"])
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<struct<a:int,b:int>>")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, split: int = SPLIT_STRETCHES) -> DataFrame:
    """The rows and columns of `docs` with repeated bytes cut out of `text`.

    A character that a run covers only in part stays whole. Null texts stay null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            at_text, at_spans = batch.schema.get_field_index("text"), batch.schema.get_field_index("dedup_spans")
            texts = []
            for text, spans in zip(batch.column(at_text).to_pylist(), batch.column(at_spans).to_pylist()):
                if text is not None and spans:
                    raw, out, at = text.encode(), [], 0
                    for a, b in _merged(spans):
                        while a < b and raw[a] & 0xC0 == 0x80:
                            a += 1
                        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                            b -= 1
                        out.append(raw[at:a])
                        at = b
                    text = b"".join([*out, raw[at:]]).decode()
                texts.append(text)
            cols = [pa.array(texts, pa.string()) if k == at_text else batch.column(k) for k in range(batch.num_columns) if k != at_spans]
            yield pa.RecordBatch.from_arrays(cols, names=[n for n in batch.schema.names if n != "dedup_spans"])

    joined = _with_spans(docs, length, gram, split, docs.columns)
    return joined.mapInArrow(run, docs.schema)


def op6_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return removal(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("removed")


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS t FROM documents),
b AS (SELECT r, p, t FROM d, unnest(range(1, octet_length(t) + 1)) AS q(p)),
s AS (SELECT r, p, CASE WHEN p + {LENGTH - 1} <= octet_length(t) THEN md5(t[p:p + {LENGTH - 1}]) END AS run, hex(t[p:p]) AS x FROM b),
m AS (SELECT r, p, x, run IS NOT NULL AND count(*) OVER (PARTITION BY run) > 1 AS again FROM s),
g AS (SELECT r, p, x, coalesce(p - max(CASE WHEN again THEN p END) OVER (PARTITION BY r ORDER BY p) < {LENGTH}, false) AS gone FROM m),
e AS (SELECT r, p, x, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY p), false) AS opens FROM g),
k AS (SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(x, '' ORDER BY p) FILTER (NOT gone) AS kept FROM e GROUP BY r)
SELECT doc_id, octet_length(t)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN k ON d.r = k.r
"""
