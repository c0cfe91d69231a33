"""Chroma fingerprints of audio columns, and alignment of recordings.

Samples become overlapping windowed spectra, folded into twelve pitch classes per
frame. Filters compare sums over rectangles of the time-by-class picture, read off
its integral image; each gives two bits, sixteen of them one packed 32-bit integer
per frame. Recordings that share integers vote for the offset between them, and the
bits that differ at the best offset decide whether they match.

Recordings with equal fingerprints form a class; one member of it is compared and
all its links are returned by class. Nothing caps a bucket or a partner; integers
that many recordings share make a large group in a join, which Spark splits at
run time. A link needs a few equal integers: recordings whose bits differ within
the limit but evenly over all integers are not linked.

Defined results: null, empty and too short media have no fingerprint and match
nothing. An odd last byte is ignored. Silence has fingerprints like any other
sound. Ids may repeat; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findwell.llm._arrow import bounded_batches
from findwell.session import saved

RATE, FRAME, HOP = 4000, 512, 256
CLASSES, LOWEST, HIGHEST = 12, 80.0, 1800.0
#: Frames that a filter spans at most; a recording needs as many.
SPAN = 12
#: Shared integers that an offset needs, frames of an overlap, share of bits that may differ.
VOTES, OVERLAP, BIT_ERROR = 3, 20, 0.2


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """(frames, 12) shares of the pitch classes of mono samples."""
    n = 1 + (len(samples) - FRAME) // HOP
    if n < 1:
        return np.zeros((0, CLASSES))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP][:n]
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME), axis=1)) ** 2
    out = power @ _fold(rate)
    total = out.sum(1, keepdims=True)
    return np.where(total > 1e-9, out / np.maximum(total, 1e-9), 1.0 / CLASSES)


def _fold(rate: int) -> np.ndarray:
    """Weights from spectrum bins to pitch classes; a bin is shared by the two classes next to it."""
    f = np.fft.rfftfreq(FRAME, 1 / rate)
    table = np.zeros((len(f), CLASSES))
    for k in np.flatnonzero((f >= LOWEST) & (f <= HIGHEST)):
        x = CLASSES * np.log2(f[k] / 440.0)
        low = int(np.floor(x))
        table[k, low % CLASSES] += 1 - (x - low)
        table[k, (low + 1) % CLASSES] += x - low
    return table


def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames) of the sixteen filters, by rule."""
    out = []
    for k in range(16):
        width = (4, 8, 12)[k % 3]
        height = (2, 3, 4, 6)[k % 4]
        out.append((k % 4, (5 * k) % (CLASSES - height + 1), height, width))
    return out


def packed(picture: np.ndarray) -> np.ndarray:
    """One 32-bit integer for each place where the filters fit on a (frames, 12) picture."""
    n = len(picture) - SPAN + 1
    if n < 1:
        return np.empty(0, np.uint32)
    image = np.zeros((len(picture) + 1, CLASSES + 1))
    image[1:, 1:] = picture.cumsum(0).cumsum(1)

    def area(t: int, w: int, c: int, h: int) -> np.ndarray:
        return image[t + w : t + w + n, c + h] - image[t : t + n, c + h] - image[t + w : t + w + n, c] + image[t : t + n, c]

    out = np.zeros(n, np.uint32)
    for kind, c, h, w in _filters():
        whole, half, third = area(0, w, c, h), w // 2, w // 4
        if kind == 0:  # a band against all classes
            part, rest = whole, area(0, w, 0, CLASSES) / CLASSES * h
        elif kind == 1:  # earlier against later
            part = area(0, half, c, h)
            rest = whole - part
        elif kind == 2:  # lower classes against higher ones
            part = area(0, w, c, h // 2)
            rest = (whole - part) * (h // 2) / max(1, h - h // 2)
        else:  # the middle of the time against its sides
            part = area(third, half, c, h)
            rest = whole - part
        value = np.log((part + 0.02) / (rest + 0.02))
        level = (value > -0.35).astype(np.uint32) + (value > 0) + (value > 0.35)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1))).astype(np.uint32)  # neighbouring levels differ in a bit
    return out


def fingerprint(media: bytes | None, rate: int = RATE) -> np.ndarray:
    """The integers of 16-bit little-endian mono samples."""
    if not media:
        return np.empty(0, np.uint32)
    return packed(chroma(np.frombuffer(media[: len(media) // 2 * 2], "<i2").astype(np.float64) / 32768.0, rate))


def fingerprints(media: DataFrame, id_col: str, media_col: str, rate: int = RATE) -> DataFrame:
    """(id, prints): the integers of each recording as array<int>."""
    bounded_batches(media.sparkSession, 256)
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(m, rate).view(np.int32) for m in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.list_(pa.int32()))], names=["id", "prints"])

    return media.select(media[id_col].alias("id"), media[media_col].alias("media")).mapInArrow(run, f"id {kind}, prints array<int>")


def align(prints: DataFrame, queries: DataFrame, votes: int = VOTES, overlap: int = OVERLAP, bit_error: float = BIT_ERROR) -> tuple[DataFrame, DataFrame]:
    """(members, matches) of recordings (id, prints) for queries (id).

    members: (id, class_id), the class of equal fingerprints named by its least id.
    matches: (query_class, class_id, offset, n_votes, n_frames, bit_error) of the
    classes of the queries and all others that align; offset is how many frames
    later the query's sound comes in the other.
    """
    prints = prints.where(F.size("prints") > 0)
    classes = saved(prints.groupBy("prints").agg(F.min("id").alias("class_id")), "print-classes")
    members = prints.join(classes, "prints").select("id", "class_id")
    members = saved(members, "print-members")
    asked = members.join(queries.select("id").distinct(), "id", "left_semi").select("class_id").distinct()
    frames = classes.select("class_id", F.posexplode("prints").alias("at", "code"))
    own = frames.join(asked, "class_id", "left_semi").select(F.col("class_id").alias("query_class"), F.col("at").alias("query_at"), "code")
    # equal integers in a row of one recording vote together
    voted = own.join(frames, "code").where("query_class <> class_id").groupBy("query_class", "class_id", (F.col("at") - F.col("query_at")).alias("offset")).agg(F.count("*").alias("n_votes"))
    # every offset with enough votes is tested; of those that pass, a pair keeps the one with most votes
    found = voted.where(F.col("n_votes") >= votes)
    a = classes.select(F.col("class_id").alias("query_class"), F.col("prints").alias("a"))
    b = classes.select("class_id", F.col("prints").alias("b"))
    found = found.join(a, "query_class").join(b, "class_id")
    first, second = F.greatest(-F.col("offset"), F.lit(0)), F.greatest(F.col("offset"), F.lit(0))
    length = F.least(F.size("a") - first, F.size("b") - second)
    found = found.withColumn("n_frames", length).where(F.col("n_frames") >= overlap)
    pairs = F.arrays_zip(F.slice("a", first + 1, F.col("n_frames")).alias("x"), F.slice("b", second + 1, F.col("n_frames")).alias("y"))
    wrong = F.aggregate(pairs, F.lit(0), lambda n, p: n + F.bit_count(p["x"].bitwiseXOR(p["y"])))
    found = found.withColumn("bit_error", wrong / (F.col("n_frames") * 32.0)).where(F.col("bit_error") <= bit_error)
    best = Window.partitionBy("query_class", "class_id").orderBy(F.col("n_votes").desc(), F.abs("offset"), "offset")
    found = found.select("query_class", "class_id", "offset", "n_votes", "n_frames", "bit_error").withColumn("nth", F.row_number().over(best))
    return members, found.where("nth = 1").drop("nth")


def melody(values: np.ndarray, note: int = HOP) -> bytes:
    """A vector as sound: one note for each value, from 220 to 880 Hz by its share of the largest."""
    v = np.nan_to_num(np.asarray(values, np.float64))
    if not len(v):
        return b""
    top = np.abs(v).max()
    pitch = 440.0 * np.exp2(v / top if top > 0 else v)
    phase = np.cumsum(np.repeat(pitch, note) / RATE) * 2 * np.pi
    return (np.sin(phase) * 20000).astype("<i2").tobytes()


def melodies(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, media): the rows' vectors as recordings; null vectors have null media."""
    bounded_batches(vectors.sparkSession, 256)
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = [None if v is None else melody([x if x is not None else 0.0 for x in v]) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], names=["id", "media"])

    return vectors.select(vectors[id_col].alias("id"), vectors[vector_col].alias("v")).mapInArrow(run, f"id {kind}, media binary")


def op5_audio_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Recordings made of `embeddings` (the tables hold no media): each id with its class, number of integers, and, of the classes asked for (ids divisible by 20), the classes that align as an array."""
    prints = saved(fingerprints(melodies(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "id", "media"), "prints")
    members, matches = align(prints, prints.where("id % 20 = 0"))
    links = matches.groupBy("query_class").agg(F.sort_array(F.collect_list(F.struct("class_id", "offset", "n_votes", "n_frames", F.round("bit_error", 6).alias("bit_error")))).alias("links"))
    out = prints.select(F.col("id").alias("vec_id"), F.size("prints").cast("bigint").alias("n_prints"), "id").join(members, "id", "left")
    joined = out.join(links, out["class_id"] == links["query_class"], "left")
    n = F.coalesce(F.size("links"), F.lit(0))
    return joined.select("vec_id", "n_prints", "class_id", F.when(n > 0, n).otherwise(0).cast("bigint").alias("n_links"), "links")
