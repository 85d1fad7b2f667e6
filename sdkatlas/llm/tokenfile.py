"""Token ids in binary segments of patched frame-of-reference blocks.

A segment holds whole documents in ascending doc_id order: a header, the documents' ids and lengths, a bit for each null id, the starts of the
blocks, and the blocks. A block of BLOCK ids stores its minimum, packs the differences at the width that PERCENTILE of them need, and lists the high bits of the
others as exceptions. Segments are rows of a table (part, segment, data) that Spark writes to the shared store; parts are ranges of (doc_id, place in
the table), so that rows of one hot id fill many parts.

Null and empty texts have the end id only. Null doc_ids come first. Rows with equal doc_id come as they stand in the table and each keeps its place.
An empty table makes no segment. Only (part, tokens) totals, a row for each part, meet in one task for the running sum.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sdkatlas.llm import common, tokens

BLOCK = 1024
PERCENTILE = 95
SEGMENT = 1 << 19  # ids; a document is never split, so a longer one has a segment of its own
END = 0
MAGIC = b"PFOR2\0"
SEGMENTS = "part int, segment int, tokens long, start long, data binary"
DOCUMENTS = "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long"


def pack_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of BLOCK ids, the last one shorter. Each: u32 minimum, u16 count, u8 width, u16 exceptions; a plane of bits for each place of
    the width, lowest first; the exceptions' u16 places and u32 high bits. Blocks of equal width are packed together."""
    n = -(-len(ids) // BLOCK)
    counts = np.full(n, BLOCK)
    counts[-1] = len(ids) - (n - 1) * BLOCK
    whole = np.concatenate((ids, np.full(n * BLOCK - len(ids), ids[-1], dtype=ids.dtype))).reshape(n, BLOCK)
    least = whole.min(axis=1)
    rest = whole - least[:, None]
    wanted = np.partition(rest, k := (BLOCK - 1) * PERCENTILE // 100, axis=1)[:, k]
    widths = np.ceil(np.log2(wanted.astype(np.float64) + 1)).astype(np.int64)
    out: list[bytes] = [b""] * n
    for width in np.unique(widths).tolist():
        here = np.flatnonzero(widths == width)
        group = rest[here]
        planes = np.empty((len(here), width, BLOCK // 8), dtype=np.uint8)
        for i in range(width):
            planes[:, i] = np.packbits(((group >> np.uint32(i)) & np.uint32(1)).astype(np.uint8), axis=1, bitorder="little")
        high = group >> np.uint32(width) if width < 32 else np.zeros_like(group)
        for row, block in enumerate(here.tolist()):
            places = np.flatnonzero(high[row])
            out[block] = b"".join([struct.pack("<IHBH", int(least[block]), int(counts[block]), width, len(places)), planes[row].tobytes(),
                                   places.astype("<u2").tobytes(), high[row][places].astype("<u4").tobytes()])
    return out


def unpack_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at `starts`."""
    heads = [struct.unpack_from("<IHBH", data, s) for s in starts.tolist()]
    raw = np.frombuffer(data, dtype=np.uint8)
    out = np.zeros((len(heads), BLOCK), dtype=np.uint32)
    widths = np.array([h[2] for h in heads])
    for width in np.unique(widths).tolist():
        here = np.flatnonzero(widths == width)
        if width:
            size = width * BLOCK // 8
            packed = np.stack([raw[s + 9:s + 9 + size] for s in starts[here].tolist()]).reshape(len(here), width, BLOCK // 8)
            group = np.zeros((len(here), BLOCK), dtype=np.uint32)
            for i in range(width):
                group |= np.unpackbits(packed[:, i], axis=1, bitorder="little").astype(np.uint32) << np.uint32(i)
            out[here] = group
    for row, ((least, _, width, outliers), at) in enumerate(zip(heads, starts.tolist(), strict=True)):
        if outliers:
            at += 9 + width * BLOCK // 8
            out[row][np.frombuffer(data, "<u2", outliers, at)] |= np.frombuffer(data, "<u4", outliers, at + 2 * outliers) << np.uint32(width)
        out[row] += np.uint32(least)
    last = heads[-1][1] if heads else 0
    return out.reshape(-1)[:max(0, len(heads) - 1) * BLOCK + last]


def pack_segment(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """ids: of each document, as little-endian unsigned 32-bit integers."""
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    blocks = pack_blocks(flat) if len(flat) else []
    starts = np.cumsum([0, *map(len, blocks)])[:-1].astype("<u8")
    names = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    nameless = np.packbits(np.array([d is None for d in doc_ids], dtype=np.uint8), bitorder="little")
    lengths = np.array([len(x) // 4 for x in ids], dtype="<u8")
    return b"".join([MAGIC, struct.pack("<QQQ", len(names), len(flat), len(blocks)), names.tobytes(), lengths.tobytes(), nameless.tobytes(), starts.tobytes(), *blocks])


def unpack_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths, all ids."""
    if data[:6] != MAGIC:
        raise ValueError("not a token segment")
    docs, total, blocks = struct.unpack_from("<QQQ", data, 6)
    at = 30
    names = np.frombuffer(data, "<i8", docs, at)
    lengths = np.frombuffer(data, "<u8", docs, at + 8 * docs)
    at += 16 * docs
    nameless = np.unpackbits(np.frombuffer(data, np.uint8, -(-docs // 8), at), count=docs, bitorder="little")
    at += -(-docs // 8)
    starts = np.frombuffer(data, "<u8", blocks, at)
    ids = unpack_blocks(data, starts.astype(np.int64) + (at + 8 * blocks))
    if len(ids) != total or lengths.sum() != total:
        raise ValueError("a token segment is not whole")
    return [None if no else int(d) for d, no in zip(names, nameless, strict=True)], lengths.astype(np.int64), ids


def to_segments(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Encode doc_id, text rows and write their segments; returns the written table."""
    end = END.to_bytes(4, "little")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, segment, start, names, held, size = TaskContext.get().partitionId(), 0, 0, [], [], 0
        encode = tokens.encoder(tokenizer)

        def row() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "segment": [segment], "tokens": [size], "start": [start], "data": [pack_segment(names, held)]})

        for batch in batches:
            for name, text in zip(batch["doc_id"], batch["text"], strict=True):
                names.append(None if pd.isna(name) else int(name))
                held.append(encode.ids(text) + end)
                size += len(held[-1]) // 4
                if size >= SEGMENT:
                    yield row()
                    segment, start, names, held, size = segment + 1, start + size, [], [], 0
        if names:
            yield row()

    placed = documents.select("doc_id", "text", F.monotonically_increasing_id().alias("place"))
    ordered = placed.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").drop("place")
    return common.saved(ordered.mapInPandas(write, SEGMENTS), "tokens")


def read_documents(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the segments alone."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, first, data in zip(batch["part"], batch["start"], batch["data"], strict=True):
                names, lengths, ids = unpack_segment(data)
                raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(lengths)
                crc = [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": pd.array(names, dtype="Int64"), "part": part, "local_start": first + ends - lengths, "n_tokens": lengths, "ids_crc32": crc})

    totals = segments.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = totals.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("before"))
    rows = segments.select("part", "start", "data").mapInPandas(read, DOCUMENTS).join(before, "part")
    return rows.select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(to_segments(common.table(spark, sf_dir, "documents"), tokens.default_path()))
