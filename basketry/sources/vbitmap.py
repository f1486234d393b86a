"""Binary vertical bitmaps: a header, then one fixed-width record of bits for each item.

Layout, little-endian: transactions and items (both 4 or both 8 bytes wide), then per item an int32 id, an int32 slot
that readers ignore, and ceil(n / 16) uint16 words; transaction t is bit t % 16 of word t div 16.

Such a file holds items x transactions bits, however few are set. A packed file grows with the words that have bits: the
eight bytes of ``PACKED``, transactions and items (8 bytes each), per item an int32 id, a uint32 number of words, their
places (uint32) and the words (uint16), and at the end each record's place in the file (8 bytes). A record that would be
longer than all its words has ``SLOT`` for a number and all words, without places.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from basketry.sources.files import mounted

SLOT = 0xFFFFFFFF
SCHEMA = "item int, support long, words binary"
PACKED = b"\x93vbits\r\n"
#: Bytes of words that a reader hands on at once.
_BATCH = 8 << 20


def record_size(n_tids: int) -> int:
    return 8 + 2 * (-(-n_tids // 16))


def parse_header(head: bytes, size: int) -> tuple[int, int, int]:
    """(width, transactions, items); the width is the one for which the file has the right size."""
    for width, form in ((4, "<II"), (8, "<QQ")):
        if len(head) >= 2 * width:
            n, m = struct.unpack_from(form, head)
            if size == 2 * width + m * record_size(n):
                return width, n, m
    raise ValueError("not a vertical bitmap file: its size fits neither header width")


def pack_record(item: int, places: np.ndarray, words: np.ndarray, n_tids: int) -> bytes:
    """The packed record of an item with ``words`` at ``places``, ascending."""
    n_words = -(-n_tids // 16)
    if 3 * len(places) < n_words:
        return struct.pack("<iI", item, len(places)) + places.astype("<u4").tobytes() + words.astype("<u2").tobytes()
    full = np.zeros(n_words, "<u2")
    full[places] = words
    return struct.pack("<iI", item, SLOT) + full.tobytes()


def _packed(source, n_tids: int, count: int) -> Iterator[tuple[int, int, Callable[[], bytes]]]:
    """(item, support, its dense words when called for) of the next ``count`` packed records."""
    n_words = -(-n_tids // 16)
    for _ in range(count):
        item, k = struct.unpack("<iI", source.read(8))
        places = None if k == SLOT else np.frombuffer(source.read(4 * k), "<u4")
        words = np.frombuffer(source.read(2 * (n_words if k == SLOT else k)), "<u2")

        def dense(places=places, words=words) -> bytes:
            if places is None:
                return words.tobytes()
            full = np.zeros(n_words, "<u2")
            full[places] = words
            return full.tobytes()

        yield item, int(np.bitwise_count(words).sum()), dense


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class VBitmapDataSource(DataSource):
    """``spark.read.format("vbitmap").load(path)`` with ``path``, a file or a folder of files, on a file system that every executor mounts.

    Partitions are ranges of items, each read by one seek. For object stores use :func:`read_vbitmap`. Writing
    ``(item, record)`` with the option ``n_tids`` gives one file a task; mode ``append`` adds files. With the option
    ``packed`` the records are packed ones. Files of both kinds may lie in a folder. Read with a schema of ``item`` and
    ``support`` alone, no words are made.
    """

    @classmethod
    def name(cls) -> str:
        return "vbitmap"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


def _files(path: str) -> list[str]:
    return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".bin")) if os.path.isdir(path) else [path]


def _header(path: str) -> tuple[int, int, int]:
    """(width, transactions, items), the width 0 for a packed file."""
    with open(path, "rb") as f:
        head = f.read(24)
        return (0, *struct.unpack_from("<QQ", head, 8)) if head.startswith(PACKED) else parse_header(head[:16], f.seek(0, 2))


class _Reader(DataSourceReader):
    def __init__(self, options, schema):
        self.path = mounted(options["path"])
        self.splits = int(options.get("splits", "8"))
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def partitions(self):
        sizes = [(path, _header(path)[2]) for path in _files(self.path)]
        step = max(1, -(-sum(m for _, m in sizes) // self.splits))
        return [_Range(path, i, min(m, i + step)) for path, m in sizes for i in range(0, m, step)] or [_Range("", 0, 0)]

    def _records(self, partition) -> Iterator[tuple[int, int, Callable[[], bytes]]]:
        width, n, m = _header(partition.path)
        size = record_size(n)
        with open(partition.path, "rb") as f:
            if not width:
                f.seek(8 * (partition.start - m), os.SEEK_END)
                f.seek(*struct.unpack("<Q", f.read(8)))
                yield from _packed(f, n, partition.stop - partition.start)
                return
            f.seek(2 * width + partition.start * size)
            for _ in range(partition.start, partition.stop):
                record = f.read(size)
                words = record[8:]
                yield struct.unpack_from("<i", record)[0], int(np.bitwise_count(np.frombuffer(words, np.uint8)).sum()), lambda words=words: words

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.stop:
            return
        names, kinds = self.schema.names, {"item": pa.int32(), "support": pa.int64(), "words": pa.binary()}
        held, size = {c: [] for c in names}, 0
        for item, support, words in self._records(partition):
            row = {"item": item, "support": support} | ({"words": words()} if "words" in names else {})
            for c in names:
                held[c].append(row[c])
            size += 64 + len(row.get("words", b""))
            if size >= _BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(held[c], kinds[c]) for c in names], names)
                held, size = {c: [] for c in names}, 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(held[c], kinds[c]) for c in names], names)


@dataclass
class _Part(WriterCommitMessage):
    hidden: str | None


class _Writer(DataSourceWriter):
    """Tasks write hidden files, so that a lost or repeated task leaves nothing to be read; the commit names them."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = mounted(options["path"]), overwrite
        self.n_tids, self.width = int(options["n_tids"]), int(options.get("width", "8"))
        self.packed = str(options.get("packed", "false")).lower() == "true"

    def write(self, iterator) -> _Part:
        os.makedirs(self.path, exist_ok=True)
        hidden, m = os.path.join(self.path, f".{uuid.uuid4().hex}.bin.tmp"), 0
        with open(hidden, "wb") as f:
            f.write(PACKED + b"\0" * 16 if self.packed else b"\0" * (2 * self.width))
            starts = array("Q")
            for row in iterator:
                if self.packed:
                    starts.append(f.tell())
                f.write(row["record"])
                m += 1
            f.write(np.asarray(starts, "<u8").tobytes())
            f.seek(len(PACKED) if self.packed else 0)
            f.write(struct.pack("<QQ", self.n_tids, m) if self.packed else struct.pack("<II" if self.width == 4 else "<QQ", self.n_tids, m))
        if not m:
            os.remove(hidden)
        return _Part(hidden if m else None)

    def commit(self, messages) -> None:
        os.makedirs(self.path, exist_ok=True)
        if self.overwrite:
            for path in _files(self.path):
                os.remove(path)
        for message in messages:
            if message is not None and message.hidden:
                folder, name = os.path.split(message.hidden)
                os.replace(message.hidden, os.path.join(folder, name.removeprefix(".").removesuffix(".tmp")))

    def abort(self, messages) -> None:
        for message in messages:
            if message is not None and message.hidden and os.path.exists(message.hidden):
                os.remove(message.hidden)


def read_vbitmap(spark: SparkSession, path: str) -> DataFrame:
    """(item, support, words) through Spark's own file reader, so any store that Spark reads will do. A file is one task."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                if content.startswith(PACKED):
                    n, m = struct.unpack_from("<QQ", content, 8)
                    records = _packed(io.BytesIO(memoryview(content)[24:]), n, m)
                    step = max(1, min(4096, _BATCH // record_size(n)))
                    while block := list(islice(records, step)):
                        yield pd.DataFrame({"item": np.array([x[0] for x in block], np.int32), "support": [x[1] for x in block], "words": [x[2]() for x in block]})
                    continue
                width, n, m = parse_header(content[:16], len(content))
                size = record_size(n)
                step = max(1, min(4096, _BATCH // size))
                for start in range(0, m, step):
                    stop = min(m, start + step)
                    block = np.frombuffer(content, np.uint8, (stop - start) * size, 2 * width + start * size).reshape(-1, size)
                    yield pd.DataFrame({
                        "item": np.ascontiguousarray(block[:, :4]).view("<i4")[:, 0],
                        "support": np.bitwise_count(block[:, 8:]).sum(axis=1).astype(np.int64),
                        "words": [x.tobytes() for x in block[:, 8:]],
                    })

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, SCHEMA)


def to_baskets(vertical: DataFrame) -> DataFrame:
    """(tid, item) of the set bits."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for item, words in zip(pdf["item"], pdf["words"]):
                tids = np.flatnonzero(np.unpackbits(np.frombuffer(words, np.uint8), bitorder="little"))
                yield pd.DataFrame({"tid": tids.astype(np.int64), "item": np.full(len(tids), item, np.int32)})

    return vertical.select("item", "words").mapInPandas(explode, "tid long, item int")


def vertical_records(words: DataFrame, n_tids: int, catalog: DataFrame | None = None) -> DataFrame:
    """(item, record) from (item, word_idx, word). With a ``catalog`` of items those without transactions stay, as zeros."""
    n_words = -(-n_tids // 16)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(n_words, "<u2")
        known = pdf["word_idx"].notna()
        bits[pdf["word_idx"][known].astype(int)] = pdf["word"][known].astype(int)
        item = int(pdf["item"].iloc[0])
        return pd.DataFrame({"item": [item], "record": [struct.pack("<iI", item, SLOT) + bits.tobytes()]})

    full = words if catalog is None else catalog.select("item").distinct().join(words, "item", "left").select("item", "word_idx", "word")
    return full.groupBy("item").applyInPandas(pack, "item int, record binary")


def packed_records(words: DataFrame, n_tids: int, catalog: DataFrame | None = None) -> DataFrame:
    """(item, record) as :func:`vertical_records` gives it, the records packed."""
    full = words if catalog is None else catalog.select("item").distinct().join(words, "item", "left").select("item", "word_idx", "word")
    held = F.array_sort(F.collect_list(F.when(F.col("word_idx").isNotNull(), F.struct(F.col("word_idx").cast("long").alias("at"), F.col("word").cast("int").alias("word")))))
    rows = full.groupBy("item").agg(held.alias("held")).select("item", F.col("held.at").alias("places"), F.col("held.word").alias("words"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first in range(0, len(pdf), 64):
                part = pdf.iloc[first : first + 64]
                yield pd.DataFrame({"item": part["item"], "record": [pack_record(int(i), np.asarray(p, np.int64), np.asarray(w, np.int64), n_tids) for i, p, w in zip(part["item"], part["places"], part["words"])]})

    return rows.mapInPandas(pack, "item int, record binary")


def write_vbitmaps(words: DataFrame, n_tids: int, path: str, catalog: DataFrame | None = None, width: int = 8, mode: str = "overwrite", packed: bool = False) -> None:
    """Write a folder of files, one a task; with mode ``append`` beside those there. Items must not be in the folder yet."""
    words.sparkSession.dataSource.register(VBitmapDataSource)
    records = (packed_records if packed else vertical_records)(words, n_tids, catalog)
    records.write.format("vbitmap").mode(mode).option("n_tids", n_tids).option("width", width).option("packed", packed).save(path)


def write_vbitmap(words: DataFrame, n_tids: int, path: str, catalog: DataFrame | None = None, width: int = 8) -> int:
    """Write one file through the driver, record by record; returns the number of items."""
    records = vertical_records(words, n_tids, catalog)
    m = 0
    with open(mounted(path), "wb") as f:
        f.write(b"\0" * (2 * width))
        for row in records.orderBy("item").toLocalIterator():
            f.write(row["record"])
            m += 1
        f.seek(0)
        f.write(struct.pack("<II" if width == 4 else "<QQ", n_tids, m))
    return m


def lookup(vertical: DataFrame, item: int) -> DataFrame:
    """Point lookup of one item's vector; on Parquet the filter reaches the scan."""
    return vertical.filter(F.col("item") == item)
