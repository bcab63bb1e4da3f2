"""Filters of bounded size that tell at the scan which rows a later exact join can't use."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import importable, tidy

CHUNK = 4096  # bytes of a filter in a row
PART_BITS = 32768  # of one part of a bitmap: what bitmap_construct_agg makes


class Bloom:
    """A filter over hashed keys: `bits` is a power of two, four places a key."""

    def __init__(self, bits: int, data: np.ndarray | None = None) -> None:
        self.bits = bits
        self.data = np.zeros(bits // 8, np.uint8) if data is None else data

    def places(self, keys: np.ndarray) -> list[np.ndarray]:
        x = keys.view(np.uint64)
        with np.errstate(over="ignore"):
            return [(((x ^ (x >> np.uint64(33))) * np.uint64(c)) >> np.uint64(20)) & np.uint64(self.bits - 1) for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)]

    def add(self, keys: np.ndarray) -> None:
        for p in self.places(keys):
            np.bitwise_or.at(self.data, (p >> np.uint64(3)).view(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for p in self.places(keys):
            out &= (self.data[(p >> np.uint64(3)).view(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def gather(keys: DataFrame, max_bits: int) -> Bloom:
    """A filter of a table of distinct keys (one long column): 16 bits a key and at most max_bits, whatever the table holds.

    Tasks set the bits of their keys and send them as rows of CHUNK bytes, which are joined by chunk; the driver gets the filter.
    """
    bits = min(max_bits, max(1 << 16, 1 << (16 * max(1, keys.count())).bit_length()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Bloom(bits)
        for batch in batches:
            bloom.add(batch.column(0).to_numpy())
        rows = bloom.data.reshape(-1, CHUNK)
        used = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(used, pa.int32()), "bits": pa.array([rows[i].tobytes() for i in used], pa.binary())})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts[chunk] = parts.get(chunk, 0) | np.frombuffer(data, np.uint8)
        if parts:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(parts), pa.int32()), "bits": pa.array([x.tobytes() for x in parts.values()], pa.binary())})

    importable(keys.sparkSession)
    schema = "chunk int, bits binary"
    data = np.zeros((bits // 8 // CHUNK, CHUNK), np.uint8)
    with tidy(keys.sparkSession):
        for chunk, part in keys.mapInArrow(fill, schema).repartition(F.col("chunk")).mapInArrow(join, schema).collect():
            data[chunk] = np.frombuffer(bytes(part), np.uint8)
    return Bloom(bits, data.ravel())


def key_filter(keys: DataFrame, key: Column, max_bits: int = 1 << 28) -> tuple[DataFrame, int]:
    """A bitmap of hashed keys as rows (part, bits), and how many parts it has: 16 bits a key, and at most `max_bits` in all."""
    parts = min(max_bits, max(1, 16 * keys.count())) // PART_BITS + 1
    place = F.pmod(key, F.lit(parts * PART_BITS))
    return keys.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")), parts


def passes(rows: DataFrame, key: Column, bitmap: DataFrame, parts: int) -> DataFrame:
    """The rows with `__pass`: whether the bitmap has the bit of their key, as it has for every key that it was made of."""
    place = F.pmod(key, F.lit(parts * PART_BITS))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("__bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    own = F.broadcast(bitmap.select(F.col("part").alias("__part"), F.col("bits").alias("__bits")))
    marked = rows.withColumn("__part", F.bitmap_bucket_number(place)).join(own, "__part", "left")
    return marked.withColumn("__pass", F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))).drop("__part", "__bits")


def rows_of(rows: DataFrame, keys: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows joined with keys (distinct by `on`), inner or left_semi; what a bitmap of the keys shows to have no partner isn't shuffled."""
    key = F.xxhash64(*on)
    return passes(rows, key, *key_filter(keys.select(*on), key)).where("__pass").drop("__pass").join(keys, on, how)


def rows_without(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows whose key isn't in keys (distinct by `on`); only those that a bitmap of the keys lets through are shuffled."""
    key = F.xxhash64(*on)
    told = passes(rows, key, *key_filter(keys.select(*on), key))
    return told.where("not __pass").drop("__pass").unionByName(told.where("__pass").drop("__pass").join(keys, on, "left_anti"))
