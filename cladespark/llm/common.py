"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cladespark.sources.shared import discard, materialized, shared_dir  # noqa: F401  for the operators

#: A word: what stands between space and the five ASCII white-space controls.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that no label may be learnt from. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


class Remembered(dict):
    """key -> made(key), with a bounded memory: what was not asked for while `most` others came is forgotten, and so are
    at once keys longer than `longest`."""

    def __init__(self, made, most: int, longest: int | None = None):
        super().__init__()
        self.made, self.most, self.longest, self.older = made, most, longest, {}

    def __missing__(self, key):
        if self.longest is not None and len(key) > self.longest:
            return self.made(key)
        if (out := self.older.get(key)) is None:
            out = self.made(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = out
        return out


def words_of(text: str | None) -> list[bytes]:
    """The words of WORD, in UTF-8: split() of bytes knows the ASCII white space only."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hash_bytes(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


_held: dict = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """make(), kept by this Python process for later tasks of the same kind until it turns to another kind."""
    if key not in _held:
        _held[key] = make()
    return _held[key]


def trim() -> None:
    """Gives memory that is free back to the machine: Spark keeps Python processes for reuse, and they count with their executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # only glibc has it


def release(kind: str) -> None:
    """Forgets the kept model when the process turns to another kind of task."""
    if _held.get("kind") != kind:
        _held.clear()
        _held["kind"] = kind
        gc.collect()
        trim()


#: Rows, and bytes of their values, that Python works on at once: bounds the memory of what it makes of them (a longer value alone).
ROWS, BYTES = 500, 1 << 20


def _bytes(values: pa.Array) -> np.ndarray:
    """About how many bytes each value has; none for kinds of fixed size."""
    kind = values.type
    if pa.types.is_struct(kind):
        return sum((_bytes(values.field(k)) for k in range(kind.num_fields)), np.zeros(len(values), np.int64))
    if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
        sizes = pc.binary_length(values)
    elif pa.types.is_list(kind) or pa.types.is_large_list(kind):
        sizes = pc.multiply(pc.list_value_length(values), 8)
    else:
        return np.zeros(len(values), np.int64)
    return np.asarray(sizes.cast(pa.int64()).fill_null(0))


def portions(values: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, rows) of portions of at most ROWS values and about BYTES bytes."""
    ends, start = np.cumsum(_bytes(values)), 0
    while start < len(values):
        before = int(ends[start - 1]) if start else 0
        n = min(ROWS, max(1, int(np.searchsorted(ends[start : start + ROWS], before + BYTES, "right"))))
        yield start, n
        start += n


def with_made(df: DataFrame, column: str, fields: str, maker: Callable[[], Callable[[list], list]], drop: bool = False) -> DataFrame:
    """df with new columns (fields: a DDL list; equal names are replaced) that are made of the values of one column (or of a field of a
    struct column: a.b, so that a packed row goes to Python and back once). drop: the column itself does not come back.

    maker runs once in each task and gives a function: values (None where null) -> one list of results for each new column.
    It gets a portion at a time (see portions), however many rows Spark sends at once.
    """
    new = T._parse_datatype_string(fields)
    if any("." in c or "`" in c for c in df.columns):  # Spark looks for them as paths on their way to Python
        at = df.columns.index(column) if column in df.columns else None
        names = [c if "." not in c and "`" not in c else f"__{k}" for k, c in enumerate(df.columns)]
        made = with_made(df.toDF(*names), column if at is None else names[at], fields, maker, drop)
        return made.toDF(*[df.columns[names.index(c)] if c in names and c not in new.names else c for c in made.columns])
    kept = [f for f in df.schema.fields if f.name not in new.names and not (drop and f.name == column)]
    kinds, names, (of, *inside) = [to_arrow_type(f.dataType) for f in new.fields], [f.name for f in kept], column.split(".")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(f"{maker.__module__}.{maker.__qualname__}")
        make = maker()
        for batch in batches:
            every = batch.column(of)
            for field in inside:
                every = every.field(field)
            for k, n in portions(every):
                part = batch.slice(k, n)
                made = make(every.slice(k, n).to_pylist())
                arrays = [part.column(n) for n in names] + [pa.array(m, kind) for m, kind in zip(made, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, [*names, *new.names])
        trim()

    return df.mapInArrow(run, T.StructType([*kept, *new.fields]))


#: Bits of the map that says which keys may be wanted: 8 MB at most, whatever the size of the corpus.
MAP_BITS = 1 << 26


def whole(df: DataFrame, but: str | None = None) -> Column:
    """All columns of df (but one) as a struct: a row packed so cannot clash with what an operator adds beside it."""
    return F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns if c != but])


def marked(rows: DataFrame, key: str, wanted: DataFrame, flag: str) -> DataFrame:
    """rows with the boolean column `flag`: true where the key is in wanted (one column), and for few others. Other columns stay
    as they are, whatever their names. No shuffle of rows: a bit map of bounded size is broadcast."""

    def at(column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(MAP_BITS))

    bits = wanted.select(at(F.col(wanted.columns[0])).alias("at")).select(F.floor(F.col("at") / 4096).alias("line"), F.floor(F.col("at") / 64 % 64).alias("word"), F.expr("shiftleft(1L, int(at % 64))").alias("bit"))
    words = bits.groupBy("line", "word").agg(F.bit_or("bit").alias("bits")).groupBy("line").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))
    packed = rows.select(whole(rows, flag).alias("doc"), at(F.col(key)).alias("at")).withColumn("line", F.floor(F.col("at") / 4096))
    got = packed.join(F.broadcast(words), "line", "left")
    word = F.coalesce(F.try_element_at("words", F.floor(F.col("at") / 64 % 64)), F.lit(0).cast("long"))
    maybe = F.getbit(word, (F.col("at") % 64).cast("int")) == 1
    return got.select("doc.*", maybe.alias(flag))


def maybe_among(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    return marked(rows, key, wanted, "__maybe").where("__maybe").drop("__maybe")


def without(rows: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """rows whose key is not in dropped (one column); only rows that may be dropped are shuffled. A null key is in nothing.
    All columns stay, whatever their names."""
    both = marked(rows.select(whole(rows).alias("doc"), F.col(key).alias("key")), "key", dropped, "maybe")
    rest = both.where("maybe").join(dropped.toDF("gone").distinct(), F.col("key") == F.col("gone"), "left_anti")
    return both.where(~F.col("maybe")).select("doc.*").unionByName(rest.select("doc.*"))
