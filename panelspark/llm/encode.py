"""Encoding of a corpus with a public tokenizer, by forced-boundary splitting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import one_per_key
from .vocabulary import FOLDER, FRAGMENT_BYTES, VOCABULARY, vocabulary

#: Bytes from which the fragments of one text are spread over tasks.
SPREAD_BYTES = 1 << 20


def one_per_document(docs: DataFrame, key: str) -> DataFrame:
    """docs without null keys, one row per key.

    Repeated keys are looked for in the key column alone; only if there are any do the whole rows move.
    """
    docs = docs.filter(F.col(key).isNotNull())
    repeated = docs.groupBy(key).count().filter("count > 1").limit(1).count()
    return one_per_key(docs, [key]) if repeated else docs


def any_long(docs: DataFrame, text: str, spread_bytes: int) -> bool:
    """Whether a text has spread_bytes or more: where none has, the way for those is left out of the plan, with its reads."""
    return bool(docs.filter(F.octet_length(text) >= spread_bytes).limit(1).count())


def _id_lists(encoded: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(e) for e in encoded)])
    flat = np.concatenate(encoded) if encoded else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def _by_batch(column: str, make, keep: list[str], name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):  # bounds the ids held at a time
                part = b.slice(i, 256)
                made = make(part.column(column).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), made], [*keep, name])

    return run


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = VOCABULARY, folder: str = FOLDER, fragment_bytes: int = FRAGMENT_BYTES, spread_bytes: int = SPREAD_BYTES) -> DataFrame:
    """(key, ids array<int>): the ids of each text, without special tokens, whose strings are ordinary text.

    An empty or null text gives an empty list. Texts are cut at certain cuts (see Vocabulary) into fragments that are
    encoded independently; the fragments of texts from spread_bytes on are encoded in different tasks and put together
    in order. Rows with a null key are left out; a key that occurs in several rows comes out once; other columns are
    not looked at; an empty table gives an empty result.
    """
    base = one_per_document(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key")
    kind = base.schema["key"].dataType.simpleString()
    size = F.octet_length("text")
    here = _by_batch("text", lambda texts: _id_lists([vocabulary(name, folder).encode_by_fragments(t, fragment_bytes) for t in texts]), ["key"], "ids")
    schema = f"key {kind}, ids array<int>"
    if not any_long(base, "text", spread_bytes):
        return base.mapInArrow(here, schema).withColumnRenamed("key", key)
    whole = base.filter(F.col("text").isNull() | (size < spread_bytes)).mapInArrow(here, schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(name, folder)
        for b in batches:
            for i in range(b.num_rows):
                parts = v.fragments(b.column("text")[i].as_py(), fragment_bytes)
                for j in range(0, len(parts), 64):
                    some = parts[j : j + 64]
                    yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array([i] * len(some))), pa.array(range(j, j + len(some)), pa.int32()), pa.array(some, pa.string())], ["key", "part", "text"])

    fragments = base.filter(size >= spread_bytes).mapInArrow(cut, f"key {kind}, part int, text string")
    spread = fragments.repartition("key", "part")
    pieces = spread.mapInArrow(_by_batch("text", lambda texts: _id_lists([vocabulary(name, folder).encode(t) for t in texts]), ["key", "part"], "ids"), f"key {kind}, part int, ids array<int>")
    joined = pieces.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("p"))
    joined = joined.select("key", F.flatten(F.col("p.ids")).alias("ids"))
    return whole.unionByName(joined).withColumnRenamed("key", key)


def count_tokens(docs: DataFrame, keep: list[str], text: str = "text", name: str = VOCABULARY, folder: str = FOLDER) -> DataFrame:
    """(keep..., n_tokens int): the number of ids of each text; 0 for an empty or null one."""
    base = docs.select(*keep, F.col(text).alias("_text"))
    fields = ", ".join(f"{c} {kind}" for c, kind in base.drop("_text").dtypes)
    count = _by_batch("_text", lambda texts: pa.array([len(vocabulary(name, folder).encode_by_fragments(t)) for t in texts], pa.int32()), keep, "n_tokens")
    return base.mapInArrow(count, f"{fields}, n_tokens int")
