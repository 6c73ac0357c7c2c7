"""Encoding a corpus with a public tokenizer, and decoding it (p7).

The words (pre-tokens) of all texts are counted, with counts combined before the shuffle; each distinct word of the corpus is encoded once. Then
every text is taken apart again and the ids of its words are put in their places. The most frequent words, up to a bound in bytes, are looked up
beside the text; only occurrences of rarer words are shuffled, with their places, to the dictionary and back, so no word is hot in that shuffle.
A corpus whose whole dictionary stays below the bound has no such occurrences. Both steps are one plan and give the same rows at any bound.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stages, spread

#: Where the vocabulary files lie; only the driver reads them.
TOKENIZERS = "/opt/tokenizers"
#: The most frequent words are looked up in place as long as they and their ids have no more than so many bytes.
DICTIONARY_BYTES = 16 << 20
#: Distinct words that a task counts before it hands them on, and ids or words in one batch of its output.
COUNTED, BATCH = 200_000, 1_000_000

# Fixed value: the pattern of the byte-level vocabularies; and what it comes to on ASCII text, where a simpler engine can follow it.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_ANY = regex.compile(PATTERN)
_ASCII = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)


def ranks(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> dict[bytes, int]:
    """The vocabulary as bytes -> id."""
    lines = Path(folder, f"{name}.tiktoken").read_bytes().splitlines()
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}


@lru_cache(maxsize=4)
def _encoding(raw: bytes):
    """An encoder that takes a text as one word."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x)}
    return tiktoken.Encoding("vocabulary", pat_str=r"[\s\S]+", mergeable_ranks=table, special_tokens={})


def words(text: str) -> list[str]:
    """The words of a text in order."""
    return (_ASCII if text.isascii() else _ANY).findall(text)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n: how often each distinct word occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], ["word", "n"])
        for b in batches:
            for t in b.column(0):
                c.update(words(t.as_py() or ""))
                if len(c) >= COUNTED:
                    yield out()
                    c.clear()
        yield out()

    return spread(docs.select(text), text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(counted: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """word, n, ids: each distinct word encoded once."""
    raw = counted.sparkSession.sparkContext.broadcast(Path(folder, f"{name}.tiktoken").read_bytes())  # the vocabulary's size is fixed

    def encode_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _encoding(raw.value).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([one(w) for w in b.column(0).to_pylist()], pa.list_(pa.int32()))], ["word", "n", "ids"])

    return counted.select("word", "n").mapInArrow(encode_, "word string, n long, ids array<int>")


def _frequent(table: DataFrame) -> tuple[dict[str, bytes], bool]:
    """(ids, as bytes, of all words that occur at least so often that these stay below the bound, whether that is all words)."""
    size = F.octet_length("word") + 4 * F.size("ids") + 48
    level = F.floor(F.log2("n")).cast("int")
    levels = sorted(table.groupBy(level.alias("l")).agg(F.sum(size).alias("s")).collect(), reverse=True)  # one row per power of two
    total, least = 0, None
    for r in levels:
        total += r["s"]
        if total > DICTIONARY_BYTES:
            break
        least = r["l"]
    if least is None:
        return {}, not levels
    # of a proven size
    rows = table.filter(F.col("n") >= 2**least).select("word", "ids").toArrow()
    return {w: np.array(i, np.int32).tobytes() for w, i in zip(rows.column("word").to_pylist(), rows.column("ids").to_pylist())}, total <= DICTIONARY_BYTES


def _place(docs: DataFrame, keep: list[str], text: str, name: str, folder: str, ids: bool) -> DataFrame:
    """``keep`` and the ids of each row's text (``ids``) or their number (``tokens``)."""
    spark = docs.sparkSession
    stages = Stages(spark, "tokens")
    table = stages.put(dictionary(word_counts(docs, text), name, folder))
    frequent, all_ = _frequent(table)
    known = spark.sparkContext.broadcast(frequent)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = known.value
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 40
        for b in batches:
            texts = b.column(len(keep))
            a, n, found, missing = 0, 0, [], []

            def out(z: int):
                nonlocal a, n, row
                cols = [c.slice(a, z - a) for c in b.columns[: len(keep)]]
                lengths = np.array([len(f) // 4 for f in found], np.int32)
                if ids:
                    flat = np.frombuffer(b"".join(found), np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(flat, pa.int32())))
                else:
                    cols.append(pa.array(lengths.astype(np.int64)))
                if not all_:
                    cols += [pa.array([[p for p, _ in m] for m in missing], pa.list_(pa.int32())), pa.array([[w for _, w in m] for m in missing], pa.list_(pa.string())), pa.array(np.arange(row, row + z - a))]
                a, n, row = z, 0, row + z - a
                found.clear()
                missing.clear()
                return pa.RecordBatch.from_arrays(cols, names)

            for i in range(len(texts)):
                w = words(texts[i].as_py() or "")
                try:
                    found.append(b"".join(map(d.__getitem__, w)))
                    missing.append(())
                except KeyError:
                    parts, gaps, at = [], [], 0
                    for x in w:
                        p = d.get(x)
                        if p is None:
                            gaps.append((at, x))
                        else:
                            parts.append(p)
                            at += len(p) // 4
                    found.append(b"".join(parts))
                    missing.append(gaps)
                n += len(w)
                if n >= BATCH:
                    yield out(i + 1)
            if len(texts) > a:
                yield out(len(texts))

    value = "ids" if ids else "tokens"
    names = [*keep, value] + ([] if all_ else ["_at", "_word", "_row"])
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + (", ids array<int>" if ids else ", tokens long") + ("" if all_ else ", _at array<int>, _word array<string>, _row long")
    placed = spread(docs.select(*keep, text), keep[0]).mapInArrow(look_up, schema)
    if all_:
        return placed
    placed = stages.put(placed)
    whole, open_ = placed.filter(F.size("_at") == 0).select(*keep, value), placed.filter(F.size("_at") > 0)
    # only the rarer words get here, so none of them has many rows; the rows of one text meet where they are one row of the result
    gaps = open_.select("_row", F.posexplode("_word").alias("_k", "_w")).join(table.select(F.col("word").alias("_w"), F.col("ids").alias("_ids")), "_w")
    if not ids:
        more = gaps.groupBy("_row").agg(F.sum(F.size("_ids")).alias("_more"))
        return whole.unionByName(open_.join(more, "_row").select(*keep, (F.col("tokens") + F.col("_more")).alias("tokens")))
    more = gaps.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_k", "_ids"))).alias("_gaps"))
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("_at", i - 1))
    filled = F.transform("_gaps", lambda g, i: F.concat(F.slice("ids", start(i) + 1, F.get("_at", i) - start(i)), g["_ids"]))
    last = F.element_at("_at", -1)
    text_ids = F.concat(F.flatten(filled), F.slice("ids", last + 1, F.size("ids") - last))
    return whole.unionByName(open_.join(more, "_row").select(*keep, text_ids.alias("ids")))


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, ids ARRAY<INT> of every row of ``docs``; null and empty texts have an empty list. Repeated and null keys give a row each."""
    return _place(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), ["doc_id"], "text", name, folder, True)


def count_tokens(docs: DataFrame, keep: list[str], text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``keep`` and tokens, the number of ids of the text, of every row; null and empty texts have 0."""
    return _place(docs.select(*keep, F.col(text).alias("text")), keep, "text", name, folder, False)


def token_bytes(spark, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """id, bytes of the vocabulary: a table of fixed size."""
    return spark.createDataFrame([(i, bytearray(b)) for b, i in ranks(name, folder).items()], "id int, bytes binary")


def decode(encoded: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, text of encoded texts: each id is looked up in the token-byte table, whose size is fixed, beside the text. No ids give an empty text."""
    known = encoded.sparkSession.sparkContext.broadcast({i: b for b, i in ranks(name, folder).items()})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = known.value
        for b in batches:
            texts = [b"".join(map(d.__getitem__, ids.as_py() or ())).decode("utf-8", "replace") for ids in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(join, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")
