"""Encoding of a corpus with a public byte-level BPE tokenizer, and decoding.

Distinct-word table: the texts are split into words by the tokenizer's own pattern in the
JVM, every distinct word is encoded once, and the ids come back to their positions by a join.
Frequent words (their number and length are bounded) are looked up where the texts are, so that a text becomes a frame of ids with
holes for its rare words; only those are joined by a shuffle, in which no word is frequent, and fill the holes. Decoding joins ids with the tokenizer's id-to-piece table.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import HOT_SHARE
from ..session import cut_lineage, written_table

DEFAULT_TOKENIZERS = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenizer pattern of the byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longest word that may be broadcast.
HOT_LENGTH = 512
#: Stands for a rare word in a frame.
HOLE = -1


def tokenizer_path(name: str = TOKENIZER, folder: str | None = None) -> str:
    """Where the vocabulary file lies; ``folder`` overrides the default place."""
    return str(Path(folder or DEFAULT_TOKENIZERS) / name)


@functools.lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    return tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


def _word_encoder(path: str):
    """Function from one word (never split again) to its ids."""
    core = _encoding(path)._core_bpe
    return lambda word: core.encode_single_piece(word.encode("utf-8", "replace"))


def _split_in_python(texts: pd.Series) -> pd.Series:
    import regex

    pattern = regex.compile(PATTERN)
    return texts.map(lambda t: None if t is None else pattern.findall(t))


def words_of(text: Column) -> Column:
    """Array of the words of a text; their concatenation is the text, null for null.

    The JVM splits. Texts with code points newer than the JVM's Unicode tables, whose classes it
    can't know, are split by the same pattern in Python.
    """
    python_split = F.pandas_udf(_split_in_python, "array<string>")
    newer = text.rlike(r"\p{Cn}")
    in_jvm = F.regexp_extract_all(F.when(~newer, text), F.lit("(?U)" + PATTERN), F.lit(0))
    return F.coalesce(in_jvm, python_split(F.when(newer, text)))


def word_table(words: DataFrame, path: str) -> DataFrame:
    """``word``, ``n`` (occurrences) and ``ids`` of every distinct word; each is encoded once."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _word_encoder(path)
        for batch in batches:
            yield batch.assign(ids=[encoder(w) for w in batch["word"]])

    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).mapInPandas(encode, "word string, n bigint, ids array<int>")


def _frames(df: DataFrame, text: str, keys: list[str], path: str, frame_type: str = "array<int>") -> tuple[DataFrame, DataFrame]:
    """(frames, table): per row its keys, ``frame`` and ``rare``, and the ids (``word``, ``ids``) of the rare words.

    A frame has the ids of a text with HOLE for each rare word, and ``rare`` those words in their order. The frequent words, at most
    HOT_SHARE of bounded length, go to every task; with frame type "bigint" a frame is only the number of its ids.
    """
    words = df.where(F.length(text) > 0).select(*keys, words_of(F.col(text)).alias("words"))
    table = cut_lineage(word_table(words.select(F.explode("words").alias("word")), path))
    total = table.agg(F.sum("n")).first()[0] or 0
    hot = (F.col("n") * HOT_SHARE >= F.lit(max(1, total))) & (F.length("word") <= HOT_LENGTH)
    frequent = table.where(hot).select("word", "ids").toArrow()
    # The last entry of the lists is the hole.
    known = pa.concat_arrays([*frequent["word"].chunks, pa.array([], frequent["word"].type)])
    lists = pa.concat_arrays([pa.array(frequent["ids"].to_pylist(), pa.list_(pa.int32())), pa.array([[HOLE]], pa.list_(pa.int32()))])
    shared = df.sparkSession.sparkContext.broadcast((known, lists))
    counting = frame_type == "bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lists = shared.value
        for batch in batches:
            column = batch.column("words")
            flat, ends = column.flatten(), column.offsets.to_numpy() - column.offsets[0].as_py()
            place = pc.index_in(flat, value_set=known.cast(flat.type))
            is_rare = pc.is_null(place).to_numpy(zero_copy_only=False)
            taken = lists.take(pc.fill_null(place, len(known)))
            upto = taken.offsets.to_numpy() - taken.offsets[0].as_py()
            rare_ends = np.concatenate([[0], np.cumsum(is_rare)])[ends].astype(np.int32)
            if counting:
                frame = pa.array((upto[ends[1:]] - upto[ends[:-1]] - np.diff(rare_ends)).astype(np.int64))
            else:
                frame = pa.ListArray.from_arrays(pa.array(upto[ends].astype(np.int32)), taken.flatten())
            rare = pa.ListArray.from_arrays(pa.array(rare_ends), flat.filter(pa.array(is_rare)))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], frame, rare], [*keys, "frame", "rare"])

    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), f"frame {frame_type}", "rare array<string>"])
    return words.mapInArrow(run, schema), table.where(~hot).select("word", "ids")


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``k`` and ``ids``: frames (k, frame, rare: array<struct<pos, ids>> in order) with their holes filled."""
    for batch in batches:
        frame, rare = batch.column("frame"), batch.column("rare")
        flat, ends = frame.flatten().to_numpy(), frame.offsets.to_numpy() - frame.offsets[0].as_py()
        filling = rare.flatten().field("ids") if rare.null_count < len(rare) else pa.array([], pa.list_(pa.int32()))
        lengths = np.ones(len(flat), np.int64)
        holes = flat == HOLE
        sizes = pc.list_value_length(filling).to_numpy(zero_copy_only=False).astype(np.int64)
        lengths[holes] = sizes
        upto = np.concatenate([[0], np.cumsum(lengths)])
        out = np.empty(upto[-1], np.int32)
        starts = upto[:-1]
        out[starts[~holes]] = flat[~holes]
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(starts[holes], sizes) + within] = filling.flatten().to_numpy()
        ids = pa.ListArray.from_arrays(pa.array(upto[ends].astype(np.int32)), pa.array(out))
        yield pa.RecordBatch.from_arrays([batch.column("k"), ids], ["k", "ids"])


def encode_texts(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``key`` and ``ids`` of every text, without special tokens.

    Null and empty texts have an empty list; blank texts are text. Whole texts are encoded, of
    any length. Repeated rows come out once; different texts under one key, or under a null
    key, come out as a row each. Special-token strings in a text are ordinary text. Other columns are
    ignored, whatever their names; an empty table gives an empty table.
    """
    path = path or tokenizer_path()
    slim = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(text, F.length(text)).alias("h"))
    frames, table = _frames(slim, "t", ["k", "h"], path)
    frames = written_table(frames)
    rare = frames.where("size(rare) > 0").select("k", "h", F.posexplode("rare").alias("pos", "word")).join(table, "word")
    hollow = frames.select("k", "h", "frame", F.lit(None).cast("struct<pos:int,ids:array<int>>").alias("r"))
    parts = hollow.unionByName(rare.select("k", "h", F.lit(None).cast("array<int>").alias("frame"), F.struct("pos", "ids").alias("r")))
    # A repeated row has its frame and its rare words several times.
    whole = parts.groupBy("k", "h").agg(F.first("frame", ignorenulls=True).alias("frame"), F.sort_array(F.collect_list("r")).alias("r")).select("k", "frame", F.array_distinct("r").alias("rare"))
    encoded = whole.mapInArrow(_fill, f"k {df.schema[key].dataType.simpleString()}, ids array<int>")
    empty = slim.where("t is null or t = ''").select("k", F.array().cast("array<int>").alias("ids")).distinct()
    return encoded.unionByName(empty).withColumnRenamed("k", key)


def count_tokens(df: DataFrame, keys: list[str], text: str, path: str | None = None) -> DataFrame:
    """``keys`` and ``n_tokens`` of every text that has any; ``keys`` must name a row."""
    frames, table = _frames(df.select(*keys, text), text, keys, path or tokenizer_path(), "bigint")
    frames = written_table(frames)
    rare = frames.where("size(rare) > 0").select(*keys, F.explode("rare").alias("word")).join(table.select("word", F.size("ids").cast("bigint").alias("frame")), "word")
    return frames.select(*keys, "frame").unionByName(rare.select(*keys, "frame")).groupBy(*keys).agg(F.sum("frame").alias("n_tokens"))


def piece_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``id`` and ``piece`` (hexadecimal bytes) of the vocabulary, a table of fixed size."""
    rows = [(i, piece.hex()) for piece, i in _ranks(path or tokenizer_path()).items()]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["id", "piece"]), "id int, piece string")


def decode_ids(df: DataFrame, key: str, ids: str, path: str | None = None) -> DataFrame:
    """``key`` and ``text``: the join of ids with their pieces, put together in order.

    A null list gives a null text, an empty list an empty text; ``key`` must name a row. Unknown ids
    are left out.
    """
    slim = df.select(F.col(key).alias("k"), F.col(ids).alias("i"))
    pieces = piece_table(df.sparkSession, path)
    flat = slim.select("k", F.posexplode("i").alias("pos", "id")).join(F.broadcast(pieces), "id")
    joined = flat.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("parts"))
    text = F.decode(F.unhex(F.array_join(F.transform("parts", lambda p: p["piece"]), "")), "UTF-8")
    filled = joined.select("k", text.alias("text"))
    empty = slim.where("i is null or size(i) = 0").select("k", F.when(F.col("i").isNotNull(), "").alias("text"))
    return filled.unionByName(empty).withColumnRenamed("k", key)
