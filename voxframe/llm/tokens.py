"""Token ids of a whole corpus through a table of its distinct words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.operators.joins import joined_spread
from voxframe.session import cut

#: Folder with the vocabulary files, and the file of the tokenizer.
TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER_FILE = "byte_bpe_50k.json"
#: The published word pattern of the tokenizer (a fixed value), words of letters first: they begin unlike contractions, and are most of
#: all words. ``(?U)`` gives ``\s`` its Unicode meaning in Java.
WORD_PATTERN = r"(?U) ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A word with at least one in so many of all occurrences is frequent, so there are at most as many frequent words.
FREQUENT_ONE_IN = 20_000
#: Frequent words are at most so long; longer ones are joined like rare words. With the number above this bounds the broadcast.
FREQUENT_CHARS = 48


def words_of(text: Column | str) -> Column:
    """The words of a text in order; together they are the text. Null gives null."""
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(WORD_PATTERN), F.lit(0))


def _encoder(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        for batch in batches:
            found = tokenizer.encode_batch(batch["word"].tolist(), add_special_tokens=False)
            yield batch.assign(ids=[e.ids for e in found])

    return run


def word_table(words: DataFrame, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """``word, n, ids``: each distinct word with its occurrences, encoded once; written to the shared folder."""
    counted = words.filter("word is not null").groupBy("word").agg(F.count("*").alias("n"))
    return cut(counted.mapInPandas(_encoder(f"{tokenizer_dir}/{TOKENIZER_FILE}"), "word string, n long, ids array<int>"))


def frequent_words(vocabulary: DataFrame) -> pa.Table:
    """``word, ids`` of the frequent words, of which there are at most ``FREQUENT_ONE_IN`` of at most ``FREQUENT_CHARS`` characters."""
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = (F.col("n") * FREQUENT_ONE_IN >= total) & (F.length("word") <= FREQUENT_CHARS)
    return vocabulary.filter(often).select("word", "ids").toArrow().combine_chunks()


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All members of a column of lists in one array, and how many each list has (0 for null)."""
    return pa.concat_arrays([lists.flatten()]), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)


def _rare(frequent: pa.Table):
    """The distinct words of each batch's documents that aren't frequent."""
    known = frequent.column("word").combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, count = _flat(batch.column("words"))
            missing = np.flatnonzero(np.asarray(pc.is_null(pc.index_in(words, known))))
            doc = np.repeat(np.arange(len(count)), count)[missing]
            words = words.take(pa.array(missing)).dictionary_encode()
            pairs = np.unique((doc << 32) | words.indices.to_numpy().astype(np.int64))
            yield pa.record_batch([batch.column("__key").take(pa.array(pairs >> 32)), words.dictionary.take(pa.array(pairs & 0xFFFFFFFF))], names=["__key", "word"])

    return run


def _counted(frequent: pa.Table):
    """Of each document the number of ids of its frequent words, and its distinct rare words with their numbers."""
    known = frequent.column("word").combine_chunks()
    sizes = np.asarray(pc.list_value_length(frequent.column("ids").combine_chunks())).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, count = _flat(batch.column("words"))
            doc = np.repeat(np.arange(len(count)), count)
            at = np.asarray(pc.fill_null(pc.index_in(words, known), -1)).astype(np.int64)
            have, missing = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
            n = np.bincount(doc[have], sizes[at[have]], len(count)).astype(np.int64)
            rare = words.take(pa.array(missing)).dictionary_encode()
            pairs, times = np.unique((doc[missing] << 32) | rare.indices.to_numpy().astype(np.int64), return_counts=True)
            begin = pa.array(np.searchsorted(pairs >> 32, np.arange(len(count) + 1)).astype(np.int32))
            each = pa.StructArray.from_arrays([rare.dictionary.take(pa.array(pairs & 0xFFFFFFFF)), pa.array(times.astype(np.int64))], names=["word", "times"])
            yield pa.record_batch([batch.column("__key"), batch.column("__copy"), pa.array(n), pa.ListArray.from_arrays(begin, each)], names=["__key", "__copy", "n", "rare"])

    return run


def _joined(frequent: pa.Table):
    """Ids of each document's words, joined back by position: from the frequent words, or from the document's own list of rare ones."""
    known, known_ids = (frequent.column(c).combine_chunks() for c in ("word", "ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, count = _flat(batch.column("words"))
            own, own_count = _flat(batch.column("rare"))
            doc = np.repeat(np.arange(len(count)), count)
            at = np.asarray(pc.fill_null(pc.index_in(words, known), -1)).astype(np.int64)
            missing = np.flatnonzero(at < 0)
            if len(missing):
                # rare words are looked up by (document, word): both sides get the number of the word in this batch
                names = own.field("word").dictionary_encode()
                word = np.asarray(pc.fill_null(pc.index_in(words.take(pa.array(missing)), names.dictionary), -1)).astype(np.int64)
                have = (np.repeat(np.arange(len(own_count)), own_count) << 32) | names.indices.to_numpy().astype(np.int64)
                order = np.argsort(have)
                at[missing] = len(known) + order[np.searchsorted(have[order], (doc[missing] << 32) | word)]
            table = pa.concat_arrays([known_ids, own.field("ids").cast(known_ids.type)])
            found = table.take(pa.array(at))
            sizes = np.asarray(pc.list_value_length(found)).astype(np.int64)
            ends = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(count)]]
            yield pa.record_batch([batch.column("__key"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), found.flatten()), pa.array(np.diff(ends))], names=["__key", "ids", "n"])

    return run


def _encoded(docs: DataFrame, key: str, text: str, tokenizer_dir: str) -> DataFrame:
    """``__key, ids, n`` of each document.

    The words of all documents are counted and each distinct one is encoded once. Frequent words, whose number is bounded,
    are sent to all tasks, so a word that is a third of the corpus isn't shuffled; rare ones are joined by a shuffle, one
    row for a document and word, and gathered for each document. Then the words of a document are joined with both by
    position where the document lies.
    """
    texts = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    words = texts.select("__key", words_of("__text").alias("words"))
    vocabulary = word_table(words.select(F.explode("words").alias("word")), tokenizer_dir)
    frequent = frequent_words(vocabulary)
    rare = words.mapInArrow(_rare(frequent), f"__key {docs.schema[key].dataType.simpleString()}, word string").distinct()
    named = joined_spread(rare, vocabulary, ["word"], "__key").groupBy("__key").agg(F.collect_list(F.struct("word", "ids")).alias("rare"))
    # rows of one key are one document
    once = texts.groupBy("__key").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text"))
    both = once.join(named.withColumnRenamed("__key", "__same"), F.col("__key").eqNullSafe(F.col("__same")), "left")
    lists = both.select("__key", words_of("__text").alias("words"), F.coalesce("rare", F.array().cast("array<struct<word:string,ids:array<int>>>")).alias("rare"))
    return lists.mapInArrow(_joined(frequent), f"__key {docs.schema[key].dataType.simpleString()}, ids array<int>, n long")


def encode_corpus(docs: DataFrame, key: str, text: str, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """``key, ids``: the token ids of each document, without special tokens.

    A null or empty text has the empty list; the strings of special tokens are ordinary text; texts of any length are
    encoded whole. Rows of one key are one document, of different texts the one with the smallest hash counts; documents
    with a null key are one document. An empty table gives no rows; other columns are ignored.
    """
    return _encoded(docs, key, text, tokenizer_dir).select(F.col("__key").alias(key), "ids")


def token_counts(docs: DataFrame, key: str, text: str, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """``key, n_tokens`` of the documents that have a token; rows of one key are one document, as in ``encode_corpus``.

    Needs no positions: frequent words are counted where the document lies, rare ones are joined by a shuffle, one row for a
    document and word.
    """
    words = docs.select(F.col(key).alias("__key"), F.xxhash64(text).alias("__copy"), words_of(text).alias("words"))
    vocabulary = word_table(words.select(F.explode("words").alias("word")), tokenizer_dir)
    kind = docs.schema[key].dataType.simpleString()
    rows = words.mapInArrow(_counted(frequent_words(vocabulary)), f"__key {kind}, __copy long, n long, rare array<struct<word:string,times:long>>")
    once = cut(rows.groupBy("__key").agg(F.min_by(F.struct("n", "rare"), "__copy").alias("x")).select("__key", "x.*"))
    sizes = vocabulary.select("word", F.size("ids").alias("size"), "n")
    rare = joined_spread(once.select("__key", F.inline("rare")), sizes, ["word"], "__key").select("__key", (F.col("times") * F.col("size")).alias("n"))
    counted = once.select("__key", "n").unionByName(rare).groupBy("__key").agg(F.sum("n").alias("n_tokens"))
    return counted.filter("n_tokens > 0").select(F.col("__key").alias(key), "n_tokens")


def _pieces(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        for batch in batches:
            parts = batch["value"].str.split(" ", n=1)
            yield pd.DataFrame({"id": parts.str[1].astype("int32"), "piece": parts.str[0].map(base64.b64decode)})

    return run


def decode_corpus(encoded: DataFrame, key: str, ids: str, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """``key, text`` of token ids, by a join with the table of the vocabulary's pieces (as many rows as ids, so it is broadcast).

    An empty or null list gives the empty text; ids that make no UTF-8 give replacement characters.
    """
    spark = encoded.sparkSession
    lines = spark.read.text(f"file://{tokenizer_dir}/{TOKENIZER_FILE.replace('.json', '.tiktoken')}").filter("value <> ''")
    pieces = lines.mapInPandas(_pieces(tokenizer_dir), "id int, piece binary")
    rows = encoded.select(F.col(key).alias("__key"), F.posexplode_outer(ids).alias("pos", "id")).join(F.broadcast(pieces), "id", "left")
    piece = F.when(F.col("pos").isNotNull(), F.struct("pos", F.hex("piece").alias("piece")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["piece"]), "")
    return rows.groupBy("__key").agg(F.make_valid_utf8(F.unhex(joined).cast("string")).alias("text")).withColumnRenamed("__key", key)
