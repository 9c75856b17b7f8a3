"""Problem 6: encoding a corpus with a public byte-level BPE tokenizer.

Texts are split into words by the tokenizer's own pattern, on the JVM.  Each
distinct word is encoded once; the ids are joined back by position.  BPE never
merges across words of the pattern, so the result is the encoding of the text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.words import distinct_words, join_words
from tesserae.session import Scratch

TOKENIZERS = os.environ.get("TESSERAE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"

# The published word pattern of this vocabulary, with white space by its Unicode property.
WORD_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?![^\p{IsWhite_Space}])|\p{IsWhite_Space}+"
)


def load_tokenizer(path: str):
    """The tokenizer of a vocabulary file, for which special tokens in a text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


#: Ids are held as one character each until a text is put together: code points in order, without the surrogates.
SURROGATES, GAP = 0xD800, 0x800


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """``word, n, out``: the ids of each word, one character per id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = load_tokenizer(path)
        for b in batches:
            coded = tokenizer.encode_batch_fast(b["word"].tolist(), add_special_tokens=False)
            yield b.assign(out=["".join(chr(i if i < SURROGATES else i + GAP) for i in x.ids) for x in coded])

    return words.mapInPandas(run, "word string, n bigint, out string")


def split_words(documents: DataFrame, path: str) -> DataFrame:
    """``doc_id, pos, word``: the words of each text; one row with null ``pos`` and ``word`` for null and empty texts.

    Texts with code points that the JVM's Unicode tables don't know are split by
    the tokenizer library itself.
    """

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        pre = load_tokenizer(path).pre_tokenizer
        return pd.Series([[t[a:b] for _, (a, b) in pre.pre_tokenize_str(t)] for t in texts])

    known = documents.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{Cn}"), F.lit(False)).alias("new"))
    jvm = known.where("not new").select("doc_id", F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0)).alias("words"))
    other = known.where("new").select("doc_id", split("text").alias("words"))
    return jvm.unionByName(other).select("doc_id", F.posexplode_outer("words").alias("pos", "word"))


def _coded(documents: DataFrame, scratch: Scratch, path: str) -> tuple[DataFrame, DataFrame]:
    occurrences = split_words(documents, path)
    return occurrences, distinct_words(occurrences, lambda w: encode_words(w, path), scratch, "words")


def encode(documents: DataFrame, scratch: Scratch | None = None, path: str | None = None) -> DataFrame:
    """``doc_id, ids`` of every row of ``documents`` (``doc_id`` unique); null and empty texts have an empty list.

    No special token is added, and text that spells one is ordinary text.  An
    empty table gives no rows; extra columns are ignored.
    """
    path = path or str(Path(TOKENIZERS) / VOCABULARY)
    scratch = scratch or Scratch(documents.sparkSession, "encode")
    occurrences, words = _coded(documents, scratch, path)
    met = join_words(occurrences, words, F.lit(""))
    per = met.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "out")).alias("parts"))
    text = per.select("doc_id", F.array_join(F.transform(F.array_sort("parts"), lambda x: x["out"]), "").alias("t"))
    ids = F.transform(F.split("t", ""), lambda c: F.when(F.ascii(c) < SURROGATES, F.ascii(c)).otherwise(F.ascii(c) - GAP))
    return text.select("doc_id", F.when(F.length("t") > 0, ids).otherwise(F.array().cast("array<int>")).alias("ids"))


def token_counts(documents: DataFrame, scratch: Scratch | None = None, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens`` of every row of ``documents``, without building the id lists."""
    path = path or str(Path(TOKENIZERS) / VOCABULARY)
    scratch = scratch or Scratch(documents.sparkSession, "counts")
    occurrences, words = _coded(documents, scratch, path)
    # frequent words are counted where they stand, only rare ones are sent; sums are partial before they are sent
    met = join_words(occurrences.drop("pos"), words.select("word", "n", F.length("out").alias("out")), F.lit(0))
    return met.groupBy("doc_id").agg(F.sum("out").cast("bigint").alias("n_tokens"))


def byte_pieces(path: str) -> list[tuple[int, bytes]]:
    """The bytes of each id of a byte-level vocabulary."""
    # byte-level vocabularies write each byte as a printable character: printable bytes stand for themselves,
    # the others follow from code point 256 in order
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(b): b for b in plain}
    alphabet |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    vocabulary = load_tokenizer(path).get_vocab(with_added_tokens=False)
    return [(i, bytes(alphabet[c] for c in piece)) for piece, i in vocabulary.items()]


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` of rows ``doc_id, ids`` by a join with the table of pieces (fixed size, broadcast).

    An empty list gives an empty text; null lists give a null text.
    """
    path = path or str(Path(TOKENIZERS) / VOCABULARY)
    spark = encoded.sparkSession
    pieces = spark.createDataFrame([(i, p.hex()) for i, p in byte_pieces(path)], "id int, piece string")
    flat = encoded.select("doc_id", F.col("ids").isNull().alias("none"), F.posexplode_outer("ids").alias("pos", "id"))
    met = flat.join(F.broadcast(pieces), "id", "left")
    per = met.groupBy("doc_id").agg(F.max("none").alias("none"), F.collect_list(F.struct("pos", "piece")).alias("parts"))
    joined = F.array_join(F.transform(F.array_sort("parts"), lambda x: x["piece"]), "")
    return per.select("doc_id", F.when(~F.col("none"), F.decode(F.unhex(joined), "UTF-8")).alias("text"))
