"""BPE encoding and decoding by a distinct-word table.

``encode`` splits each text at ASCII white space, where no word of the
vocabulary's pre-tokenizer can continue, looks the distinct words of a block
up in a table that holds each word's ids, encodes only the words the table
lacks (once each), and puts the ids back by word position.  ``decode`` goes
from ids to text through an id-to-piece table.

The word table lives in the task, not in a Spark table: joining ids back by
position across the cluster would shuffle one row per word occurrence, about
2.5 times the compressed input.  It is bounded (``TABLE_WORDS``); when full, it
keeps the words of the block at hand, which costs time only.

Defined results: null or empty text has no ids and decodes to ''; a null
``doc_id`` is carried through; repeated rows give repeated rows; special
token strings in a text become their special ids; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huddle.llm.common import blocks, id_and_text

TABLE_WORDS = 250_000
WORD_VOCAB = "word_bpe_49k.json"

ENCODED = "doc_id long, n_tokens long, ids binary"
DECODED = "doc_id long, n_tokens long, ids binary, text string"


def vocabulary_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The vocabulary, loaded once per worker, without truncation or padding;
    Spark's tasks are the parallelism, so it starts no threads of its own."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(maxsize=4)
def piece_table(path: str) -> np.ndarray:
    """Piece of each id; ids between the known ones get ''."""
    vocab = tokenizer(path).get_vocab(with_added_tokens=True)
    table = np.full(max(vocab.values()) + 1, "", dtype=object)
    for piece, i in vocab.items():
        table[i] = piece
    return table


class WordTable:
    """Ids (little-endian uint32 bytes) of each distinct word seen so far."""

    def __init__(self, path: str, limit: int = TABLE_WORDS):
        self.tok, self.limit, self.ids = tokenizer(path), limit, {}

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.ids]
        if len(self.ids) + len(new) > self.limit:
            # words that came up again stay
            self.ids = {w: self.ids[w] for w in words if w in self.ids}
        for at in range(0, len(new), 20_000):
            part = new[at:at + 20_000]
            for w, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False)):
                self.ids[w] = np.asarray(e.ids, "<u4").tobytes()


@lru_cache(maxsize=4)
def word_table(path: str) -> WordTable:
    return WordTable(path)


def split_words(text: str) -> list[str]:
    return text.replace("\n", " ").replace("\t", " ").split(" ")


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(path)
        for block in blocks(batches):
            words = [split_words(t) for t in block["text"]]
            table.learn(set().union(*words))
            at = table.ids.__getitem__
            ids = [b"".join(map(at, w)) for w in words]
            yield pa.record_batch([pa.array(block["doc_id"], pa.int64()),
                                   pa.array([len(x) // 4 for x in ids], pa.int64()),
                                   pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])
    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_table(path)
        for block in blocks(batches, "ids"):
            texts = [" ".join(pieces[np.frombuffer(x, "<u4")]) for x in block["ids"]]
            yield pa.record_batch([pa.array(block["doc_id"], pa.int64()), pa.array(block["n_tokens"], pa.int64()),
                                   pa.array(block["ids"], pa.binary()), pa.array(texts, pa.string())],
                                  ["doc_id", "n_tokens", "ids", "text"])
    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids (uint32, little-endian)."""
    return id_and_text(docs).mapInArrow(_encode(path), ENCODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the decoded text."""
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(_decode(path), DECODED)


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document the number of ids and SHA-256 of ids and decoded text."""
    return decode(encode(docs, path), path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
