"""Token-id files: encode documents, write ids in doc_id order, read them back.

``write_token_files`` range-partitions the documents by ``doc_id`` and, for rows
that repeat one, the first characters of the text (the borders of the ranges
go through the driver, so whole texts are no part of them; a text is shuffled
once), sorts within the tasks, encodes them in order, ends each document with id 0 and packs
the ids in segments of about ``SEGMENT`` ids that never split a document
(``idcoder``: independently reset, checksummed blocks).  A file is one Spark
partition: a Parquet file in the shared folder whose rows are the segments,
with the documents' ids and lengths as an index.  ``read_token_files`` decodes
the segments and gives every document's ids and its place in the whole.

Defined results: null or empty text is id 0 alone; documents are ordered by
doc_id, nulls first, rows that repeat a doc_id by their text; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huddle.llm import idcoder
from huddle.llm.bpe import WordTable
from huddle.llm.common import blocks, id_and_text, written

BYTE_VOCAB = "byte_bpe_50k.json"
END = 0
SEGMENT = idcoder.LANES * idcoder.BLOCK
#: Characters of a text that the borders of the ranges hold; a text's place
#: among others follows from its head first, so whole texts are in order.
HEAD = 32

SEGMENTS = "file int, segment int, doc_ids array<long>, lengths array<long>, n_ids long, payload binary"
DOCUMENTS = "file int, segment int, doc_id long, n_tokens long, before long, ids binary"

#: Texts in which a cut before a space, comma, full stop or around a line
#: break might not be a word boundary of the byte-level pre-tokenizer.
_UNEVEN = re.compile(r"\s\s|[^\S \n]|[\W_][.,]|\x00")
_ASCII = bytes(range(128))
#: The same by kinds of bytes: blank, full stop or comma, letter or digit or
#: not ASCII (a), other (!), and what makes a text uneven by itself (zero).
_KINDS = bytes(
    ord("a") if b >= 128 or chr(b).isalnum() else ord(" ") if chr(b) in " \n" else ord(".") if chr(b) in ".,"
    else 0 if b == 0 or chr(b).isspace() else ord("!") for b in range(256))
_UNEVEN_KINDS = (b"  ", b" .", b"..", b"!.", b"\0")
#: A byte that UTF-8 never has.
CUT = b"\xff"
_LINE_EDGE = re.compile(r"(^|\s)\n|\n(\s|$)")


def even(text: str) -> bool:
    """Whether ``_UNEVEN`` is nowhere in ``text``; fast unless it has characters
    that are neither ASCII nor letters or digits."""
    raw = text.encode()
    if len(raw) != len(text) and not raw.translate(None, _ASCII).decode().isalnum():
        return not _UNEVEN.search(text)
    kinds = raw.translate(_KINDS)
    return not any(k in kinds for k in _UNEVEN_KINDS)


def cut(text: str) -> bytes:
    """``text`` in UTF-8 with ``CUT`` between the pieces that the byte-level
    vocabulary encodes on their own: words where the text is even, else lines,
    else the whole."""
    raw = text.encode()
    if even(text):
        raw = raw.replace(b" ", CUT + b" ").replace(b",", CUT + b",").replace(b".", CUT + b".")
        return raw.replace(b"\n", CUT + b"\n" + CUT)
    if "\n" not in text or _LINE_EDGE.search(text):
        return raw
    return (CUT + b"\n" + CUT).join(map(cut, text.split("\n")))


#: Distinct pieces that a task keeps; the fewer, the more often they are
#: encoded again.
TABLE_PIECES = 500_000
#: Bytes of text whose pieces are numbered together, about.
BLOCK = 4 << 20
#: What the byte-level pre-tokenizer's pattern finds in UTF-8 of these
#: characters alone, which are letters (A-Z, a-z, U+00C0 to U+00FF: byte C3 and
#: another), digits and symbols in any Unicode version; without the apostrophe,
#: which starts words of its own.  Other characters have a byte it never takes.
_PRE_TOKENS = re.compile(rb" ?[A-Za-z\xc3\x80-\x96\x98-\xb6\xb8-\xbf]+| ?[0-9]+| ?[!-&(-/:-@\[-`{-~]+")


def _letters() -> list[str]:
    """Letter by which the byte-level vocabulary writes each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


class PieceTable(WordTable):
    """A ``WordTable`` of pieces in UTF-8 that hands pre-tokens found by ``_PRE_TOKENS`` straight
    to the vocabulary's model, ``GROUP`` at a time with the letter of a byte
    between them that no longer entry holds, so that none merge; pieces with
    other characters or with added tokens go the usual way."""

    GROUP = 64

    def __init__(self, path: str, limit: int = TABLE_PIECES):
        super().__init__(path, limit)
        from tokenizers import Tokenizer
        vocab, parts = self.tok.get_vocab(with_added_tokens=False), json.loads(self.tok.to_str())
        level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        letters = _letters()
        self.between = letters[CUT[0]]
        self.added = tuple(t.content.encode() for t in self.tok.get_added_tokens_decoder().values())
        self.direct = (parts["normalizer"] is None and level.items() <= (parts["pre_tokenizer"] or {}).items()
                       and parts["post_processor"] is None and parts["model"]["type"] == "BPE"
                       and not any(parts["model"].get(k) for k in (
                           "dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
                       and all(c in vocab for c in letters)
                       and not any(self.between in piece for piece in vocab if piece != self.between)
                       and not any(_PRE_TOKENS.fullmatch(t) for t in self.added))
        if self.direct:
            self.model, self.end = Tokenizer(self.tok.model), vocab[self.between]
            self.code_points = np.array([ord(c) for c in letters], "<u4")

    def codes(self, words: list[bytes]) -> list[bytes]:
        """Ids of each of the distinct ``words``."""
        found = list(map(self.ids.get, words))
        lacking = [w for w, x in zip(words, found) if x is None]
        if not lacking:
            return found
        if len(self.ids) + len(lacking) > self.limit:
            # words that came up again stay
            self.ids = {w: x for w, x in zip(words, found) if x is not None}
        self.learn(lacking)
        return [self.ids[w] if x is None else x for w, x in zip(words, found)]

    def learn(self, lacking: list[bytes]) -> None:
        if not self.direct:
            return self._learn_each(lacking)
        # each of these is a pre-token, alone or in a piece
        parts = set(_PRE_TOKENS.findall(CUT.join(lacking)))
        new = [w for w in parts if w not in self.ids]
        for at in range(0, len(new), 20_000):
            self.ids.update(zip(new[at:at + 20_000], self._encoded(new[at:at + 20_000])))
        others = []
        for w in lacking:
            if w not in parts:
                found = _PRE_TOKENS.findall(w)
                if b"".join(found) != w or any(t in w for t in self.added):
                    others.append(w)
                else:
                    self.ids[w] = b"".join([self.ids[x] for x in found])
        if others:
            self._learn_each(others)

    def _learn_each(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 20_000):
            part = words[at:at + 20_000]
            for w, e in zip(part, self.tok.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                self.ids[w] = np.asarray(e.ids, "<u4").tobytes()

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        raw = np.frombuffer(CUT.join(words), np.uint8)
        letters = self.code_points[raw].tobytes().decode("utf-32-le").split(self.between)
        groups = [self.between.join(letters[k:k + self.GROUP]) for k in range(0, len(letters), self.GROUP)]
        ids: list[int] = []
        for e in self.model.encode_batch_fast(groups, add_special_tokens=False):
            ids += e.ids
            ids.append(self.end)
        code = np.array(ids, "<u4")
        ends = np.flatnonzero(code == self.end)
        if len(ends) != len(words):
            raise ValueError("ids of pieces are not those of each piece")
        raw, ends = code.tobytes(), (ends * 4).tolist()
        return list(map(raw.__getitem__, map(slice, [0, *(x + 4 for x in ends[:-1])], ends)))


@lru_cache(maxsize=4)
def _table(path: str) -> PieceTable:
    return PieceTable(path)


def encoded(texts: list[str], table: PieceTable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each with its end, and how many each has.  Pieces are
    numbered by Arrow, so Python looks up the distinct ones only."""
    lists = pc.split_pattern(pa.array(list(map(cut, texts)), pa.large_binary()), CUT)
    pieces = lists.flatten().dictionary_encode()
    which, words = pieces.indices.to_numpy(), pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
    codes = table.codes(words)
    n = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
    known, start = np.frombuffer(b"".join(codes), "<u4"), np.cumsum(n) - n
    sizes = n[which]
    upto = np.cumsum(sizes)
    ids = known[np.repeat(start[which] - upto + sizes, sizes) + np.arange(sizes.sum())]
    ends = np.concatenate([[0], upto])[lists.offsets.to_numpy()[1:]]
    return np.insert(ids, ends, END), np.diff(ends, prepend=0) + 1


def _write(path: str, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, file = _table(path), TaskContext.get().partitionId()
        state = {"n": 0, "doc_ids": [], "ids": [], "held": 0}

        def flush():
            ids = np.concatenate(state["ids"])
            row = pa.record_batch([
                pa.array([file], pa.int32()), pa.array([state["n"]], pa.int32()),
                pa.array([state["doc_ids"]], pa.list_(pa.int64())),
                pa.array([list(map(len, state["ids"]))], pa.list_(pa.int64())),
                pa.array([len(ids)], pa.int64()), pa.array([idcoder.pack(ids)], pa.binary())],
                ["file", "segment", "doc_ids", "lengths", "n_ids", "payload"])
            state.update(n=state["n"] + 1, doc_ids=[], ids=[], held=0)
            return row

        for block in blocks(batches, size=BLOCK):
            all_ids, lengths = encoded(block["text"], table)
            for doc_id, ids in zip(block["doc_id"], np.split(all_ids, np.cumsum(lengths)[:-1])):
                state["doc_ids"].append(doc_id)
                state["ids"].append(ids)
                state["held"] += len(ids)
                if state["held"] >= segment:
                    yield flush()
        if state["doc_ids"]:
            yield flush()
    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {n: v[0] for n, v in batch.slice(k, 1).to_pydict().items()}
            ids = idcoder.unpack(row["payload"])
            lengths = np.array(row["lengths"], np.int64)
            before = np.concatenate([[0], np.cumsum(lengths)])
            if before[-1] != len(ids):
                raise ValueError("a segment's index does not add up to its ids")
            n = len(lengths)
            raw = ids.tobytes()
            yield pa.record_batch([
                pa.array([row["file"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()),
                pa.array(row["doc_ids"], pa.int64()), pa.array(lengths),
                pa.array(before[:-1]),
                pa.array([raw[4 * a:4 * b] for a, b in zip(before[:-1], before[1:])], pa.binary())],
                ["file", "segment", "doc_id", "n_tokens", "before", "ids"])


def write_token_files(docs: DataFrame, path: str, segment: int = SEGMENT) -> DataFrame:
    """Writes the files and returns their rows, as read from the folder."""
    ordered = id_and_text(docs).repartitionByRange("doc_id", F.substring("text", 1, HEAD)).sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(_write(path, segment), SEGMENTS), "token-files")


def read_token_files(files: DataFrame, **columns) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it),
    n_tokens and ``columns``, expressions over ``ids`` (default: ``ids``
    itself), taken before the join so that it need not move ids.  Offsets come from the segments' sizes: first within a
    file, then over the files, of which there are as many as partitions."""
    sizes = files.select("file", "segment", "n_ids")
    within = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    by_file = sizes.groupBy("file").agg(F.sum("n_ids").alias("n")).select(
        "file", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("file_start"))
    starts = sizes.withColumn("segment_start", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(by_file, "file")
    docs = files.select("file", "segment", "doc_ids", "lengths", "n_ids", "payload").mapInArrow(_read, DOCUMENTS)
    columns = columns or {"ids": F.col("ids")}
    docs = docs.select("file", "segment", "doc_id", "n_tokens", "before", *[c.alias(n) for n, c in columns.items()])
    return docs.join(starts.drop("n_ids"), ["file", "segment"]).select(
        "doc_id", (F.col("file_start") + F.col("segment_start") + F.col("before")).alias("start"), "n_tokens", *columns)


def token_index(docs: DataFrame, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    return read_token_files(write_token_files(docs, path), ids_crc32=F.crc32("ids"))
