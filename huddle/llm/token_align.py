"""Cross-tokenizer alignment over the distinct texts of a table.

Two vocabularies, byte-level (A) and pieces with byte fallback (B, which puts
a space before the text), cut the same bytes.  Where a token of A and one of B
end at the same byte, the two are linked, and these bytes cut both sequences
into groups.  How often an id pair is linked in the whole table says which
pieces correspond.

Texts are shuffled in full, once, to count each distinct one; it is tokenised
and aligned once, and its pair counts weigh by its multiplicity.  Counts and
the best pair of every B id are sums over all texts.  Each text is then
measured by its own pairs' counts, and the measures are joined to the rows by
the text's SHA-256; a text that very many rows share is dealt over several
salts.  The table of pair counts is broadcast while it is small
(``BROADCAST_PAIRS`` rows, counted), else joined by shuffle: same results.

Vocabulary A is merged by ``tiktoken`` with the ids of the file as ranks, which
is the same where ids are in merge order (checked when loading), for texts
below U+0240 without very long words or runs of blanks; all others are encoded
by ``tokenizers``.

Defined results: null and empty texts, and texts whose joined token bytes
differ from space + text, have no tokens: zeros and no groups; repeated rows
count each time and all get the measures; a null ``doc_id`` is carried
through; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huddle.llm.common import blocks, id_and_text, written
from huddle.operators.joins import skewed_join

BYTE_VOCAB, PIECE_VOCAB = "byte_bpe_50k.json", "piece_bpe_32k.model"
BROADCAST_PAIRS = 1_000_000
#: A text with more than one in SHARES of the rows is dealt over salts.
SHARES = 1000

# Fixed value: where the byte-level pre-tokenizer splits.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_HIGHEST_LEAD, _LONG_RUN = 0xC8, 1000


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other
    bytes, in order, for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteVocabulary:
    """Vocabulary A: ids of texts, special token strings as plain text, and the
    bytes of every id."""

    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.tok.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars, vocab = byte_of_char(), self.tok.get_vocab(with_added_tokens=False)
        added = {t["content"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (max(self.tok.get_vocab(with_added_tokens=True).values()) + 1)
        for piece, i in vocab.items():
            if piece not in added:
                self.bytes[i] = bytes(chars[c] for c in piece)
        self.fast = self._merger(spec, vocab, added)

    def _merger(self, spec: dict, vocab: dict[str, int], added: set[str]):
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        order = [vocab[a + b] for a, b in pairs]
        made = {p: i for p, i in vocab.items() if len(p) > 1 and p not in added}
        kind = spec["pre_tokenizer"] or {}
        if (kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or spec["normalizer"]
                or order != sorted(order) or len(set(order)) != len(order) or set(order) != set(made.values())):
            return None
        import tiktoken
        ranks = {b: i for i, b in enumerate(self.bytes) if b}
        return tiktoken.Encoding("byte-level", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def simple(self, raw: bytes) -> bool:
        """Only characters whose class no edition of Unicode changed, and no
        run (of blanks, or without) on which merging by scans is slow."""
        data = np.frombuffer(raw, np.uint8)
        if data.max(initial=0) > _HIGHEST_LEAD:
            return False
        blank = data <= 0x20
        turns = np.flatnonzero(blank[1:] != blank[:-1])
        return int(np.diff(turns, prepend=-1, append=len(data) - 1).max(initial=0)) < _LONG_RUN

    def encode(self, texts: list[str], raw: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(texts)
        slow = []
        for k, (t, r) in enumerate(zip(texts, raw)):
            if self.fast is not None and self.simple(r):
                out[k] = self.fast.encode_ordinary(t)
            else:
                slow.append(k)
        for k, e in zip(slow, self.tok.encode_batch_fast([texts[k] for k in slow], add_special_tokens=False)):
            out[k] = e.ids
        return out


class PieceVocabulary:
    """Vocabulary B: ids of texts and the bytes of every id."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self.sp = SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(pieces)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.sp.encode(texts, num_threads=1)


def matching_ends(len_a: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the tokens of A and of B that end at the same byte."""
    end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
    at = np.searchsorted(end_b, end_a)
    same = end_b[np.minimum(at, len(end_b) - 1)] == end_a
    return np.flatnonzero(same), at[same]


class Aligner:
    """Both vocabularies, and their ids as text with each separator."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteVocabulary(path_a), PieceVocabulary(path_b)
        self.len_a = np.array([len(x) for x in self.a.bytes], np.int64)
        self.len_b = np.array([len(x) for x in self.b.bytes], np.int64)
        self.v = v = max(len(self.a.bytes), len(self.b.bytes))
        self.n_b = len(self.b.bytes)
        self.written = np.array([f"{i}{sep}" for sep in ",|,;" for i in range(v)], dtype=object)

    def groups(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: the groups that the linked tokens close."""
        closes_a, closes_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        closes_a[at_a], closes_b[at_b] = 1, 1
        group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.concatenate([[0], at_b + 1])[group_a]] = a + closes_a * self.v
        out[np.arange(len(b)) + (at_a + 1)[group_b]] = b + (2 + closes_b) * self.v
        return "".join(self.written[out].tolist())[:-1]

    def align(self, raw: bytes, ids_a: list[int], ids_b: list[int]):
        """Linked ids of A and B, and the groups; None if tokens and text differ."""
        table_a, table_b = self.a.bytes, self.b.bytes
        if not ids_a or b"".join([table_a[i] for i in ids_a]) != raw or b"".join([table_b[i] for i in ids_b]) != raw:
            return None
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        at_a, at_b = matching_ends(self.len_a[a], self.len_b[b])
        return a[at_a], b[at_b], self.groups(a, b, at_a, at_b)


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _align(path_a: str, path_b: str, pair_type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(path_a, path_b)
        for block in blocks(batches):
            spaced = [" " + t for t in block["text"]]
            raw = [t.encode() for t in spaced]
            of_a, of_b = al.a.encode(spaced, raw), al.b.encode(block["text"])
            rows, pairs, counts, offsets = [], [], [], [0]
            for r, ids_a, ids_b in zip(raw, of_a, of_b):
                found = al.align(r, ids_a, ids_b)
                if found is None:
                    rows.append((0, 0, 0, ""))
                else:
                    rows.append((len(ids_a), len(ids_b), len(found[0]), found[2]))
                    p, n = np.unique(found[0] * al.n_b + found[1], return_counts=True)
                    pairs.append(p)
                    counts.append(n)
                offsets.append(offsets[-1] + (len(pairs[-1]) if found is not None else 0))
            n_a, n_b, n_links, groups = zip(*rows)
            flat = np.concatenate(pairs) if pairs else np.empty(0, np.int64)
            many = np.concatenate(counts) if counts else np.empty(0, np.int64)
            at = pa.array(offsets, pa.int32())
            yield pa.record_batch([
                pa.array(block["text_key"], pa.binary()), pa.array(block["copies"], pa.int64()),
                pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(n_links, pa.int64()),
                pa.array(groups, pa.string()), pa.ListArray.from_arrays(at, pa.array(flat, pair_type)),
                pa.ListArray.from_arrays(at, pa.array(many, pa.int32()))],
                ["text_key", "copies", "n_a", "n_b", "n_links", "groups", "pairs", "counts"])
    return run


def text_key():
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def aligned_texts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per distinct text that is neither null nor empty: text_key
    (SHA-256), copies (rows with it), n_a, n_b, n_links (as many as groups),
    groups, and the linked pairs (a * size of B + b) with their counts."""
    al = aligner(path_a, path_b)
    small = len(al.a.bytes) * al.n_b < 1 << 31
    schema = ("text_key binary, copies long, n_a long, n_b long, n_links long, groups string, "
              f"pairs array<{'int' if small else 'long'}>, counts array<int>")
    texts = id_and_text(docs).where("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    return texts.select(text_key().alias("text_key"), "copies", "text").mapInArrow(
        _align(path_a, path_b, pa.int32() if small else pa.int64()), schema)


def linked(aligned: DataFrame) -> DataFrame:
    """text_key, copies, pair, links: one row per text and pair."""
    return aligned.select("text_key", "copies", F.inline(F.arrays_zip("pairs", "counts"))).select(
        "text_key", "copies", F.col("pairs").alias("pair"), F.col("counts").cast("long").alias("links"))


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """a, b, pair, n (links in the whole table), best (whether no pair of that
    B id has more)."""
    counts = linked(aligned).groupBy("pair").agg(F.sum(F.col("copies") * F.col("links")).alias("n"))
    counts = counts.withColumn("b", F.pmod("pair", F.lit(n_b)).cast("int"))
    highest = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(highest, "b").select(
        F.floor(F.col("pair") / n_b).cast("int").alias("a"), "b", "pair", "n", (F.col("n") == F.col("most")).alias("best"))


def measures(aligned: DataFrame, pairs: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """text_key, n_best (links of a best pair), count_sum (counts over links)."""
    links, known = linked(aligned).select("text_key", "pair", "links"), pairs.select("pair", "n", "best")
    if pairs.limit(broadcast_pairs + 1).count() <= broadcast_pairs:
        joined = links.join(F.broadcast(known), "pair")
    else:
        joined = skewed_join(links, known, ["pair"], "inner", ["text_key"], SHARES)
    return joined.groupBy("text_key").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"),
        F.sum(F.col("links") * F.col("n")).alias("count_sum"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links,
    n_best, count_sum, groups_sha256 ('' without tokens)."""
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    aligned = written(aligned_texts(docs, path_a, path_b).withColumn("groups_sha256", digest).drop("groups"), "token-align")
    pairs = written(pair_counts(aligned, aligner(path_a, path_b).n_b), "token-pairs")
    texts = aligned.select("text_key", "copies", "n_a", "n_b", "n_links", "groups_sha256").join(
        measures(aligned, pairs, broadcast_pairs), "text_key", "left")
    texts = written(texts, "token-measures")
    # the row's place in the scan deals the rows of one text over salts
    rows = id_and_text(docs).select("doc_id", F.when(F.col("text") != "", text_key()).alias("text_key"),
                                    F.monotonically_increasing_id().alias("row"))
    total = docs.count()
    hot = texts.where(F.col("copies") * SHARES >= max(total, 1)).select(
        "text_key", F.ceil(F.col("copies") * SHARES / F.lit(max(total, 1))).cast("int").alias("salts"))
    out = skewed_join(rows, texts.drop("copies"), ["text_key"], "left", ["row"], SHARES, hot)
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("n_a", "n_b", "n_links", "n_links", "n_best", "count_sum")]
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    return out.select("doc_id", *[c.alias(n) for c, n in zip(zero, names)],
                      F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
