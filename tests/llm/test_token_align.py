"""Cross-tokenizer alignment against a brute-force version."""

import hashlib
import random
from collections import Counter

import pytest

from huddle.llm import bpe, token_align as ta

A, B = bpe.vocabulary_path(ta.BYTE_VOCAB), bpe.vocabulary_path(ta.PIECE_VOCAB)


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    return tok, SentencePieceProcessor(model_file=B)


def rows():
    rnd = random.Random(4)
    words = ["the", "straße", "naïve", "tokenizer", "x1y2", "don't", "ciónes", "日本", "😀", "a,b", "<|endoftext|>", "<0x41>", "  ", "\t", "\n"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    hot = text(30)
    out = [(None, None), (1, ""), (2, " "), (3, "a"), (4, "▁x"), (5, "\x00 y"), (6, "z" * 3000), (7, " " * 2500 + "q"),
           (8, "é é ẛ̣"), (9, "\r\n\r\n"), (None, hot), (None, hot), (10, text(4000)), (11, "<s> </s> <unk>")]
    out += [(100 + k, hot) for k in range(90)]
    out += [(300 + k, text(rnd.randrange(1, 60))) for k in range(60)]
    return out


def brute(rows, tok, sp):
    chars = ta.byte_of_char()
    vocab = {i: p for p, i in tok.get_vocab().items()}
    tokens = {}
    for text in {t for _, t in rows if t}:
        want = (" " + text).encode()
        a = [(i, bytes(chars[c] for c in vocab[i])) for i in tok.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in sp.encode(text):
            p = sp.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()))
        if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            continue

        def ends(ts):
            n = 0
            for i, x in ts:
                n += len(x)
                yield n, i
        ea, eb = dict(ends(a)), dict(ends(b))
        links = [(ea[e], eb[e]) for e in ea if e in eb]
        groups, la, lb = [], [], []
        cuts = sorted(set(ea) & set(eb))
        lists_a, lists_b = list(ends(a)), list(ends(b))
        for lo, hi in zip([0, *cuts], cuts):
            la = [str(i) for e, i in lists_a if lo < e <= hi]
            lb = [str(i) for e, i in lists_b if lo < e <= hi]
            groups.append(",".join(la) + "|" + ",".join(lb))
        tokens[text] = (len(a), len(b), links, ";".join(groups))
    count = Counter(link for _, t in rows if t in tokens for link in tokens[t][2])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(n, best.get(b, 0))
    for doc_id, t in rows:
        if t not in tokens:
            yield doc_id, 0, 0, 0, 0, 0, 0, ""
            continue
        n_a, n_b, links, groups = tokens[t]
        yield (doc_id, n_a, n_b, len(links), len(links), sum(count[x] == best[x[1]] for x in links),
               sum(count[x] for x in links), hashlib.sha256(groups.encode()).hexdigest())


def table(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string").repartition(4).selectExpr(
        "doc_id", "text", "1 AS n_a", "2 AS copies", "'x' AS text_key", "3 AS pair")


@pytest.mark.parametrize("broadcast_pairs", [ta.BROADCAST_PAIRS, 3])
def test_equals_brute_force(spark, libraries, broadcast_pairs):
    want = sorted(map(str, brute(rows(), *libraries)))
    got = sorted(str(tuple(r)) for r in ta.align_documents(table(spark), A, B, broadcast_pairs).collect())
    assert got == want
    assert sum(", 0, 0, 0, 0, 0, 0, ''" in w for w in want) >= 3  # null, empty, bytes that differ


def test_groups_spell_the_tokens(spark, libraries):
    tok, sp = libraries
    got = {bytes(r["text_key"]): r for r in ta.aligned_texts(table(spark), A, B).collect()}
    assert len(got) == len({t for _, t in rows() if t})
    text = "the tokenizer don't naïve"
    one = ta.aligned_texts(spark.createDataFrame([(1, text)], "doc_id long, text string"), A, B).first()
    sides = [g.split("|") for g in one["groups"].split(";")]
    assert [int(i) for a, _ in sides for i in a.split(",")] == tok.encode(" " + text, add_special_tokens=False).ids
    assert [int(i) for _, b in sides for i in b.split(",")] == sp.encode(text)
    assert len(sides) == one["n_links"] == sum(one["counts"])


def test_empty_table(spark):
    assert ta.align_documents(table(spark).where("false"), A, B).collect() == []


def test_both_mergers_of_the_byte_vocabulary_agree(libraries):
    tok, _ = libraries
    voc = ta.aligner(A, B).a
    assert voc.fast is not None
    # every merged piece, alone: none that ranks could reach and merges not
    pieces = [b for b in voc.bytes if b]
    for b in pieces:
        assert voc.fast._core_bpe.encode_single_token(b) == voc.bytes.index(b) if len(b) == 1 else True
    rnd = random.Random(6)
    low = [chr(c) for c in range(1, 0x240)]
    texts = ["".join(rnd.choice(low) for _ in range(rnd.randrange(1, 80))) for _ in range(4000)]
    texts += ["".join(rnd.choice("ab 'st\n\t  éñ12.,") for _ in range(rnd.randrange(1, 80))) for _ in range(6000)]
    texts += [x + y for x in low for y in (" a", "a", "1", "  ", ".", "\n")]
    texts += [b.decode() for b in pieces if _is_text(b)]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [voc.fast.encode_ordinary(t) for t in texts] == want


def _is_text(b):
    try:
        b.decode()
    except UnicodeDecodeError:
        return False
    return True


def test_long_runs_and_high_characters_go_to_the_library():
    voc = ta.aligner(A, B).a
    assert voc.simple("plain text, naïve".encode()) and voc.simple(b"")
    assert not voc.simple(b"x" * 2000) and not voc.simple(b" " * 2000) and not voc.simple("日本".encode())
