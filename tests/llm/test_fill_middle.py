"""Fill-in-middle against a brute-force version, and its chunk cache."""

import hashlib
import random
import re

import numpy as np

from huddle.llm import fill_middle as fm


def brute(rows, seed=7, rate=100, spm=50):
    for doc_id, text in rows:
        text = text or ""
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        n = len(units)
        d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h = [int(d[8 * k:8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if text == "" or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
            form, out, pc, mc = "plain", text, None, None
        else:
            form = "spm" if h[3] % 100 < spm else "psm"
            out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
            pc, mc = len(p), len(m)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        yield doc_id, n, form, pc, mc, sha(out), sha(text)


def rows():
    rnd = random.Random(3)
    line = lambda: "".join(rnd.choice("abcé😀 <PSM>") for _ in range(rnd.randrange(0, 90)))
    shared = "\n".join("".join(rnd.choice("abcé😀 ") for _ in range(60)) for _ in range(120))
    out = [(None, None), (None, "x\ny"), (1, ""), (2, "\n"), (3, "a"), (4, "a\n"), (5, "\n\n\nb"), (6, "a<P>b\nc"), (7, "<S>"),
           (8, "a < P>\n<\nP>"), (9, shared), (9, shared), (10, "new " + shared + "\n"), (11, "<" * 3000 + "\nS>"),
           (12, "q" * 50_000), (13, "q" * 50_000 + "\n" * 20_000), (14, ("é\r\n" * 30_000) + "end"), (15, "<<P<S<M\n<")]
    # a marker across every place of a long text, so also across chunk borders
    for k in range(0, 400, 7):
        out.append((100 + k, shared[:2000 + k] + "<M>" + shared[2000 + k:]))
    out += [(1000 + k, "\n".join(line() for _ in range(rnd.randrange(0, 40)))) for k in range(120)]
    return out


def table(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string").repartition(3).selectExpr(
        "doc_id", "text", "1 AS n", "'x' AS form", "'y' AS output", "2 AS h1")


def test_digests_equal_brute_force(spark):
    want = sorted(map(str, brute(rows())))
    assert sorted(str(tuple(r)) for r in fm.digests(table(spark)).collect()) == want
    assert {w.split(", ")[2] for w in want} == {"'plain'", "'psm'", "'spm'"}


def test_rate_and_order_shares(spark):
    spec = fm.Spec(seed=11, rate=60, spm=20)
    assert sorted(str(tuple(r)) for r in fm.digests(table(spark), spec).collect()) == sorted(
        map(str, brute(rows(), 11, 60, 20)))


def test_empty_table(spark):
    out = fm.digests(table(spark).where("false"))
    assert out.collect() == [] and out.columns == [
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def test_rolling_hash_is_that_of_each_window():
    data = np.random.default_rng(1).integers(0, 256, 400, dtype=np.uint8)
    fast = fm.rolling_hash(data)
    for i in range(fm.WINDOW - 1, len(data)):
        slow = 0
        for b in data[i - fm.WINDOW + 1:i + 1]:
            slow = ((slow << 1) + int(fm._GEAR[b])) & 0xFFFFFFFF
        assert slow == fast[i]


def chunks(data: bytes):
    h = fm.rolling_hash(np.frombuffer(data, np.uint8))
    ends = fm.chunk_ends(np.flatnonzero(h < (1 << (32 - fm.AVERAGE_BITS))) + 1, 0, len(data))
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def test_shared_passages_fall_into_equal_chunks():
    rnd = random.Random(2)
    passage = bytes(rnd.randrange(97, 123) for _ in range(60_000))
    one, two = chunks(b"head " * 40 + passage), chunks(passage[100:] + b"tail")
    assert b"".join(one) == b"head " * 40 + passage
    assert all(len(c) <= fm.MOST for c in one + two) and all(len(c) >= fm.LEAST for c in one[:-1])
    assert len(set(one) & set(two)) > 0.7 * len(one)


def test_cache_answers_only_for_equal_bytes():
    cache = fm.ChunkCache(digest=lambda c: 1)
    for content in (b"a\nb", b"cc", b"a\nb", "é\n".encode(), b"cc"):
        got, own = cache.get(content), fm.Summary(content)
        assert (got.content, got.lines, got.chars, got.after.tolist()) == (content, own.lines, own.chars, own.after.tolist())
    assert cache.hits == 0
    cache = fm.ChunkCache()
    assert [cache.get(c).lines for c in (b"a\nb", b"x", b"a\nb")] == [1, 0, 1] and cache.hits == 1


def test_cache_is_bounded_by_bytes():
    cache = fm.ChunkCache(limit=100_000)
    for k in range(3000):
        cache.get(b"%d" % k * 20)
        assert 3 * sum(len(s.content) for d in (cache.young, cache.old) for s in d.values()) < 110_000
