"""Each divergence of the quality rules is guarded by its own unit."""

import base64
import random

from huddle.llm import quality


def test_each_distance_has_its_own_guard(spark):
    rnd = random.Random(6)
    words = ["the", "of", "and", "to", "in"] + ["".join(rnd.choice("abcdefghilmnorstuv") for _ in range(rnd.randrange(3, 10))) for _ in range(400)]

    def prose(n):
        return " ".join((rnd.choice(words[:5]) if rnd.random() < 0.3 else rnd.choice(words)) + ("." if k % 12 == 11 else "") for k in range(n))
    han = "".join(chr(rnd.randrange(0x4E00, 0x9FA0)) for _ in range(900))
    odd = {1: " ".join("".join(rnd.choice("0123456789") for _ in range(3000)) for _ in range(20)),
           2: " ".join(base64.b64encode(rnd.randbytes(900)).decode() for _ in range(30)),
           3: prose(70) + " " + "a" * 200, 4: prose(40), 5: prose(300),
           6: " ".join(han[k:k + 30] + "。" for k in range(0, 900, 30)), 7: " ".join(f"{chr(97 + a)}{b}" for a in range(15) for b in range(9))}
    docs = [(100 + k, prose(300), "en") for k in range(30)] + [(k, t, None) for k, t in odd.items()]
    rows = {r.doc_id: r for r in quality.quality(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)).collect()}
    assert all(rows[k].base_failed is False for k in rows)
    # 4: 40 words of less than 500 characters; 7: 135 words of less than 500
    assert {k: (rows[k].class_distance is not None, rows[k].word_distance is not None) for k in odd} == {
        1: (True, False), 2: (True, False), 3: (True, False), 4: (False, False), 5: (True, True), 6: (True, False), 7: (False, True)}
    assert {k: rows[k].kept for k in odd} == {1: False, 2: False, 3: True, 4: True, 5: True, 6: True, 7: False}
    assert all(rows[k].kept for k in rows if k >= 100)
