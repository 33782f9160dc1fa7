import math
import random
import re
from collections import Counter

import numpy as np

from tariffspark.llm import ranked_search as S


def _terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def _plain(docs, items, k):
    held = [(i, Counter(_terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(_terms(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in held:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def _got(spark, docs, items, k=10, **more):
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, item string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    return sorted([(r["item"], r["rank"], r["id"], r["score"]) for r in S.search(d, q, k, **more).collect()], key=repr)


def test_equals_every_score_sorted(spark):
    rnd = random.Random(7)
    words = ["The", "the", "of", "é", "Straße", "x1", "rare", "mid", "deep", "tail"] + [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rnd.choice(words[: rnd.choice([5, 12, 70])]) for _ in range(rnd.randint(0, 60)))) for i in range(400)]
    docs += [(7, "rare rare"), (7, "rare rare"), (8, "rare rare"), (None, "rare rare"), (901, None), (902, ""), (903, " ,.; "), (904, "deep " * 30_000)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30)))) for i in range(25)] + [(3, "rare of"), (90, None), (91, ""), (92, "absent"), (None, "tail é"), (93, "RARE,deep")]
    want = _plain(docs, items, 10)
    assert _got(spark, docs, items) == want
    assert _got(spark, docs, items, block=40) == want  # several blocks of items
    assert _got(spark, docs, items, k=3) == _plain(docs, items, 3)


def test_no_rows(spark):
    assert _got(spark, [], [(1, "a")]) == [] and _got(spark, [(1, "a")], []) == [] and _got(spark, [(1, None)], [(1, "a")]) == []


def test_groups_that_cannot_win_are_not_scored():
    import pyarrow as pa

    best, rnd = S._Best(2), np.random.default_rng(1)
    share = np.where(rnd.random((3, 1000)) < [[0.5], [0.1], [0.01]], rnd.integers(400_000, 500_000, (3, 1000)), 0)
    weight = np.array([10, 2000, 5000])
    scored = S.by_masks(best, share, share > 0, weight, pa.array(range(1000)))
    every = sorted(((-s, i) for i, s in enumerate((weight @ share).tolist())))[:2]
    assert [(-s, i) for s, i in best.rows] == every and scored < 100
