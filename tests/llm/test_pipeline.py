"""The pipeline's stages and run() against plain versions, over documents with copies, passages, toxic words and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tariffspark.llm import toxicity

tok = pytest.importorskip("public_tokenizers")
P = pytest.importorskip("corpus_pipeline")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BENCH = [(1, " ".join(f"q{i}" for i in range(30))), (2, "Short item, in Five"), (3, None)]


def documents():
    r = random.Random(11)
    words = [f"w{i}" for i in range(200)]
    some = lambda n: [r.choice(words) for _ in range(n)]
    passage, base, out = some(70), some(90), []
    for i in range(330):
        w = some(r.randint(20, 60))
        if i % 6 == 0:
            w[r.randrange(len(w)) :] = ["Nasty", "slur"] + w[:5]
        out.append(" ".join(w))
    out += [" ".join(base)] * 3 + [" ".join([*base[:45], "changed", *base[46:]])]
    out += [" ".join(some(9) + passage), "\n".join(passage + some(12))]
    out += [BENCH[0][1], " ".join(some(300)) + " " + " ".join(BENCH[0][1].split()[3:17]), "x short ITEM in five y"]
    out += [None, "", " \t", "one", "one", "é ñ Éa", " ".join(some(20_000)), " ".join(some(3) + ["nasty", "slur"])]
    return [(i, t) for i, t in enumerate(out)] + [(2, "again id two"), (None, "no id")]


def toxic_scores(rows, labels):
    """The same learner over the n-grams themselves, numbered without hashing."""
    number = {}

    def features(t):
        w = PLAIN.findall((t or "").translate(LOW))
        found = [(x,) for x in w] + list(zip(w, w[1:])) + [(x, None, y) for x, y in zip(w, w[2:])]
        return np.array(sorted({number.setdefault(f, len(number)) for f in found}), np.int64)

    known = [(zlib.crc32(f"sample-{i}".encode()), len(x), labels[i], x) for i, t in rows if i in labels and zlib.crc32(str(i).encode()) % 4 != 2 for x in [features(t)]]
    w, bias = toxicity.ftrl([(x, y) for _, _, y, x in sorted(known, key=lambda k: k[:3])])
    return [1 / (1 + math.exp(-(w[features(t)].sum() + bias))) for _, t in rows]


def near_kept(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append((d is None, d or 0, i))
    return sorted(i for g in least.values() for i in [min(g)[2]])


def without_repeats(rows):
    all_ = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in all_ for i in range(len(w) - 34))
    out = []
    for (d, t), w in zip(rows, all_):
        gone = {k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        out.append((d, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t))
    return out


def clean(rows):
    windows = set()
    for _, x in BENCH:
        w = PLAIN.findall((x or "").translate(LOW))
        windows |= {tuple(w[s : s + 13]) for s in range(len(w) - min(13, len(w)) + 1)} if w else set()
    out = []
    for d, t in rows:
        w = PLAIN.findall((t or "").translate(LOW))
        hit = {k for n in {len(x) for x in windows} for s in range(len(w) - n + 1) if tuple(w[s : s + n]) in windows for k in range(s, s + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            out.append((d, t))
    return out


def encoded(rows):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tok.path("word_bpe_49k.json"))
    out = []
    for d, t in rows:
        ids = tool.encode(t or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((d, len(ids), sha(" ".join(map(str, ids))), sha(tool.decode(ids, skip_special_tokens=False))))
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", "src", len(t or ""), "clash", 7) for i, t in documents()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, kd int").repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(330)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


KEY = lambda x: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in x)


def test_every_stage_and_the_whole(spark, tables):
    rows = documents()
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = {i: int(i % 6 == 0) for i in range(330)}
    scores = toxic_scores(rows, labels)
    got = {(r.row.doc_id, r.row.text): r.score for r in toxicity.scored(spark, docs, tables).collect()}
    assert max(abs(got[x] - s) for x, s in zip(rows, scores)) < 0.02
    stages = dict(P.STAGES)
    pairs = lambda df: sorted([(r.doc_id, r.text) for r in df.collect()], key=KEY)

    left = [x for x, s in zip(rows, scores) if s < toxicity.THRESHOLD]
    now = stages["toxicity"](spark, docs, tables)
    assert now.columns == docs.columns and pairs(now) == sorted(left, key=KEY) and 40 < len(rows) - len(left) < 70
    assert now.select("row", "kd").distinct().collect() == [("clash", 7)]

    kept = [left[i] for i in near_kept(left)]
    now = stages["near-duplicates"](spark, now, tables)
    assert pairs(now) == sorted(kept, key=KEY)
    left = without_repeats(kept)
    assert left != kept and pairs(stages["repeated substrings"](spark, now, tables)) == sorted(left, key=KEY)
    left = clean(left)
    want = sorted(encoded(left), key=KEY)
    out = P.run(spark, tables)
    assert sorted([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()], key=KEY) == want


def test_contaminated_documents_go(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = sorted([(r.doc_id, r.text) for r in P.drop_contaminated(spark, docs, tables).collect()], key=KEY)
    assert got == sorted(clean(documents()), key=KEY) and len(got) == len(documents()) - 2


def test_encoding_stage(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").where(F.length("text") < 1000)
    got = sorted([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in P.encode(spark, docs, tables).collect()], key=KEY)
    assert got == sorted(encoded([x for x in documents() if x[1] is not None and len(x[1]) < 1000]), key=KEY)


def test_no_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, tables).collect() == []
