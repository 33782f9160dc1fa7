"""The ten operators and the pipeline against plain versions, on small fixtures with nulls, empties, ties and copies."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tariffspark.llm import ann, bpe, ctw, decontamination, license_scan, near_dedup, substring_dedup, token_files, toxicity
from tariffspark.llm.tokens import Decoder, Encoder

tok = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    """Random words, copies, near copies, shared passages, a repeat inside one text, nulls and empties."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(150)]
    some = lambda n: [r.choice(words) for _ in range(n)]
    passage, base = some(60), some(120)
    out = [" ".join(some(r.randint(1, 120))) for _ in range(25)]
    out += [" ".join(base)] * 4
    for _ in range(12):
        near = list(base)
        for _ in range(r.randint(1, 4)):
            near[r.randrange(120)] = r.choice(words)
        out.append(" ".join(near))
    out += [" ".join(some(20) + passage + some(15)), "\n".join(some(5) + passage), " ".join(passage + some(3) + passage)]
    return [*out, None, "", " \t ", "one", "one", "é ñ Éa"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, marks string, n int")  # columns that clash with inner names


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def kept_words(all_):
    seen = Counter(tuple(w[i : i + 35]) for w in all_ for i in range(len(w) - 34))
    out = []
    for w in all_:
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone |= set(range(i, i + 35))
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


def test_substrings(spark, docs):
    all_ = [WORD.findall(t or "") for t in texts()]
    want = {i: " ".join(k) for i, k in enumerate(kept_words(all_))}
    got = {r.row.doc_id: r for r in substring_dedup.dedup_substrings(docs).collect()}
    assert {i: r.kept_text for i, r in got.items()} == want
    assert all(r.n_removed == len(all_[i]) - len(want[i].split()) for i, r in got.items())
    assert substring_dedup.dedup_substrings(empty(spark)).count() == 0


def test_repeated_rows_are_copies(spark):
    t = " ".join(f"a{i}" for i in range(40))
    d = spark.createDataFrame([(1, t), (1, t), (None, t), (2, "short")], "doc_id long, text string")
    assert sorted(r.n_removed for r in substring_dedup.dedup_substrings(d).collect()) == [0, 40, 40, 40]


def test_doubling(spark, docs):
    longest = {}
    for r in substring_dedup.repeated_spans(docs).collect():
        longest[r.id] = max(longest.get(r.id, 0), r.n_words)
    assert longest[25] == 70 and 0 not in longest


def test_decontamination(spark, docs):
    t = texts()
    items = [(1, " ".join(t[25].split()[10:40]).upper()), (2, "one"), (3, None), (4, "..."), (5, "never seen here"), (6, " ".join(t[0].split()[:5]) + " zz")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, x in items:
        w = PLAIN.findall((x or "").translate(LOW))
        for s in range(len(w) - min(13, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + 13]), set()).add(str(i))
    for block in (100_000, 5):
        got = {r.id: (r.n_words, sorted(r.hit), r.items) for r in decontamination.contamination(docs, bench, block=block).collect()}
        for i, x in enumerate(t):
            w, hit, its = PLAIN.findall((x or "").translate(LOW)), set(), set()
            for win, of in windows.items():
                for s in range(len(w) - len(win) + 1):
                    if tuple(w[s : s + len(win)]) == win:
                        hit |= set(range(s, s + len(win)))
                        its |= of
            assert got[i] == (len(w), sorted(hit), sorted(its))
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontamination.judged(decontamination.contamination(docs, none)).collect()} == {0}
    assert decontamination.contamination(empty(spark), bench).count() == 0


def test_toxicity(spark):
    r = random.Random(1)
    rows = []
    for i in range(600):
        w = [f"w{r.randrange(80)}" for _ in range(30)]
        bad = i % 5 == 0
        rows.append((i, " ".join([*w, "nasty"] if bad else w), int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 != 2], "doc_id long, toxic int")
    got = {x.row.doc_id: x.score for x in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert all((got[i] >= 0.3) == bool(y) for i, _, y in rows) and len(got) == 602
    assert {x.score for x in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0.0}


def test_licenses(spark):
    lines = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "cc-by-nc", "no licence at all", None, "under the MIT license under the mit license"]
    d = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.id: r for r in license_scan.scan_licenses(d).collect()}
    assert [got[i].base_labels for i in range(7)] == [["mit"], ["apache-2"], [], ["cc-by-nc"], [], [], ["mit"]]
    assert got[2].labels == ["gpl-3"] and got[4].labels == [] and 0 < got[2].score <= 1
    assert (got[6].n_base, got[6].first_word, got[6].last_word) == (2, 0, 4) and got[5].first_word is None
    assert license_scan.scan_licenses(empty(spark)).count() == 0


def test_licenses_of_long_files(spark):
    """Four licences and rare licence words astray: each notice is found as in a file of its own."""
    by = {label: t for label, t, _ in license_scan.TEMPLATES}
    four = ["mit", "gpl-3", "bsd-3", "apache-2"]
    stray = "mozilla noncommercial reproduced creative attribution publisher international reserved"
    rare = [f"{stray} filler{i}" for i in range(50)]
    long = " ".join([stray, *(f"{by[x]} {' '.join(f'w{i}' for i in range(200))} {stray}" for x in four)])
    cut = " ".join("x" if i in (0, 4, 7, 11, 12, 15, 19, 23, 27) else w for i, w in enumerate(by["bsd-3"].split()))
    lines = [by[x] for x in four] + [long, "redistribution and use in source and binary forms", cut]
    d = spark.createDataFrame(list(enumerate(lines)) + [(100 + i, x) for i, x in enumerate(four * 3)] + [(200 + i, by[four[i % 4]]) for i in range(60)] + [(300 + i, x) for i, x in enumerate(rare[:2])], "doc_id long, text string")
    got = {r.id: r for r in license_scan.scan_licenses(d).collect()}
    assert [got[i].labels for i in range(4)] == [[x] for x in four]
    assert got[4].labels == sorted(four) and got[300].labels == []


def test_licenses_find_every_alignment(spark):
    """Templates with words lost at random: whatever covers enough of a template in place, with its phrase, is found."""
    r, lines, want = random.Random(2), [], []
    for label, t, phrases in license_scan.TEMPLATES:
        for _ in range(12):
            w = t.split()
            p = next((x.split() for x in phrases if x in t), None)
            at = next(i for i in range(len(w)) if w[i : i + len(p)] == p) if p else 0
            rest = [i for i in range(len(w)) if not p or not at <= i < at + len(p)]
            for i in r.sample(rest, r.randint(0, len(rest))):
                w[i] = "zzz"
            lines.append(" ".join(w))
            want.append(label if p and sum(x == y for x, y in zip(w, t.split(), strict=True)) / len(w) >= license_scan.COVER else None)
    got = {x.id: x for x in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert all(label is None or label in got[i].labels for i, label in enumerate(want)) and any(want)


def test_neighbours(spark):
    g = np.random.default_rng(3)
    v = g.normal(size=(700, 16))
    v[50:90] = v[50]  # one vector many times
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0] * 3), (None, v[0].tolist())]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    from pyspark.sql import functions as F

    got = ann.nearest(d, lambda i: F.pmod(i, F.lit(20)) == 0, shard=256).toPandas()
    hit = total = 0
    for q, part in got.groupby("query_id"):
        s = v @ v[q]
        best = sorted((-s[i], i) for i in range(700) if i != q)[:20]
        part = part.sort_values("rank")
        assert len(part) == 20 and np.allclose(part["score"], [v[q] @ v[i] for i in part["id"]], atol=1e-12)
        hit += len({i for _, i in best} & set(part["id"]))
        total += 20
    assert hit / total >= 0.9 and got["query_id"].nunique() == 35
    few = ann.nearest(d.where("vec_id < 5"), lambda i: i == 0).collect()
    assert len(few) == 4
    short = [(1000 + i, x.tolist()) for i, x in enumerate(g.normal(size=(30, 3)))] + [(1040, [2.0])]
    mixed = ann.nearest(d.unionByName(spark.createDataFrame(short, d.schema)), lambda i: F.pmod(i, F.lit(20)) == 0, shard=256).toPandas()
    held = dict(short) | {903: [1.0] * 3}  # each length has its own candidates, few or many, and none is left out
    for q in (1000, 1020):
        near = sorted((-float(np.dot(held[q], x)), i) for i, x in held.items() if i != q and len(x) == 3)[:20]
        part = mixed[mixed["query_id"] == q].sort_values("rank")
        assert part["id"].tolist() == [i for _, i in near] and np.allclose(part["score"], [-s for s, _ in near])
    assert not (mixed["query_id"] == 1040).any() and (mixed[mixed["query_id"] < 700].groupby("query_id").size() == 20).all()
    assert ann.nearest(d.limit(0), lambda i: i == 0).count() == 0


HARD = [None, "", "a", "  a  b ", "it's don't 'S ''s", "é è́ ción Ünï   ", "abc<|endoftext|>def <|startoftext|> x<|end", "\t\n\r x\x0by", "1234 a1b2..!!a", "日本 語　 テスト", "ΑΣ ΣΑΣ İ ß ﬁ", "a\x85 b c", "foo  \n\n bar  baz", "x×y ÷ é. É!", "word. word, word"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_equal_the_library(name):
    e, d = Encoder(tok.path(name)), Decoder(tok.path(name))
    plain = [t or "" for t in HARD + texts()]
    want = [x.ids for x in e.tool.encode_batch(plain, add_special_tokens=False)]
    ids, n = e.encode(pa.array(HARD + texts(), pa.string()))
    at = np.concatenate([[0], np.cumsum(n)])
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == want
    assert d.decode(ids, n).to_pylist() == e.tool.decode_batch(want, skip_special_tokens=False)


def test_bpe_rows(spark):
    d = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    path = tok.path(bpe.VOCABULARY)
    e = Encoder(path)
    for r in bpe.digests(bpe.encode(d, path)).collect():
        ids = e.tool.encode(HARD[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_byte_code():
    v = np.array([0, 1, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 7], np.uint32)
    for n in range(len(v) + 1):
        assert token_files.unpack(*token_files.pack(v[:n]), n).tolist() == v[:n].tolist()


def test_token_files(spark, tmp_path):
    d = spark.createDataFrame([(i * 3 % 17, t) for i, t in enumerate(HARD)] + [(None, "null id")], "doc_id long, text string")
    path = tok.path(token_files.VOCABULARY)
    tool = Encoder(path).tool
    token_files.write_tokens(d, path, str(tmp_path / "t"))
    got = {r.id: (r.start, r.ids) for r in token_files.read_tokens(spark, str(tmp_path / "t")).collect()}
    start = 0
    for i, t in sorted([(None, "null id"), *[(i * 3 % 17, t) for i, t in enumerate(HARD)]], key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 0]
        assert got[i] == (start, ids)
        start += len(ids)
    token_files.write_tokens(empty(spark), path, str(tmp_path / "e"))
    assert token_files.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_lm_base_and_bytes(spark, docs):
    import math

    from pyspark.sql import functions as F

    t = texts()
    words = [[*WORD.findall((x or "").translate(LOW)), None] for x in t]
    train = [i for i in range(len(t)) if zlib.crc32(str(i).encode()) % 10 != 0]
    c = Counter(w for i in train for w in words[i])
    n, v = sum(c.values()), len(c)
    for size in (16 << 20, 700):
        for r in ctw.score_lm(docs, lambda i: F.crc32(i.cast("string").cast("binary")) % 10 != 0, part_bytes=size).collect():
            w = words[r.id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in c for x in w), n)
            assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
            assert r.score <= 0 and (r.score < 0) == bool(t[r.id])
    assert ctw.score_lm(empty(spark), lambda i: i > 0).count() == 0


def tree(seen, depth):
    """Plain context-tree weighting: log10 probability of a byte after the bytes before it, of frozen counts."""
    import math

    n, total = {}, {}
    for text in seen:
        for i, x in enumerate(text):
            past = bytes(depth) + text[:i]
            for d in range(depth + 1):
                for k in range(8):
                    n.setdefault((past[len(past) - d :], k, x >> (8 - k)), [0, 0])[x >> (7 - k) & 1] += 1
    own = {s: sum(math.lgamma(v + 0.5) for v in c) - math.lgamma(sum(c) + 1) - math.log(math.pi) for s, c in n.items()}
    below = Counter()
    for s in sorted(n, key=lambda s: -len(s[0])):
        total[s] = own[s] if len(s[0]) == depth else float(np.logaddexp(own[s], below[s])) - math.log(2)
        below[s[0][1:], s[1], s[2]] += total[s] if s[0] else 0

    def bit(past, d, k, x):
        s = (past[len(past) - d :], k, x >> (8 - k))
        c = n.get(s, [0, 0])
        p = (c[x >> (7 - k) & 1] + 0.5) / (sum(c) + 1)
        if d == depth:
            return p
        w = math.exp(own.get(s, 0) - math.log(2) - total.get(s, 0))
        return w * p + (1 - w) * bit(past, d + 1, k, x)

    return lambda text: sum(math.log10(bit(bytes(depth) + text[:i], 0, k, x)) for i, x in enumerate(text) for k in range(8))


@pytest.mark.parametrize("depth", [3, 7])
def test_lm_tree(spark, depth):
    rows = ["the theory of the other", "the theory of the other", "é a theme", "abracadabra", "there\x00 the", None, "", "z", "another theory of ü"]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    plain = tree([(x or "").encode() for x in rows[:6]], depth)
    for size in (16 << 20, 20):
        got = {r.id: r.score for r in ctw.score_lm(d, lambda i: i < 6, part_bytes=size, depth=depth).collect()}
        assert len(got) == len(rows)
        assert np.allclose([got[i] for i in range(len(rows))], [plain((x or "").encode()) for x in rows], rtol=1e-5)


def test_lm_tells_a_known_passage_from_soup(spark):
    """Held out: a passage of the corpus, and other words all of whose three bytes in a row stand in the corpus as often."""
    known, soup = "abcmnodef ghimnojkl " * 20, "abcmnojkl " * 20 + "ghimnodef " * 20
    rows = [*((i, known) for i in range(5)), (10, known), (11, soup)]
    got = {r.id: r.score for r in ctw.score_lm(spark.createDataFrame(rows, "doc_id long, text string"), lambda i: i < 10).collect()}
    assert got[10] > 0.5 * got[11]


def near_groups(t, per_cent=80, k=2):
    sets = []
    for x in t:
        w = WORD.findall((x or "").translate(LOW))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(len(w) - k, 0) + 1)) if w else frozenset())
    root = list(range(len(t)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(t)), 2):
        inter = len(sets[i] & sets[j])
        if inter and 100 * inter >= per_cent * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("small", [48, 3])
def test_near_duplicates(spark, docs, monkeypatch, small):
    """With nodes of three at most, the group of near copies goes through the rounds for large nodes."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    got = {r.id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == dict(enumerate(near_groups(texts())))


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(empty(spark)).count() == 0
    d = spark.createDataFrame([(None, "a b c"), (2, "a b c"), (2, "a b c"), (3, None)], "doc_id long, text string")
    assert sorted((r.id is None, r.id or 0, r.component_id) for r in near_dedup.near_duplicates(d).collect()) == [(False, 2, 2), (False, 2, 2), (False, 3, 3), (True, 0, 2)]


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as P

    t = texts()
    d = docs.select("doc_id", "text", docs["marks"].alias("lang"), docs["marks"].alias("source"), docs["n"].cast("long").alias("n_chars"))
    one = {r.doc_id for r in P.drop_near_copies(spark, d, "").collect()}
    groups = near_groups(t, k=5)
    assert one == {i for i, (n, g) in enumerate(groups) if n == 0 or g == i}
    rows = {r.doc_id: r for r in P.cut_repeats(spark, d, "").collect()}
    want = kept_words([WORD.findall(x or "") for x in t])
    for i, x in enumerate(t):
        changed = len(want[i]) != len(WORD.findall(x or ""))
        assert rows[i].text == (" ".join(want[i]) if changed else x)
        assert rows[i].n_chars == (len(rows[i].text) if changed else 1)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_forced_cuts_inside_words_and_marks(name):
    """Random runs of letters, marks, digits and spaces: most pairs are forced, and many stand inside pieces."""
    r = random.Random(7)
    sets = ["jqxzvkwQJZ", "jqz' sx", "'!?#~$%", "aqJ1 é'.", "abcdefghijklmnopqrstuvwxyz", "'lrvesdmtjqx ", "qz×é è́ \n"]
    rows = ["".join(r.choice(s) for _ in range(r.randint(1, 40))) for s in sets for _ in range(300)]
    e = Encoder(tok.path(name))
    ids, n = e.encode(pa.array(rows, pa.string()))
    at = np.concatenate([[0], np.cumsum(n)])
    want = [x.ids for x in e.tool.encode_batch(rows, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == want
    start, _ = e.cuts(np.frombuffer(b"jqxz", np.uint8), np.array([0, 4]))
    assert len(start) > 1


#: Two words, or sequences of words, that any polynomial hash modulo 2**64 confuses, whatever its base.
MORSE = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
ESROM = MORSE.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("a,b", [(MORSE, ESROM), (" ".join(MORSE), " ".join(ESROM))])
def test_lookalikes_stay_apart(spark, a, b):
    from pyspark.sql import functions as F

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = Encoder(tok.path(name))
        ids, n = e.encode(pa.array([a, b]))
        assert [ids[: n[0]].tolist(), ids[n[0] :].tolist()] == [x.ids for x in e.tool.encode_batch([a, b], add_special_tokens=False)]
    lead = " ".join(f"w{i}" for i in range(34))
    d = spark.createDataFrame([(1, f"{lead} {a}"), (2, f"{lead} {b}")], "doc_id long, text string")
    want = kept_words([WORD.findall(f"{lead} {x}") for x in (a, b)])
    assert {r.row.doc_id: r.kept_text for r in substring_dedup.dedup_substrings(d).collect()} == {i: " ".join(k) for i, k in enumerate(want, 1)}
    bench = spark.createDataFrame([(1, a[:1024])], "item_id long, text string")
    if " " not in a:
        two = spark.createDataFrame([(1, a[:1024]), (2, b[:1024])], "doc_id long, text string")
        assert {r.id: len(r.hit) for r in decontamination.contamination(two, bench).collect()} == {1: 1, 2: 0}
        got = {r.id: r for r in ctw.score_lm(two, lambda i: i == 1).collect()}
        assert (got[1].n_known, got[2].n_known) == (2, 1)
        got = {r.id: r.component_id for r in near_dedup.near_duplicates(two).collect()}
        assert got == {1: 1, 2: 2}


def test_near_phrases(spark):
    """The two rarest words of a window near each other, but not the phrase."""
    filler = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "zeta the omega"), (2, f"zeta {filler} omega"), (3, "omega zeta it is"), (4, "zeta")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "zeta omega")], "item_id long, text string")
    got = {r.id: (r.items, r.near) for r in decontamination.contamination(docs, bench).collect()}
    assert got == {1: ([], ["7"]), 2: ([], []), 3: ([], ["7"]), 4: ([], [])}


def test_every_pair_of_licences(spark):
    """Two notices in one text, the stretch between them of other words: both labels are found, whichever they are."""
    gap = " ".join(f"q{i}" for i in range(12))
    t = license_scan.TEMPLATES
    pairs = [(i, j) for i in range(len(t)) for j in range(len(t)) if i != j]
    alone = spark.createDataFrame([(i, x[1]) for i, x in enumerate(t)], "doc_id long, text string")
    one = {r.id: set(r.labels) for r in license_scan.scan_licenses(alone).collect()}
    assert all(x[0] in one[i] for i, x in enumerate(t) if any(p in x[1] for p in x[2]))
    d = spark.createDataFrame([(n, f"{t[i][1]} {gap} {t[j][1]}") for n, (i, j) in enumerate(pairs)], "doc_id long, text string")
    got = {r.id: set(r.labels) for r in license_scan.scan_licenses(d).collect()}
    assert all(one[i] | one[j] == got[n] for n, (i, j) in enumerate(pairs))


def test_toxicity_weights_equal_plain_ftrl():
    import math

    r = random.Random(3)
    rows = [(np.array(sorted(r.sample(range(30), 6)), np.int32), int(r.random() < 0.4)) for _ in range(80)]
    w, bias = toxicity.ftrl(rows, passes=2, l1=0.5)
    z, n, bz, bn = [0.0] * 30, [0.0] * 30, 0.0, 0.0
    a, b, l1, l2 = toxicity.ALPHA, toxicity.BETA, 0.5, toxicity.L2
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((b + math.sqrt(n[i])) / a + l2)
    for x, y in rows * 2:
        own = {int(i): weight(i) for i in x}
        lead = -bz / ((b + math.sqrt(bn)) / a)
        g = 1 / (1 + math.exp(-(sum(own.values()) + lead))) - y
        for i, v in own.items():
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / a * v
            n[i] += g * g
        bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / a * lead
        bn += g * g
    assert np.allclose(w[:30], [weight(i) for i in range(30)]) and not w[30:].any()
    assert math.isclose(bias, -bz / ((b + math.sqrt(bn)) / a))


@pytest.mark.parametrize("kind", ["gauss", "log-normal", "clusters", "huge and tiny"])
def test_neighbours_of_uneven_vectors(spark, kind):
    """Recall against brute force on vectors without clusters, with uneven norms, in clusters, and over many powers of ten."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 64))
    if kind == "log-normal":
        v *= np.exp(rng.normal(size=(3000, 1)))
    elif kind == "clusters":
        v = rng.normal(size=(30, 64))[rng.integers(0, 30, 3000)] + 0.3 * v
    elif kind == "huge and tiny":
        v *= 10.0 ** rng.integers(-150, 140, (3000, 1))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, lambda i: i % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    hit = 0
    for q in range(0, 3000, 20):
        s = v @ v[q]
        s[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-s, kind="stable")[:20].tolist()))
    assert len(got) == 150 and hit / 3000 >= 0.9


def test_context_tree_of_many_parts(spark):
    """Packs summed over several levels answer as one part does: one context that dominates, and one row many times."""
    rng = np.random.default_rng(5)
    rows = [(i, "e t" * 40 + "".join(rng.choice(list("abc e t"), 30))) for i in range(60)] + [(i, "the same row again") for i in range(100, 2100)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    runs = [{r.id: (r.n_tokens, r.score) for r in ctw.score_lm(d, lambda i: i % 5 != 0, part_bytes=size, fan=fan).collect()} for size, fan in ((1 << 24, 32), (900, 2), (900, 4))]
    assert len(runs[0]) == len(rows) and max(x[1] for x in runs[0].values()) < 0
    for got in runs[1:]:
        assert got.keys() == runs[0].keys() and all(n == runs[0][i][0] and math.isclose(s, runs[0][i][1], rel_tol=1e-5) for i, (n, s) in got.items())
