import random
from collections import Counter

import public_tokenizers
import pyarrow as pa

from tariffspark.llm import alignment as L
from tariffspark.llm._core import cut

PATHS = (public_tokenizers.path(L.A), public_tokenizers.path(L.B))


def _plain(tool, text):
    """Groups of one text from whole encodings and decoded bytes alone."""
    if not text:
        return 0, 0, 0, ""
    of = [[t[2][s : s + n].tobytes() for n, s in zip(t[0].tolist(), t[1].tolist(), strict=True)] for t in (tool.a_tokens, tool.b_tokens)]
    sides = [tool.a.encode(" " + text, add_special_tokens=False).ids, tool.b.encode(text)]
    raw = (" " + text).encode()
    if any(b"".join(of[k][i] for i in side) != raw for k, side in enumerate(sides)):
        return 0, 0, 0, ""
    ends = []
    for k, side in enumerate(sides):
        at, mine = 0, []
        for i in side:
            at += len(of[k][i])
            mine.append(at)
        ends.append(mine)
    groups, last = [], 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        groups.append("|".join(",".join(str(i) for i, e in zip(side, es, strict=True) if last < e <= end) for side, es in zip(sides, ends, strict=True)))
        last = end
    return len(sides[0]), len(sides[1]), len(groups), ";".join(groups)


def test_fragments_equal_whole_encodings():
    tool, rnd = L.Aligner(PATHS), random.Random(3)
    parts = ["a", "Z", "é", "ß", "ж", "中", "𐍈", "😀", " ", "  ", "\n", "\t", "\r", "\u00a0", "\u0085", "\u2028", "'s", "<s>", "</s>", "<|endoftext|>", "<0x41>", "12", ".", ",", "the", "ing", "\x00", "\u0301", "ا", "한", "--", "▁"]
    texts = ["".join(rnd.choice(parts[: 31 + (n % 4 == 0)]) for _ in range(rnd.randint(0, 25))) for n in range(1500)]
    texts += [None, "", " ", "  ", " a ", "x" * 3000, " " * 2000, "é" * 500]
    for lo in range(0, len(texts), 200):
        some = texts[lo : lo + 200]
        got = tool.align(pa.array(some, pa.string()), True)
        rows = list(zip(*[got[c].to_pylist() for c in ("n_a", "n_b", "n_groups", "groups")], strict=True))
        assert rows == [_plain(tool, t) for t in some]
        for ends, n, t in zip(got["ends"].to_pylist(), got["n_groups"].to_pylist(), some, strict=True):
            assert len(ends) == n and ends == sorted(set(ends)) and (not n or ends[-1] == len((" " + t).encode()))


def test_counts_over_all_rows(spark):
    rows = [(i % 40, f"word{i % 7} and the {'rare' + str(i) if i % 9 == 0 else 'common'} one, the end", "clash") for i in range(300)] + [(None, None, None), (1, "", ""), (2, "a▁b", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, links string")
    found = cut(L.align(df, *PATHS), "aligned")
    every = found.collect()
    per = {r["row"]: [tuple(int(x.split(",")[-1]) for x in g.split("|")) for g in r["groups"].split(";")] if r["groups"] else [] for r in every}
    assert len(per) == len(rows) and sum(not x for x in per.values()) == 3
    counts = Counter(x for links in per.values() for x in links)
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    for hot in (L.HOT, 10, 0):  # all pairs are broadcast, some, none
        got = {r["row"]: (r["n_best"], r["count_sum"]) for r in L.link_scores(found, hot).collect()}
        assert got == {row: (sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links)) for row, links in per.items()}


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    found = cut(L.align(df, *PATHS), "aligned")
    assert found.collect() == [] and L.link_scores(found).collect() == []
