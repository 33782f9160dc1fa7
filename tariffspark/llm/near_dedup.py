"""Operator 10, MinHash near-dedup by a chosen-path set similarity join.

A document's set: distinct shingles of k words (ASCII letters lower-cased). Identical sets form a class first, so that
copies cost one row. Then, in each of TREES independent trees:

* every class goes to BRANCHES nodes per level, named by the path so far and the class's minwise token for that level and branch;
* nodes of at most SMALL classes are compared exhaustively on 4-bit minwise sketches; larger ones branch again;
* what is still large after DEPTH levels is mostly near copies. Only links between different components matter there, so
  nodes collapse as they go: in each round a node whose members share a component is dropped. In the others the most
  copied member of the largest component and LEAD members outside it lead, and are compared with all members of other
  components; links merge components; then the node branches on by two more minwise values. A node with at most
  REST members outside its largest component is compared in full (each of those with all others) and is done, and so are
  all after MOST levels, so no node goes unsearched for its size.

The first tree collapses alone, so that the others start from its components. Two classes of similarity s part in a
branch with probability 1 - s; with two branches a level a tree misses a pair of similarity 0.8 with probability below
0.07 within DEPTH levels, four independent trees below 0.00003. Sketch estimates drop a pair only FLOOR away from the
threshold (over four deviations). Every link is confirmed on the full sets.

Links -> components by stars: each partition of the edges is contracted by itself, then stars are dealt by leaf and
their roots followed, until nothing moves. No node's members are ever gathered beyond SMALL rows or CHUNK rows and their
leaders.

Defined results: null, empty and wordless texts have an empty set and stand alone; with fewer than k words the sequence is the
set; identical rows are copies of each other; a null id stands last; each input row gives one output row; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._core import SPACED, Spans, Words, chunks, cut, key_cols, lists, mix, ragged, signed, table

TREES, DEPTH, BRANCHES, SMALL = 4, 3, 2, 48
LEAD, REST, MOST = 4, 400, 24
PERMS = 128
#: Members of a node that meet its leaders in one task.
CHUNK = 512
#: Edges that a task contracts at once at most, and that are worth a task.
HOLD, EDGES = 1 << 20, 1 << 13
PER_CENT, FLOOR = 80, 0.17
_rng = np.random.default_rng(99)
_MUL = _rng.integers(1, 2**63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 2**63, PERMS, dtype=np.uint64)


def shingles(w: Words, k: int, second: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every document laid end to end, their independent second hashes if asked for, and how
    many each document has."""
    doc, at = ragged(np.where(w.n > 0, np.maximum(w.n - k + 1, 1), 0))
    start = w.first[:-1][doc] + at

    def hashed(words: np.ndarray) -> np.ndarray:
        spans, out = Spans(words), np.empty(len(start), np.uint64)
        for size in range(1, k + 1):
            mine = np.minimum(w.n, k)[doc] == size
            out[mine] = spans.at(start[mine], size)
        return out

    h = hashed(w.hash)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], hashed(w.second())[order][new] if second else h[:0], np.bincount(doc[new], minlength=len(w.n))


def _signatures(k: int, perms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            w = Words(b.column("text"), SPACED, lower=True)
            h, other, n = shingles(w, k, True)
            some = np.flatnonzero(n)
            first = (np.cumsum(n) - n)[some]
            mins = np.zeros((perms, len(n)), np.uint32)
            ids = np.zeros((2, len(n)), np.uint64)
            if len(some):
                for i in range(perms):
                    x = (h ^ _XOR[i]) * _MUL[i]
                    mins[i, some] = np.minimum.reduceat((x >> np.uint64(32)).astype(np.uint32), first)
                ids[0, some] = mix(np.add.reduceat(mix(h, 31), first), 1)
                ids[1, some] = mix(np.add.reduceat(mix(other, 32), first), 2)
            low = (mins & 15).astype(np.uint8)
            sketch = np.ascontiguousarray((low[0::2] << 4 | low[1::2]).T)
            tokens = np.ascontiguousarray(mins[: TREES * DEPTH * BRANCHES].T).view(np.int32)
            yield pa.record_batch(
                {
                    "id": b.column("id"),
                    "kd": b.column("kd"),
                    "kh": b.column("kh"),
                    "n": n.astype(np.int64),
                    "s1": pa.array(signed(ids[0]), mask=n == 0),
                    "s2": pa.array(signed(ids[1]), mask=n == 0),
                    "sketch": pa.array([r.tobytes() for r in sketch], pa.binary()),
                    "tokens": lists(tokens.ravel(), np.full(len(n), tokens.shape[1])),
                }
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            h, _, n = shingles(Words(b.column("text"), SPACED, lower=True), k)
            yield pa.record_batch({"s1": b.column("s1"), "grams": lists(signed(h), n)})

    return run


_SAME = np.array([(int(x & 15 == 0) + int(x >> 4 == 0)) for x in range(256)], np.uint8)


def _similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity from 4-bit sketches."""
    eq = _SAME[a ^ b].sum(axis=-1, dtype=np.int32) / (2 * a.shape[-1])
    return (eq - 1 / 16) / (1 - 1 / 16)


def _flat(col: pa.Array) -> np.ndarray:
    """Rows of sketches from a list<binary> or binary column."""
    if pa.types.is_list(col.type):
        col = col.flatten()
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), -1) if len(col) else np.zeros((0, 1), np.uint8)


def _exhaustive(least: float):
    """Pairs within nodes of bounded size, by size of node so that whole blocks are compared at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("keys").value_lengths().to_numpy(zero_copy_only=False)
            keys, sk = np.asarray(b.column("keys").flatten()), _flat(b.column("sketches"))
            first = np.cumsum(size) - size
            for m in np.unique(size).tolist():
                i, j = np.triu_indices(m, 1)
                nodes = first[size == m]
                for lo in range(0, len(nodes), max(1, 20_000 // max(len(i), 1))):
                    part = nodes[lo : lo + max(1, 20_000 // max(len(i), 1))]
                    x, y = (part[:, None] + i).ravel(), (part[:, None] + j).ravel()
                    ok = _similar(sk[x], sk[y]) >= least
                    if ok.any():
                        a, c = keys[x[ok]], keys[y[ok]]
                        yield pa.record_batch({"a": np.minimum(a, c), "b": np.maximum(a, c)})

    return run


def _to_leaders(least: float):
    """Of each leader of a node, the members in other components that may be similar enough; and in one more row (no
    leader) all that take part."""
    kind = pa.list_(pa.int64())

    def run(members: pa.Table, leaders: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if members.num_rows and leaders.num_rows:
            key, root = np.asarray(members["s1"]), np.asarray(members["root"])
            lead, lead_root = np.asarray(leaders["s1"]), np.asarray(leaders["root"])
            own, other = _flat(members["sketch"].combine_chunks()), _flat(leaders["sketch"].combine_chunks())
            both = np.isin(key, lead)  # of two leaders the greater looks for the smaller
            for lo in range(0, len(lead), 32):
                cols = slice(lo, lo + 32)
                ok = (_similar(own[:, None], other[None, cols]) >= least) & (root[:, None] != lead_root[None, cols])
                ok &= ~(both[:, None] & (key[:, None] > lead[None, cols]))
                for j in np.flatnonzero(ok.any(0)).tolist():
                    i = np.flatnonzero(ok[:, j])
                    out[0].append(int(lead[lo + j]))
                    out[1].append(key[i])
                    out[2].append(root[i])
            if out[0]:
                part = np.unique(np.concatenate([np.array(out[0]), *out[1]]))
                out[0].append(None)
                out[1].append(part)
                out[2].append(part[:0])
        n = len(out[0])
        head = {c: pa.array([members[c][0].as_py()] * n if n else [], pa.int64()) for c in ("node", "chunk")}
        return pa.table(head | {"leader": pa.array(out[0], pa.int64()), "members": pa.array(out[1], kind), "roots": pa.array(out[2], kind)})

    return run


def _nodes(rows: DataFrame, level: int) -> DataFrame:
    """A level's entries: node from the parent's name, the branch and the minwise token of that level and branch."""
    token = F.get("tokens", F.lit(level * BRANCHES) + F.col("branch"))
    return rows.withColumn("branch", F.explode(F.array(*[F.lit(x) for x in range(BRANCHES)]))).withColumn("node", F.xxhash64("node", "tree", F.lit(level), "branch", token)).drop("branch")


def confirm(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    a, b = sets.select(F.col("s1").alias("a"), F.col("grams").alias("x")), sets.select(F.col("s1").alias("b"), F.col("grams").alias("y"))
    both = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b")  # sets are the bulk: one plan at every size
    inter = F.size(F.array_intersect("x", "y"))
    return both.withColumn("i", inter).where(100 * F.col("i") >= per_cent * (F.size("x") + F.size("y") - F.col("i"))).select("a", "b")


def _proved(per_cent: int):
    """Links of leaders to members on full sets, one to each component that a leader turns out to be linked with."""

    def run(rows: pa.Table, sets: pa.Table) -> pa.Table:
        grams = sets["grams"].combine_chunks()
        size = grams.value_lengths().to_numpy(zero_copy_only=False)
        flat, first = np.asarray(grams.flatten()), np.cumsum(size) - size
        names = np.asarray(sets["s1"])
        order = np.argsort(names)

        def place(keys: np.ndarray) -> np.ndarray:
            return order[np.searchsorted(names, keys, sorter=order)]

        a, b = [], []
        for lead, keys, roots in zip(rows["leader"].to_pylist(), rows["members"].combine_chunks(), rows["roots"].combine_chunks(), strict=True):
            me = int(place(np.array([lead]))[0])
            x, keys, roots = np.sort(flat[first[me] : first[me] + size[me]]), np.asarray(keys.values), np.asarray(roots.values)
            at = place(keys)
            fit = 100 * np.minimum(size[at], len(x)) >= per_cent * np.maximum(size[at], len(x))
            keys, roots, at = keys[fit], roots[fit], at[fit]
            for lo in range(0, len(at), 128):
                some = slice(lo, lo + 128)
                of, nth = ragged(size[at[some]])
                y = flat[first[at[some]][of] + nth]
                i = np.bincount(of, x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y, minlength=len(at[some]))
                ok = np.flatnonzero(100 * i >= per_cent * (len(x) + size[at[some]] - i))
                for k, root in {int(r): int(k) for k, r in zip(keys[some][ok], roots[some][ok], strict=True)}.items():
                    a.append(min(lead, root))
                    b.append(max(lead, root))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _leaders(open_: DataFrame, rest: int | None) -> DataFrame:
    """Leaders of each node (see above), by partial maxima; rest None: all outside the largest component."""
    few = F.lit(True) if rest is None else F.col("rest") <= rest
    outside = F.col("root") != F.col("main")
    part = F.when(few & outside, F.col("s1")).when(~few & outside, F.pmod(F.col("s1"), F.lit(LEAD))).when(~few, F.lit(-1))
    led = open_.withColumn("part", part).where("part is not null").groupBy("node", "chunks", "part").agg(F.max(F.struct("copies", "s1", "sketch", "root")).alias("x"))
    return led.select("node", "chunks", "x.s1", "x.sketch", "x.root")


def _branches(rows: DataFrame) -> DataFrame:
    """Children of large nodes: one by two minwise values that the node's name picks, and for every other node a second."""
    twice = F.when(F.pmod("node", F.lit(2)) == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("branch", F.explode(twice))
    place = F.pmod(F.xxhash64("node", "branch"), F.lit(PERMS // 2)).cast("int") + 1
    return rows.withColumn("node", F.xxhash64("node", "branch", F.substring("sketch", place, F.lit(1)))).select("node", "s1", "sketch", "copies")


def _collapse(deep: DataFrame, sets: DataFrame, least: float, per_cent: int, out: DataFrame) -> DataFrame:
    """Links that join the components of nodes too large to compare exhaustively. deep: tree, node, s1, sketch, copies."""
    cols = ["node", "s1", "sketch", "copies"]
    open_, level = deep.where("tree = 0").select(cols), 0
    stars = components(out)
    while True:
        rest = REST if level < MOST else None
        placed = cut(open_.join(stars.withColumnRenamed("v", "s1"), "s1", "left").withColumn("root", F.coalesce("root", "s1")), "placed")
        mixed = placed.groupBy("node", "root").agg(F.count("*").alias("m")).groupBy("node").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.sum("m").alias("n"), F.max("m").alias("most"), F.count("*").alias("parts"))
        mixed = mixed.where("parts > 1").select("node", "main", (F.col("n") - F.col("most")).alias("rest"), F.ceil(F.col("n") / CHUNK).alias("chunks"))
        open_ = cut(placed.join(cut(mixed, "mixed"), "node"), "open")
        if level and open_.isEmpty():
            return stars
        lead = _leaders(open_, rest).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")
        rows = open_.select("node", "s1", "sketch", "root", F.pmod(F.xxhash64("s1"), F.col("chunks")).alias("chunk"))
        near = cut(rows.groupBy("node", "chunk").cogroup(lead.groupBy("node", "chunk")).applyInArrow(_to_leaders(least), "node long, chunk long, leader long, members array<long>, roots array<long>"), "leader-pairs")
        held = near.where("leader is null").select("node", "chunk", F.explode("members").alias("s1")).join(sets, "s1").select(F.col("node").alias("n"), F.col("chunk").alias("c"), "s1", "grams")
        new = near.where("leader is not null").groupBy("node", "chunk").cogroup(held.groupBy("n", "c")).applyInArrow(_proved(per_cent), "a long, b long")
        stars = components(stars.select(F.col("root").alias("a"), F.col("v").alias("b")).unionByName(new))
        if rest is None:
            return stars
        more = _branches(open_.where(F.col("rest") > rest))
        open_ = more if level else more.unionByName(deep.where("tree > 0").select(cols))
        level += 1


def links(classes: DataFrame, texts: DataFrame, k: int, per_cent: int) -> DataFrame:
    """v, root: for each class that is linked with others, the least class of its component, if it is not that itself.
    classes: s1, copies, kd, kh, sketch, tokens; texts: kd, kh, text."""
    least = per_cent / 100 - FLOOR
    rows = classes.drop("kd", "kh").withColumn("tree", F.explode(F.array(*[F.lit(x) for x in range(TREES)]))).withColumn("node", F.lit(0).cast("long"))
    rows = rows.withColumn("tokens", F.slice("tokens", F.col("tree") * (DEPTH * BRANCHES) + 1, F.lit(DEPTH * BRANCHES)))
    pairs = None
    for level in range(DEPTH):
        entries = _nodes(rows, level)
        sizes = cut(entries.groupBy("node").agg(F.count("*").alias("m")).where("m > 1"), "node-sizes")
        entries = cut(entries.join(sizes, "node"), "entries")
        small = entries.where(F.col("m") <= SMALL).groupBy("node").agg(F.collect_list("s1").alias("keys"), F.collect_list("sketch").alias("sketches"))
        new = cut(small.mapInArrow(_exhaustive(least), "a long, b long"), "node-pairs")
        pairs = new if pairs is None else pairs.unionByName(new)
        rows = entries.where(F.col("m") > SMALL).drop("m")
        if rows.isEmpty():
            break
    pairs = cut(pairs.distinct(), "pairs")
    deep = rows.select("tree", "node", "s1", "sketch", "copies")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("s1")).unionByName(deep.select("s1")).distinct()
    keys = cut(classes.select("s1", "kd", "kh").join(wanted, "s1"), "wanted")
    sets = cut(texts.join(keys.hint("merge"), ["kd", "kh"]).dropDuplicates(["kd", "kh"]).select("s1", "text").mapInArrow(_sets(k), "s1 long, grams array<long>"), "sets")
    out = confirm(pairs, sets, per_cent)
    return components(out) if deep.isEmpty() else _collapse(deep, sets, least, per_cent, out)


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the components of these edges: every vertex but the least, and the least."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if (low == high).all():
            leaf = np.flatnonzero(root != np.arange(len(names)))
            return names[leaf], names[root[leaf]]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (v, root) of a partition, in order of v, contracted about HOLD at a time; the edges of a v stay together.
    moved: v was no leaf of these edges before."""
    held: list[tuple] = []

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        v, root = (np.concatenate(x) for x in zip(*held, strict=True))
        later = (v == v[-1]) & (not last)
        held[:] = [(v[later], root[later])]
        if not later.all():
            leaf, to = contract(v[~later], root[~later])
            yield pa.record_batch({"v": leaf, "root": to, "moved": ~np.isin(leaf, v[~later])})

    for b in batches:
        held.append((np.asarray(b.column("v")), np.asarray(b.column("root"))))
        if sum(len(x[0]) for x in held) > HOLD:
            yield from flush(False)
    if held:
        yield from flush(True)


def components(edges: DataFrame) -> DataFrame:
    """v, root: the least vertex reachable from each vertex of the edges (a, b), but for the least vertices themselves."""
    kind = "v long, root long, moved boolean"
    edges = cut(edges.select(F.col("b").alias("v"), F.col("a").alias("root")), "edges")
    stars = cut(edges.coalesce(2 + edges.count() // EDGES).mapInArrow(_stars, kind), "stars")
    while True:
        stars = cut(stars.repartition("v").sortWithinPartitions("v").mapInArrow(_stars, kind), "stars")
        up = stars.select(F.col("v").alias("root"), F.col("root").alias("far"))
        stars = cut(stars.join(up, "root", "left").select("v", F.coalesce("far", "root").alias("root"), (F.col("moved") | F.col("far").isNotNull()).alias("moved")), "stars")
        if stars.where("moved").isEmpty():
            return stars.select("v", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2, per_cent: int = PER_CENT) -> DataFrame:
    """id, kd, kh (the row's key), root (names the component; null for empty sets), n_shingles, component_id (least id of
    the component), kept (id is that least id)."""
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), *key_cols(id_col, text_col))
    kind = slim.schema["id"].dataType.simpleString()
    all_ = cut(slim.mapInArrow(_signatures(k, PERMS), f"id {kind}, kd long, kh long, n long, s1 long, s2 long, sketch binary, tokens array<int>"), "signatures")
    some = all_.where("s1 is not null")
    classes = cut(some.groupBy("s1", "s2").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.min(F.struct("kd", "kh", "sketch", "tokens")).alias("x")).select("s1", "s2", "least", "copies", "x.*"), "classes")
    roots = links(classes.select("s1", "copies", "kd", "kh", "sketch", "tokens"), slim.select("kd", "kh", "text"), k, per_cent)
    named = classes.select("s1", "s2", "least").join(roots.withColumnRenamed("v", "s1"), "s1", "left").withColumn("root", F.coalesce("root", "s1"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = cut(named.join(least, "root").select("s1", "s2", "root", "component_id"), "components")
    out = all_.join(answer, ["s1", "s2"], "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select("id", "kd", "kh", "root", F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, k: int = 5) -> DataFrame:
    """One document of each component, as it is; rows equal in id and text are one document."""
    found = near_duplicates(docs, k=k)
    alone = found.where("root is null").select("kd", "kh").distinct()
    first = found.where("root is not null and kept").groupBy("root").agg(F.min(F.struct("kd", "kh")).alias("x")).select("x.*")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key_cols("doc_id", "text"))
    stay = cut(first.unionByName(alone).distinct(), "kept")
    return keyed.join(stay, ["kd", "kh"], "left_semi").dropDuplicates(["kd", "kh"]).select("row.*")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


#: All pairs that share a shingle, and the least document reachable over those that are similar enough.
OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) END AS s FROM d),
classes AS (SELECT min(doc_id) AS c, list_sort(s) AS s FROM sets GROUP BY list_sort(s)),
flat AS (SELECT c, len(s) AS n, unnest(s) AS g FROM classes WHERE len(s) > 0),
links AS (SELECT a.c AS u, b.c AS v FROM flat a JOIN flat b ON a.g = b.g AND a.c < b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
          GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
sym AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT c, c AS r FROM classes UNION SELECT sym.u, reach.r FROM reach JOIN sym ON sym.v = reach.c),
ends AS (SELECT c, min(r) AS r FROM reach GROUP BY c)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, CASE WHEN len(sets.s) = 0 THEN sets.doc_id ELSE r END AS component_id,
       sets.doc_id = (CASE WHEN len(sets.s) = 0 THEN sets.doc_id ELSE r END) AS kept
FROM sets JOIN classes ON list_sort(sets.s) = classes.s JOIN ends ON ends.c = classes.c
"""
