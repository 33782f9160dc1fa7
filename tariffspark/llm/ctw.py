"""Operator 9, LM scoring by context-tree weighting over binary-decomposed bytes.

The model: every byte is eight binary decisions (most significant bit first); each decision has a context tree over
the bytes before, down to DEPTH bytes. In every node a Krichevsky-Trofimov estimate of its own counts is mixed with what
its children say, weighted by how well either has coded the training bytes. Counts are frozen after training, so each
context and byte that stands anywhere has one log probability.

Contexts and their counts are a Spark table that grows with the corpus; nothing is pruned. Documents are dealt to parts of
about PART_BYTES of text, and each part has its distinct contexts and their counts in packs, one for each bucket. What
stands only in rows that are not learned from has count 0, which leaves the tree as it is. A bucket holds whole subtrees
below SHALLOW bytes and mixes them bottom-up; their sums, 2**24 numbers at most whatever the input, make the top of the
tree, which is broadcast. Packs reach their bucket through a tree of sums, FAN of them a task, and answers go down the same
tree, so no task opens the packs of more than FAN parts, however often a prefix stands in the corpus; what is left of a
bucket at the top are its distinct contexts (of a prefix of three bytes 256 ** (DEPTH - 2) at most).

Beside it the contract's base: smoothed word counts, asked for by each part by a join and never broadcast.

Defined results: null and empty texts have the end token alone and a code length of 0; a null id is trained on and not
held out; without training rows base scores use N = V = 0 and the model gives every bit one half; each input row gives
one output row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._core import SPACED, Words, chunks, crc_mod, cut, key_cols, mix, ragged, signed, table, utf8, word_hash

#: A context of DEPTH bytes (7 at most) and the byte after it are one 64-bit number.
DEPTH, SHALLOW, PART_BYTES, HOLD, BUCKET_BYTES, FAN = 5, 2, 16 << 20, 1 << 20, 4 << 20, 32
#: Stands for the end token among word hashes; no word holds a line break.
END = word_hash("\nend\n")


def _heads(x: np.ndarray) -> np.ndarray:
    """Starts of the runs of a sorted array."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def _summed(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h)
    h, c = h[order], c[order]
    at = _heads(h)
    return h[at], np.add.reduceat(c, at)


def grams(arr: pa.Array, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte: its predecessors in the text (0 before its start), the nearest highest, and itself lowest; and the text offsets."""
    buf, off = utf8(arr)
    place = ragged(np.diff(off))[1]
    out = buf.astype(np.uint64)
    for j in range(1, min(depth, len(buf) - 1) + 1):
        out[j:] |= np.where(place[j:] >= j, buf[:-j], 0).astype(np.uint64) << np.uint64(64 - 8 * j)
    return out, off


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of training rows, summed in the task as far as HOLD entries."""
    held: list[tuple] = []

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        h, c = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held[:] = [(h, c)]
        if last or len(h) > HOLD:
            held.clear()
            yield pa.record_batch({"h": h.view(np.int64), "c": c})

    for b in chunks(batches):
        u, c = np.unique(Words(b.column("text"), SPACED, lower=True).hash, return_counts=True)
        held += [(u, c), (np.array([END], np.uint64), np.array([b.num_rows]))]
        if sum(len(x[0]) for x in held) > HOLD:
            yield from flush(False)
    yield from flush(True)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(h >> np.uint64(64 - 8 * (SHALLOW + 1))) % np.uint64(buckets)).astype(np.int32)


def _packed(x: np.ndarray) -> bytes:
    """Compressed numbers, byte by byte place."""
    return pa.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(data, n * size, codec="zstd"), np.uint8).reshape(size, n).T.copy().view(kind).ravel()


def _packs(depth: int, buckets: int):
    """Of parts and buckets: the distinct contexts with the byte after them, ascending, and how often training rows have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def squeeze() -> int:
            for part, x in held.items():
                h, c = (np.concatenate(y) for y in zip(*x, strict=True))
                x.clear()
                h, c = _summed(h, c)
                x.append((h, c.astype(np.uint32)))
            return sum(len(x[0][0]) for x in held.values())

        def flush() -> Iterator[pa.RecordBatch]:
            squeeze()
            for part, [(h, c)] in held.items():
                of = _bucket(h, buckets)
                order = np.argsort(of, kind="stable")
                h, c, of = h[order], c[order], of[order]
                at = _heads(of)
                ends = np.append(at[1:], len(of))
                yield pa.record_batch(
                    {
                        "part": np.full(len(at), part, np.int64),
                        "bucket": of[at],
                        "n": (ends - at).astype(np.int32),
                        "h": pa.array([_packed(np.diff(h[a:z], prepend=np.uint64(0))) for a, z in zip(at, ends, strict=True)], pa.binary()),
                        "c": pa.array([_packed(c[a:z]) for a, z in zip(at, ends, strict=True)], pa.binary()),
                    }
                )
            held.clear()

        for b in chunks(batches):
            part, learn = np.asarray(b.column("part")), np.asarray(b.column("learn").cast(pa.int8())) > 0
            for p in np.unique(part).tolist():
                for yes in (True, False):
                    rows = (part == p) & (learn == yes)
                    g = np.sort(grams(b.column("text").filter(pa.array(rows)), depth)[0]) if rows.any() else np.zeros(0, np.uint64)
                    if len(g):
                        at = _heads(g)
                        held.setdefault(p, []).append((g[at], (np.diff(np.append(at, len(g))) * yes).astype(np.uint32)))
                        size += len(at)
            if size > 2 * HOLD:
                size = squeeze()
                if size > 3 * HOLD // 2:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


# ---- the tree -----------------------------------------------------------------------------------------------


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0 (Stirling's series after a shift by 8)."""
    shift = np.log(x)
    for i in range(1, 8):
        shift = shift + np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - shift


def _kt(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log probability of all decisions of a node, and the probability of 1 for the next; n: [..., 2]."""
    a, b = n[..., 0].astype(float), n[..., 1].astype(float)
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1) - np.log(np.pi), (b + 0.5) / (a + b + 1)


def _node(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log probability of all decisions of nodes, from a table where counts are small; n: [2, ...]."""
    a, b = n
    small = a + b < len(_HALF)
    if small.all():
        return _HALF[a] + _HALF[b] - _WHOLE[a + b] - np.log(np.pi)
    out = np.empty(len(a))
    out[small] = _HALF[a[small]] + _HALF[b[small]] - _WHOLE[(a + b)[small]] - np.log(np.pi)
    out[~small] = _kt(n[:, ~small].T)[0]
    return out


_HALF, _WHOLE = _lgamma(np.arange(1 << 12) + 0.5), _lgamma(np.arange(1 << 12) + 1.0)


def deep(h: np.ndarray, c: np.ndarray, depth: int, predict: bool) -> tuple[np.ndarray, list[tuple]]:
    """Whole subtrees below SHALLOW bytes. Of each context and byte: what the subtree gives its eight decisions (if predict); and the sums
    (nearest bytes, node, counts of 0 and of 1, log probability) of the subtrees."""
    x, ctx = h & np.uint64(255), h >> np.uint64(8)
    p, sums = np.empty((len(h) if predict else 0, 8), np.float32), []
    for k in range(8):
        key = (x >> np.uint64(8 - k)) << np.uint64(56) | ctx
        order = np.argsort(key)
        key, bit, row = key[order], (x[order] >> np.uint64(7 - k) & np.uint64(1)).astype(np.int64), np.arange(len(h))
        n, total, said, levels = np.where(np.arange(2)[:, None] == bit, c[order], 0), np.zeros(len(h)), None, []
        for d in range(depth, SHALLOW - 1, -1):
            cut_ = key >> np.uint64(8 * (7 - d))
            at = _heads(cut_)
            key, size = key[at], np.diff(np.append(at, len(cut_)))
            n, below = np.add.reduceat(n, at, axis=1), np.add.reduceat(total, at)
            if d == SHALLOW:
                sums.append(((key >> np.uint64(40) & np.uint64(0xFFFF)).astype(np.int32), (1 << k) - 1 + (key >> np.uint64(56)).astype(np.int32), n[0], n[1], below))
                break
            total, w = _node(n), None
            if d < depth:
                more = below - total
                e = np.exp(-np.abs(more))
                total, w = np.maximum(total, below) + np.log1p(e) - np.log(2), np.where(more > 0, e, 1) / (1 + e)
            if predict:
                row = np.repeat(np.arange(len(at)), size)[row]
                levels.append((row, n, w))
        for row, n, w in levels:
            here = (n[bit, row] + 0.5) / (n[0] + n[1] + 1.0)[row]
            said = here if said is None else w[row] * here + (1 - w[row]) * said
        if predict:
            p[order, k] = said
    return p, sums


def _opened(t: pa.Table, kind) -> list[tuple[np.ndarray, np.ndarray]]:
    """Contexts and counts of packs."""
    return [(np.cumsum(_unpacked(r["h"], r["n"], np.uint64)), _unpacked(r["c"], r["n"], kind).astype(np.int64)) for b in t.to_batches() for r in b.to_pylist()]


#: Columns of a pack; counts of parts are unsigned of 32 bits, sums over parts of 64.
PACK = "part long, bucket int, n int, h binary, c binary"


def _merged(kind):
    """One pack out of those of a bucket and of up to FAN parts."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        h, c = _summed(*(np.concatenate(x) for x in zip(*_opened(t, kind), strict=True)))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "bucket": pa.array([key[1].as_py()], pa.int32()), "n": pa.array([len(h)], pa.int32()), "h": pa.array([_packed(np.diff(h, prepend=np.uint64(0)))], pa.binary()), "c": pa.array([_packed(c)], pa.binary())})

    return run


def _sums(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, c in _opened(pa.table(b), np.int64):
                near, node, zero, one, total = (np.concatenate(x) for x in zip(*deep(h, c, depth, False)[1], strict=True))
                yield pa.record_batch({"near": near, "node": node, "zero": zero, "one": one, "total": total})

    return run


def _upper(key: tuple, t: pa.Table) -> pa.Table:
    """The nodes of one preceding byte and of the bytes before that: counts and log probability of the former, and
    both bits' share of its prediction and the weight of what lies deeper, for each of the latter."""
    n, below = np.zeros((256, 255, 2)), np.zeros((256, 255))
    at = np.asarray(t["near"]) & 255, np.asarray(t["node"])
    n[(*at, 0)], n[(*at, 1)], below[at] = np.asarray(t["zero"]), np.asarray(t["one"]), np.asarray(t["total"])
    total, own, rest = _share(n, below)
    top, mine, w = _share(n.sum(0), total.sum(0))
    seen = np.unique(at[0])
    own, rest = mine + w[..., None] * own[seen], w * rest[seen]
    return pa.table({"first": pa.array([key[0].as_py()], pa.int32()), "n": [n.sum(0).tobytes()], "total": [top.tobytes()], "seen": [seen.astype(np.int32).tobytes()], "own": [own.tobytes()], "rest": [rest.tobytes()]})


def _share(n: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of nodes: log probability, what their own counts add to the prediction of 0 and of 1, and the weight of their children."""
    own = _kt(n)[0]
    total = np.logaddexp(own, below) - np.log(2)
    w = np.exp(own - np.log(2) - total)
    return total, w[..., None] * (n + 0.5) / (n.sum(-1, keepdims=True) + 1), np.exp(below - np.log(2) - total)


def upper(sums: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of each two nearest bytes, and by place and node: own [2] and the weight of what lies deeper."""
    sums = sums.groupBy("near", "node").agg(*(F.sum(x).alias(x) for x in ("zero", "one", "total")))
    rows = sums.withColumn("first", F.shiftright("near", 8)).groupBy("first").applyInArrow(_upper, "first int, n binary, total binary, seen binary, own binary, rest binary").collect()  # 256 rows of bounded size
    n, below = np.zeros((255, 2)), np.zeros(255)
    for r in rows:
        n += np.frombuffer(r["n"]).reshape(255, 2)
        below += np.frombuffer(r["total"])
    _, mine, w = _share(n, below)
    place, own, rest = np.full(1 << 16, -1), [], []
    for r in rows:
        seen = np.frombuffer(r["seen"], np.int32)
        place[r["first"] << 8 | seen] = sum(map(len, own)) + np.arange(len(seen))
        own.append((mine + w[:, None] * np.frombuffer(r["own"]).reshape(-1, 255, 2)).astype(np.float32))
        rest.append((w * np.frombuffer(r["rest"]).reshape(-1, 255)).astype(np.float32))
    return place, np.concatenate(own or [np.zeros((0, 255, 2), np.float32)]), np.concatenate(rest or [np.zeros((0, 255), np.float32)])


def _values(shared, depth: int):
    """Of each bucket its contexts and their log10 probabilities, ascending by context and byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, own, rest = shared.value
        for b in batches:
            for row, (h, c) in enumerate(_opened(pa.table(b), np.int64)):
                p = deep(h, c, depth, True)[0]
                at, x, value = place[(h >> np.uint64(48)).astype(np.int64)], (h & np.uint64(255)).astype(np.int64), np.zeros(len(h))
                for k in range(8):
                    node, bit = (1 << k) - 1 + (x >> (8 - k)), x >> (7 - k) & 1
                    value += np.log10(own[at, node, bit].astype(float) + rest[at, node].astype(float) * p[:, k])
                one = b.slice(row, 1)
                yield pa.record_batch([*(one.column(i) for i in ("part", "bucket", "n", "h")), pa.array([_packed(value.astype(np.float32))], pa.binary())], names=["part", "bucket", "n", "h", "x"])

    return run


def _told(last: bool):
    """From the answers of a bucket to those of each of the packs it was summed from; the contexts go on unless it is the last step."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        rows = [r for b in t.to_batches() for r in b.to_pylist()]
        parts: dict[int, list] = {}
        for r in rows:
            mine = np.cumsum(_unpacked(r["h"], r["n"], np.uint64))
            if r["x"] is None:
                parts.setdefault(r["part"], []).append(mine)
            else:
                h, value = mine, _unpacked(r["x"], r["n"], np.float32)
        wanted = {p: _distinct(np.concatenate(mine)) for p, mine in parts.items()}
        packs = [None if last else _packed(np.diff(w, prepend=np.uint64(0))) for w in wanted.values()]
        x = [_packed(value[np.searchsorted(h, w)]) for w in wanted.values()]
        return pa.table({"part": pa.array(list(wanted), pa.int64()), "bucket": np.full(len(x), key[1].as_py(), np.int32), "n": pa.array([len(w) for w in wanted.values()], pa.int32()), "h": pa.array(packs, pa.binary()), "x": pa.array(x, pa.binary())})

    return run


def answers(packs: DataFrame, parts: int, depth: int, fan: int = FAN) -> DataFrame:
    """part, bucket, n, x: log10 probabilities of the contexts and bytes of each part and bucket."""
    up = F.floor(F.col("part") / fan)
    levels = [packs]
    while parts > 1 or len(levels) == 1:
        kind = np.uint32 if len(levels) == 1 else np.int64
        levels.append(cut(levels[-1].withColumn("part", up).groupBy("part", "bucket").applyInArrow(_merged(kind), PACK), "merged"))
        parts = -(-parts // fan)
    top = levels.pop()
    sums = top.mapInArrow(_sums(depth), "near int, node int, zero long, one long, total double")
    shared = packs.sparkSession.sparkContext.broadcast(upper(cut(sums, "sums")))
    told = top.mapInArrow(_values(shared, depth), "part long, bucket int, n int, h binary, x binary")
    for level in reversed(levels):
        below = level.select(up.alias("up"), "part", "bucket", "n", "h", F.lit(None).cast("binary").alias("x"))
        both = told.withColumn("up", F.col("part")).unionByName(below)
        told = both.groupBy("up", "bucket").applyInArrow(_told(level is packs), "part long, bucket int, n int, h binary, x binary")
    return told.drop("h")


# ---- scoring ------------------------------------------------------------------------------------------------


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[_heads(h)]


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of every part."""
    held: dict[int, list] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for part, x in held.items():
            h = np.unique(np.concatenate(x))
            yield pa.record_batch({"part": np.full(len(h), part, np.int64), "h": signed(h)})
        held.clear()

    size = 0
    for b in chunks(batches):
        w = Words(b.column("text"), SPACED, lower=True)
        part = np.asarray(b.column("part"))
        of = part[w.doc_of()]
        for p in np.unique(part).tolist():
            h = np.unique(np.append(w.hash[of == p], np.uint64(END)))
            held.setdefault(p, []).append(h)
            size += len(h)
        if size > 2 * HOLD:
            for p, x in held.items():
                held[p] = [np.unique(np.concatenate(x))]
            size = sum(len(x[0]) for x in held.values())
            if size > HOLD:
                yield from flush()
                size = 0
    yield from flush()


def _found(h: np.ndarray, v: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The value v of each x in the ascending h; 0 where it is not there."""
    if not len(h):
        return np.zeros(len(x), v.dtype)
    order = np.argsort(x)
    x = x[order]
    at = np.minimum(np.searchsorted(h, x), len(h) - 1)
    out = np.empty(len(x), v.dtype)
    out[order] = np.where(h[at] == x, v[at], 0)
    return out


def _part_logs(docs: pa.Table, known: pa.Table, depth: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts with the byte after them that a part has, ascending, and their log10 probabilities from the buckets' answers."""
    have = [_distinct(grams(b.column("text"), depth)[0]) for b in chunks(docs.to_batches())]
    h = _distinct(np.concatenate(have)) if have else np.zeros(0, np.uint64)
    rows = sorted(((r["bucket"], r["n"], r["x"]) for r in known.select(["bucket", "n", "x"]).filter(pc.is_valid(known["x"])).to_pylist()), key=lambda r: r[0])
    out = np.empty(len(h))
    out[np.argsort(_bucket(h, buckets), kind="stable")] = np.concatenate([np.zeros(0), *(_unpacked(x, n, np.float32) for _, n, x in rows)])
    return h, out


def _scores(total: int, distinct: int, depth: int, buckets: int):
    base = total + 0.1 * (distinct + 1)

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        logs = _part_logs(docs, known, depth, buckets)
        known = known.filter(pc.is_null(known["x"]))
        h = np.asarray(known["h"].combine_chunks()).view(np.uint64) if known.num_rows else np.zeros(0, np.uint64)
        order = np.argsort(h)
        h, c = h[order], (np.asarray(known["c"].combine_chunks())[order] if known.num_rows else np.zeros(0, np.int64))
        new = _heads(h)
        h, c = h[new], c[new]
        end = int(_found(h, c, np.array([END], np.uint64))[0])
        out = []
        for b in chunks(docs.to_batches()):
            w = Words(b.column("text"), SPACED, lower=True)
            own, doc, n = _found(h, c, w.hash), w.doc_of(), b.num_rows
            g, off = grams(b.column("text"), depth)
            cum = np.concatenate([[0], np.cumsum(_found(*logs, g))])
            out.append(
                pa.table(
                    {
                        "id": b.column("id"),
                        "n_tokens": w.n.astype(np.int64) + 1,
                        "n_known": np.bincount(doc, own > 0, minlength=n).astype(np.int64) + (end > 0),
                        "base_score": np.bincount(doc, np.log10((own + 0.1) / base), minlength=n) + np.log10((end + 0.1) / base),
                        "score": cum[off[1:]] - cum[off[:-1]],
                        "n_bytes": np.diff(off),
                    }
                )
            )
        return pa.concat_tables(out) if out else pa.table({"id": pa.array([], docs.schema.field("id").type), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64()), "n_bytes": pa.array([], pa.int64())})

    return run


def score_lm(docs: DataFrame, trains, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES, depth: int = DEPTH, fan: int = FAN) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text), bits_per_byte.
    trains: a function of the id column that says which rows are learned from."""
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), *key_cols(id_col, text_col))
    kind = slim.schema["id"].dataType.simpleString()
    words = cut(slim.where(trains(F.col("id"))).select("text").mapInArrow(_counts, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "counts")
    size = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).collect()[0]
    length = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).collect()[0]["b"]
    parts, buckets = max(1, -(-length // part_bytes)), max(1, -(-length // BUCKET_BYTES))
    dealt = slim.select("id", "text", F.coalesce(trains(F.col("id")), F.lit(False)).alias("learn"), F.pmod(F.xxhash64("kd", "kh"), F.lit(parts)).alias("part"))
    packs = cut(dealt.select("text", "learn", "part").repartition("part").mapInArrow(_packs(depth, buckets), "part long, bucket int, n int, h binary, c binary"), "packs")
    told = cut(answers(packs, parts, depth, fan), "answers")
    asked = dealt.select("text", "part").repartition("part").mapInArrow(_asked, "part long, h long").distinct()
    known = cut(asked.join(words, "h"), "known").unionByName(told, allowMissingColumns=True).select("part", "h", "c", "bucket", "n", "x")
    out = dealt.select("id", "text", "part").groupBy("part").cogroup(known.groupBy("part")).applyInArrow(_scores(size["n"], size["v"], depth, buckets), f"id {kind}, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    return out.select("id", "n_tokens", "n_known", F.lit(size["n"]).cast("long").alias("train_tokens"), "base_score", "score", F.when(F.col("n_bytes") > 0, -F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")).otherwise(0.0).alias("bits_per_byte"))


def op9_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = lambda i: F.coalesce(crc_mod(i, 10) == 0, F.lit(False))
    out = score_lm(table(spark, sf_dir, "documents"), lambda i: ~held(i))
    return out.select(F.col("id").alias("doc_id"), held(F.col("id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
