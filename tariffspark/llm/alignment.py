"""Operator 11, alignment of two tokenizers: which tokens of a byte-level BPE (A) and of a sentencepiece model (B) cover the same bytes.

A encodes space + text, B the text (it puts the space there itself). The coarse cuts are the tokenizers' own spans: the
character offsets of the tokenizers library, where a token does not share its last character with the next one, and the
spans of sentencepiece's proto (the installed release returns its immutable proto under the name "proto"). Between two
coarse cuts, tokens that are parts of one multibyte character, and byte-fallback pieces, end by their decoded bytes; the
decoded bytes of all tokens must also give the text back.

A text is cut before each plain space after other than white space. No token of either vocabulary holds such a place
inside, and A's splitter ends a piece there, so each fragment encodes as it does inside the text; fragments repeat, and a
worker aligns each distinct one once (a bounded memo, then afresh).

A link is a pair of an A and a B token that end at the same byte. Corpus-wide counts of linked id pairs come from per-task
sums. The most frequent pairs (at most HOT) are broadcast, and documents look them up where they are; only the rest is
shuffled, by pair, where no pair is frequent.

Defined results: null and empty texts, and texts whose joined A or B bytes are not space + text (a text with U+2581), have
no tokens and give zeros; each input row gives one output row, repeated rows and ids included; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._core import chunks, cut, lists, ragged, span_hash, table, utf8
from .tokens import _alphabet, cached

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs that are broadcast: 16 bytes and a flag each.
HOT = 1 << 18
#: A worker's memo: fragments, and bytes of groups and links.
MEMO, MEMO_BYTES = 1_000_000, 1 << 28
_MARK = "▁"


def _bytes(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, starts and bytes of tokens laid end to end."""
    n = np.array([len(t) for t in tokens])
    return n, np.cumsum(n) - n, np.frombuffer(b"".join(tokens), np.uint8)


class Aligner:
    """Groups and links of fragments, by one pair of tokenizer files."""

    def __init__(self, paths: tuple[str, str]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(paths[0])
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
        back = _alphabet()
        names = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        self.a_tokens = _bytes([bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in names])
        ids = range(self.b.get_piece_size())
        self.is_byte = np.array([self.b.is_byte(i) for i in ids])
        pieces = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.is_byte[i] else self.b.id_to_piece(i).replace(_MARK, " ").encode() for i in ids]
        self.b_tokens = _bytes(pieces)
        # Ids with the mark that follows: within a group or at its end, of A and of B, and at the end of a fragment.
        self.spelling = np.array([[f"{i}{mark}" for i in range(max(len(names), len(ids)))] for mark in (",", "|", ",", ";", "")], object)
        # Bytes after which a space may be cut off: all but white space (some bytes above 127 end white space beyond ASCII)
        # and whatever stands before a space inside a piece of B.
        self.solid = np.zeros(256, bool)
        self.solid[33:127] = self.solid[128:] = True
        self.solid[[0x85, *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False
        for p in pieces:
            for x, y in zip(p, p[1:], strict=False):
                self.solid[x] &= y != 32
        self._fresh()

    def _fresh(self) -> None:
        self.hash, self.check, self.number = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.groups: list[str | None] = []
        self.counts = np.zeros((1 << 12, 3), np.int64)  # A tokens, B tokens, groups
        self.links, self.stops, self.start, self.used, self.held = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), np.zeros(1 << 12, np.int64), 0, 0

    def ends(self, ids: np.ndarray, frag: np.ndarray, chars: np.ndarray, coarse: np.ndarray, tokens: tuple[np.ndarray, np.ndarray, np.ndarray], buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each token ends, as a byte of buf, and which fragments (from off[i] on) are given back whole. `chars` are
        ends in characters of buf by the tokenizer's spans, to be used where `coarse` holds; others end by decoded bytes."""
        n, start, flat = tokens
        size = np.bincount(frag, n[ids], minlength=len(off) - 1).astype(np.int64)
        good = size == np.diff(off)
        end = np.cumsum(n[ids]) + (off[:-1] - (np.cumsum(size) - size))[frag]
        place = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))
        good[frag[coarse & (place[np.minimum(chars, len(place) - 1)] != end)]] = False
        which, step = ragged(n[ids])
        keep = good[frag[which]]
        which, step = which[keep], step[keep]
        wrong = flat[start[ids[which]] + step] != buf[end[which] - n[ids[which]] + step]
        good[frag[which[wrong]]] = False
        return end, good

    def _learn(self, texts: list[bytes], h: np.ndarray, check: np.ndarray) -> None:
        names, count = [t.decode() for t in texts], len(texts)
        buf, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        first = np.concatenate([[0], np.cumsum([len(t) for t in names])])  # characters
        found = self.a.encode_batch(names, add_special_tokens=False)
        a = np.fromiter((i for e in found for i in e.ids), np.int64)
        spans = np.fromiter((x for e in found for o in e.offsets for x in o), np.int64).reshape(-1, 2)
        fa = np.repeat(np.arange(count), [len(e.ids) for e in found])
        last = np.append(fa[1:] != fa[:-1], True) if len(fa) else np.zeros(0, bool)
        coarse = last | (np.append(spans[1:, 0], 0) >= spans[:, 1])
        a_end, good_a = self.ends(a, fa, first[fa] + spans[:, 1], coarse, self.a_tokens, buf, off)
        pieces = [p.pieces for p in self.b.encode([t[1:] for t in names], return_type="proto")]
        b = np.fromiter((x.id for p in pieces for x in p), np.int64)
        fb = np.repeat(np.arange(count), [len(p) for p in pieces])
        shown = np.fromiter((len(x.surface) for p in pieces for x in p), np.int64)
        spelt = np.cumsum(shown)
        base = np.concatenate([[0], np.cumsum(np.bincount(fb, shown, minlength=count).astype(np.int64))])[:-1]
        inner = self.is_byte[b] & np.append(self.is_byte[b[1:]] & (fb[1:] == fb[:-1]), False)
        b_end, good_b = self.ends(b, fb, first[fb] + 1 + spelt - base[fb], ~inner, self.b_tokens, buf, off)
        good = good_a & good_b
        keep = good[fa]
        a, fa, a_end = a[keep], fa[keep], a_end[keep]
        keep = good[fb]
        b, fb, b_end = b[keep], fb[keep], b_end[keep]
        common, ia, ib = np.intersect1d(a_end, b_end, assume_unique=True, return_indices=True)
        # Groups as text: each A token and then each B token of a group, with the mark that follows it.
        kind = np.concatenate([np.isin(a_end, common), 2 + np.isin(b_end, common)]).astype(np.int64)
        kind[len(a) :][np.isin(b_end, off[1:])] = 4
        group = np.concatenate([np.searchsorted(common, a_end), np.searchsorted(common, b_end)])
        order = np.argsort(group * 2 + (kind > 1), kind="stable")
        words = self.spelling[kind[order], np.concatenate([a, b])[order]].tolist()
        tokens = np.stack([np.bincount(x, minlength=count) for x in (fa, fb)], 1)
        bounds = np.concatenate([[0], np.cumsum(tokens.sum(1))]).tolist()
        at = len(self.groups)
        self.groups += ["".join(words[lo:hi]) if ok else None for lo, hi, ok in zip(bounds, bounds[1:], good.tolist(), strict=False)]
        n = np.bincount(fa[ia], minlength=count)
        while at + count > len(self.start):
            self.start, self.counts = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.counts, np.zeros_like(self.counts)])
        while self.used + len(common) > len(self.links):
            self.links, self.stops = np.concatenate([self.links, np.zeros_like(self.links)]), np.concatenate([self.stops, np.zeros_like(self.stops)])
        self.start[at : at + count] = self.used + np.cumsum(n) - n
        self.counts[at : at + count] = np.column_stack([tokens, n])
        self.links[self.used : self.used + len(common)] = a[ia] << 32 | b[ib]
        self.stops[self.used : self.used + len(common)] = common - off[fa[ia]]
        self.used += len(common)
        self.held += 120 * count + 7 * len(words) + 12 * len(common)
        to = np.searchsorted(self.hash, h)
        self.hash, self.check = np.insert(self.hash, to, h), np.insert(self.check, to, check)
        self.number = np.insert(self.number, to, np.arange(at, at + count))

    def _look(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        if not len(self.hash):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where((self.hash[at] == h) & (self.check[at] == check), self.number[at], -1)

    def fragments(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Memo number, document and first byte (in its document) of each fragment of space + text."""
        arr = arr.fill_null("")
        buf, off = utf8(pc.if_else(pc.equal(arr, ""), "", pc.binary_join_element_wise(pa.scalar(" "), arr, "")))
        head = np.zeros(len(buf) + 1, bool)
        head[off] = True
        if len(buf):
            head[1:-1] |= (buf[1:] == 32) & self.solid[buf[:-1]]
            head[off[1:][np.diff(off) > 0] - 1] = False  # a last space stays with what it follows: B encodes no empty text
        start = np.flatnonzero(head[: len(buf)])
        if not len(start):
            return start, start, start
        end = np.append(start[1:], len(buf))
        own, second = span_hash(buf, start, end), span_hash(buf, start, end, 1)
        h, first, inverse = np.unique(own, return_index=True, return_inverse=True)
        if (second[first][inverse] != second).any():  # two fragments share a hash: tell these by the second one
            own = own ^ second
            h, first, inverse = np.unique(own, return_index=True, return_inverse=True)
        if len(self.groups) > MEMO or self.held > MEMO_BYTES:
            self._fresh()
        number = self._look(h, second[first])
        new = np.flatnonzero(number < 0)
        if len(new):
            self._learn([buf[start[i] : end[i]].tobytes() for i in first[new].tolist()], h[new], second[first][new])
            number = self._look(h, second[first])
        doc = np.searchsorted(off, start, "right") - 1
        return number[inverse], doc, start - off[doc]

    def align(self, arr: pa.Array, spans: bool) -> dict[str, pa.Array]:
        """n_a, n_b, n_groups, groups, ends of groups (where asked for), and the distinct links with their numbers."""
        number, doc, at = self.fragments(arr)
        n, texts = len(arr), self.groups
        bounds = np.searchsorted(doc, np.arange(n + 1)).tolist()
        of = number.tolist()
        strings = []
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            parts = [texts[i] for i in of[lo:hi]]
            strings.append(None if None in parts else ";".join(parts))
        good = np.array([s is not None and s != "" for s in strings], bool)
        keep = good[doc]
        number, doc, at = number[keep], doc[keep], at[keep]
        counts = self.counts[number]
        totals = [np.bincount(doc, counts[:, k], minlength=n).astype(np.int64) for k in range(3)]
        which, step = ragged(counts[:, 2])
        flat = self.start[number][which] + step
        codes, inverse = np.unique(self.links[flat], return_inverse=True)
        pairs, times = np.unique(doc[which] << 32 | inverse, return_counts=True)
        per = np.bincount(pairs >> 32, minlength=n)
        out = {"n_a": pa.array(totals[0]), "n_b": pa.array(totals[1]), "n_groups": pa.array(totals[2]), "groups": pa.array([s or "" for s in strings], pa.string())}
        if spans:
            out["ends"] = lists((at[which] + self.stops[flat]).astype(np.int32), totals[2])
        return out | {"links": lists(codes[pairs & 0xFFFFFFFF] if len(codes) else codes, per), "times": lists(times.astype(np.int32), per)}


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """Per row: id, row (its own number), n_a, n_b, n_groups, groups (`a1,a2|b1;a3|b2,b3`), ends (with `spans`: the byte of
    space + text that each group ends at), links (distinct A << 32 | B) and how many times each occurs."""
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, row = cached(Aligner, (byte_path, piece_path)), TaskContext.get().partitionId() << 40
        for b in chunks(batches):
            yield pa.record_batch({"id": b.column("id"), "row": row + np.arange(b.num_rows), **tool.align(b.column("text"), spans)})
            row += b.num_rows

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, row long, n_a long, n_b long, n_groups long, groups string, {'ends array<int>, ' if spans else ''}links array<long>, times array<int>")


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the task by pair; what is held is bounded, so a pair may come out more than once."""
    code, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        flat = [np.asarray(b.column(c).flatten()) for c in ("links", "times")]
        code, inverse = np.unique(np.concatenate([code, flat[0]]), return_inverse=True)
        n = np.bincount(inverse, np.concatenate([n, flat[1]]), minlength=len(code)).astype(np.int64)
        if len(code) > 1 << 20:
            yield pa.record_batch({"pair": code, "n": n})
            code, n = code[:0], n[:0]
    yield pa.record_batch({"pair": code, "n": n})


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (links that hold it) and best (no pair of its B id has more), as a written table."""
    counts = cut(aligned.select("links", "times").mapInArrow(_tally, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    top = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("top"))  # one row a B id: bounded by the vocabulary
    return cut(counts.join(F.broadcast(top), b_id == top["b"]).select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "pairs")


def _hot(pairs: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent pairs, `most` at most: all above a frequency that a histogram of eighths of powers of two gives."""
    step = F.floor(F.log2("n") * 8)
    total, least = 0, None
    for r in sorted(pairs.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):  # at most 512 rows
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    rows = pairs.where(step >= least).collect() if least is not None else []  # at most `most`
    code = np.array([r["pair"] for r in rows], np.int64)
    order = np.argsort(code)
    return code[order], np.array([r["n"] for r in rows], np.int64)[order], np.array([r["best"] for r in rows], bool)[order]


def _answer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, count, best = shared.value
        for b in batches:
            links, times = (np.asarray(b.column(c).flatten()) for c in ("links", "times"))
            per = np.diff(np.asarray(b.column("links").offsets)).astype(np.int64)
            doc = np.repeat(np.arange(b.num_rows), per)
            at = np.minimum(np.searchsorted(code, links), max(len(code) - 1, 0))
            known = code[at] == links if len(code) else np.zeros(len(links), bool)
            sums = np.zeros(b.num_rows, np.int64)
            np.add.at(sums, doc[known], times[known] * count[at[known]])
            n_best = np.bincount(doc[known][best[at[known]]], times[known][best[at[known]]], minlength=b.num_rows).astype(np.int64) if len(code) else sums
            rest = np.bincount(doc[~known], minlength=b.num_rows)
            yield pa.record_batch({"row": b.column("row"), "n_best": n_best, "count_sum": sums, "links": lists(links[~known], rest), "times": lists(times[~known], rest)})

    return run


def link_scores(aligned: DataFrame, hot: int = HOT) -> DataFrame:
    """row, n_best and count_sum of a written table of `align`."""
    pairs = pair_counts(aligned)
    seen = aligned.sparkSession.sparkContext.broadcast(_hot(pairs, hot))
    part = aligned.select("row", "links", "times").mapInArrow(_answer(seen), "row long, n_best long, count_sum long, links array<long>, times array<int>")
    part = cut(part, "hot-links")
    rest = part.select("row", F.explode(F.arrays_zip("links", "times")).alias("x")).select("row", F.col("x.links").alias("pair"), F.col("x.times").alias("t"))
    more = rest.join(pairs.hint("shuffle_hash"), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("b"), F.sum(F.col("t") * F.col("n")).alias("s"))
    both = part.select("row", "n_best", "count_sum").unionByName(more.select("row", F.col("b").alias("n_best"), F.col("s").alias("count_sum")))
    return both.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = align(table(spark, sf_dir, "documents"), public_tokenizers.path(A), public_tokenizers.path(B), spans=False)
    found = cut(found.withColumn("groups", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))), "aligned")
    out = found.select("id", "row", "n_a", "n_b", "n_groups", "groups").join(link_scores(found), "row")
    return out.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
