"""Exact BPE encoding by fragments, shared by the encoding and the output operators.

A cut between two bytes is certain where no vocabulary token holds the pair: no merge can span it. Inside a run of ASCII
letters (or, for byte-level files, of ASCII marks) the pair alone decides; elsewhere the splitter must end a piece there
too, as it may read a fragment by itself otherwise. So the fragments on both sides encode as they would inside the whole
text. Fragments repeat, so each worker encodes a distinct one once and keeps its ids (at most MEMO fragments, then
afresh), found by 128 bits. Strings of added tokens are never cut. Encoding itself is done by the tokenizers library.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from ._core import ragged, span_hash, utf8

MEMO = 1_500_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
#: After a letter beyond ASCII no pair of ASCII letters decides.
_BEYOND_LETTERS = ~_LETTER


def _alphabet() -> dict[str, int]:
    """The public byte-to-character convention of byte-level vocabularies: printable bytes stand for themselves, the
    others for characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def forced_pairs(vocab, suffix: str = "") -> np.ndarray:
    """[256, 256]: True where no token holds these two bytes side by side."""
    back, inside = _alphabet(), np.zeros((256, 256), bool)
    for token in vocab:
        b = [back[c] for c in token.removesuffix(suffix) if c in back]
        for x, y in zip(b, b[1:], strict=False):
            inside[x, y] = True
    return ~inside


def _word_cuts(vocab, suffix: str) -> tuple[np.ndarray, np.ndarray]:
    """Certain cuts where pieces are letters, single digits or other marks and white space is dropped: between pieces, and
    inside a word of ASCII letters. The word-end mark belongs to the last fragment of a word only."""
    kind = np.full(256, 4)  # beyond ASCII: not known from one byte
    for b in range(128):
        kind[b] = 0 if _SPACE[b] else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3
    a, b = kind[:, None], kind[None, :]
    ends = (a == 0) | (b == 0) | ((a < 4) & (b < 4) & ((a != b) | (a == 2)))
    low = np.arange(256)
    low[65:91] += 32  # the text is lower-cased before pieces are merged
    forced = forced_pairs(vocab, suffix)[np.ix_(low, low)]
    return forced & ends, forced & (a == 1) & (b == 1)


def _space_cuts(vocab) -> np.ndarray:
    """Certain cuts of the byte-level splitter, whose pieces are letters, digits or other marks with one space before them
    at most: before white space after anything else, and between ASCII letters, digits and marks (but not after an
    apostrophe, which may lead letters). White space beyond ASCII ends in some bytes above 127; there is no cut after
    those (but see `cuts`)."""
    solid = np.zeros(256, bool)
    solid[33:127] = True
    solid[128:] = True
    solid[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False
    cut = np.zeros((256, 256), bool)
    cut[np.ix_(solid, [9, 10, 13, 32])] = True
    kind = np.array([1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(33, 127)])
    cut[33:127, 33:127] = (kind[:, None] != kind[None, :]) | ((kind[:, None] != 2) & (np.arange(33, 127) != ord("'")))
    cut[ord("'"), 33:127] = False
    return cut & forced_pairs(vocab)


class Encoder:
    """Ids of texts, by one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.tool = Tokenizer.from_file(path)
        self.tool.no_truncation()
        self.tool.no_padding()
        with open(path) as f:
            spec = json.load(f)
        vocab, suffix = self.tool.get_vocab(with_added_tokens=False), spec["model"].get("end_of_word_suffix") or ""
        self.words = bool(suffix)
        self.pairs, self.inside = _word_cuts(vocab, suffix) if self.words else (_space_cuts(vocab), None)
        # One piece of plain letters needs no splitter: it goes to the library's BPE model as it is.
        self.model = self.tool.model
        if self.words:  # the same merges for what does not end a word
            merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
            self.open_model = BPE(vocab, merges)
        self.to_model = {b: ord(c) for c, b in _alphabet().items()}
        self.special = [x["content"].encode() for x in spec["added_tokens"]]
        self.size = self.tool.get_vocab_size(with_added_tokens=True)
        self._fresh()

    def _fresh(self) -> None:
        """Memo: hashes in order, and where each fragment's ids lie."""
        self.known, self.check, self.number = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.flat, self.used, self.size_of = np.zeros(1 << 16, np.int32), 0, 0
        self.start, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)

    def cuts(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of fragments, and which of them end inside a word."""
        cut, inside = np.zeros(len(buf) + 1, bool), np.zeros(len(buf) + 1, bool)
        if len(buf) > 1:
            cut[1:-1] = self.pairs[buf[:-1], buf[1:]]
            if not self.words and len(buf) > 2:  # two bytes led by C3 are a letter, but for two signs, and end as ASCII letters do
                cut[2:-1] |= (buf[:-2] == 0xC3) & (buf[1:-1] != 0x97) & (buf[1:-1] != 0xB7) & self.pairs[ord("z"), buf[2:]] & _BEYOND_LETTERS[buf[2:]]
            if self.words:
                inside[1:-1] = self.inside[buf[:-1], buf[1:]]
            raw = None
            for s in self.special:
                raw = raw if raw is not None else buf.tobytes()
                at = raw.find(s)
                while at >= 0:
                    cut[at + 1 : at + len(s)] = inside[at + 1 : at + len(s)] = False
                    at = raw.find(s, at + 1)
        cut[off] = True
        at = np.flatnonzero(inside[: len(buf)] & ~cut[: len(buf)])
        if len(at):  # only after nothing but letters since the last other cut
            outer = np.flatnonzero(cut)
            begin = outer[np.searchsorted(outer, at, "right") - 1]
            marks = np.concatenate([[0], np.cumsum(~_LETTER[buf])])
            at = at[marks[at] == marks[begin]]
            cut[at] = True
        start = np.flatnonzero(cut[: len(buf)])
        unfinished = np.zeros(len(start), bool)
        unfinished[np.searchsorted(start, at) - 1] = True
        return start, unfinished

    def _ids(self, raw: bytes, unfinished: bool) -> list[int]:
        text = raw.decode()
        if self.words:
            if text.isascii() and text.isalpha():
                return [t.id for t in (self.open_model if unfinished else self.model).tokenize(text.lower())]
        elif text.removeprefix(" ").isalpha():
            return [t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.to_model))]
        return self.tool.encode(text, add_special_tokens=False).ids

    def _learn(self, buf: np.ndarray, hashes: np.ndarray, check: np.ndarray, start: np.ndarray, end: np.ndarray, unfinished: np.ndarray) -> None:
        """Encode new fragments; hashes ascend."""
        got = [self._ids(buf[s:e].tobytes(), u) for s, e, u in zip(start.tolist(), end.tolist(), unfinished.tolist(), strict=True)]
        n, at = np.array([len(x) for x in got], np.int32), self.size_of
        total = int(n.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while at + len(n) > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        self.flat[self.used : self.used + total] = np.fromiter((i for x in got for i in x), np.int32, total)
        self.start[at : at + len(n)] = self.used + np.cumsum(n) - n
        self.count[at : at + len(n)] = n
        self.used, self.size_of = self.used + total, at + len(n)
        to = np.searchsorted(self.known, hashes)
        self.known, self.check = np.insert(self.known, to, hashes), np.insert(self.check, to, check)
        self.number = np.insert(self.number, to, np.arange(at, at + len(n), dtype=np.int32))

    def _look(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Memo numbers, -1 where not known, -2 where another fragment has the hash."""
        if not len(self.known):
            return np.full(len(h), -1, np.int32)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[at] == h, np.where(self.check[at] == check, self.number[at], -2), -1)

    def fragments(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        """Memo numbers of all fragments in order, and the document of each; None if two fragments share a hash."""
        buf, off = utf8(arr)
        if not len(buf):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start, unfinished = self.cuts(buf, off)
        end = np.append(start[1:], len(buf))
        own, check = span_hash(buf, start, end), span_hash(buf, start, end, 1) + unfinished
        h, first, inverse = np.unique(own + unfinished, return_index=True, return_inverse=True)
        if (check[first][inverse] != check).any():
            return None
        check = check[first]
        if self.size_of > MEMO:
            self._fresh()
        number = self._look(h, check)
        new = np.flatnonzero(number == -1)
        if len(new):
            at = first[new]
            self._learn(buf, h[new], check[new], start[at], end[at], unfinished[at])
            number = self._look(h, check)
        return (number[inverse], np.searchsorted(off, start, "right") - 1) if (number >= 0).all() else None

    def encode(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts laid end to end, and how many each text has."""
        found = self.fragments(arr)
        if found is None:
            ids = [x.ids for x in self.tool.encode_batch([t or "" for t in arr.to_pylist()], add_special_tokens=False)]
            return np.fromiter((i for x in ids for i in x), np.int32), np.array([len(x) for x in ids], np.int64)
        number, doc = found
        n = self.count[number]
        which, at = ragged(n)
        return self.flat[self.start[number][which] + at], np.bincount(doc, n, minlength=len(arr)).astype(np.int64)


class Decoder:
    """Texts of ids, as the library's decode() of a file whose decoder is byte level or absent."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tool = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        self.bytes = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        back = _alphabet()
        added = {x["id"]: x["content"] for x in spec["added_tokens"]}
        names = [tool.id_to_token(i) or "" for i in range(tool.get_vocab_size(with_added_tokens=True))]
        raw = [bytes(back[c] for c in t) if self.bytes and i not in added else t.encode() for i, t in enumerate(names)]
        if not self.bytes:  # no decoder: tokens joined by spaces
            raw = [x + b" " for x in raw]
        self.n = np.array([len(x) for x in raw])
        self.start = np.cumsum(self.n) - self.n
        self.flat = np.frombuffer(b"".join(raw), np.uint8)

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
        n = self.n[ids]
        which, at = ragged(n)
        data = self.flat[self.start[ids][which] + at].tobytes()
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(lengths)])].tolist()
        last = 0 if self.bytes else 1
        return pa.array([data[a : max(a, b - last)].decode(errors="replace") for a, b in zip(ends, ends[1:], strict=False)], pa.string())


_have: dict[tuple[type, str], object] = {}


def cached(kind: type, path: str):
    """One encoder or decoder a worker process and file."""
    if (kind, path) not in _have:
        _have[kind, path] = kind(path)
    return _have[kind, path]
