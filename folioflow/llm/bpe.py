"""Byte-level BPE encoding and decoding with the merge table of a tokenizer file.

A piece of text is encoded with a priority queue of merge ranks over a doubly linked list of symbols: the queue gives
the lowest rank, leftmost first; an entry whose symbols have changed since it was pushed is stale and skipped. Each
worker keeps the pieces it has met, and the words between two spaces, at most `CACHE` of each. A cut before a space that
is followed by something else than white space never falls into a piece, so a text in which all spaces are such is
looked up word by word; others are cut by the pattern as a whole. Decoding looks ids up and joins their byte strings.

Defined cases: a null text is empty and gives no ids; special tokens written out in a text become their own id;
texts of any length are whole (a piece of n bytes costs n log n); repeated rows and null ids pass through; bytes that
are no UTF-8 after decoding become U+FFFD.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how byte-level tokenizers cut a text into pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 300_000
#: Letters below this one are the same to Python and to the pattern; these marks are pieces of one id.
LATIN, MARKS = "\u0250", frozenset(".,;:!?")


def byte_letters() -> list[str]:
    """The letter for each byte: printable Latin-1 stands for itself, the others follow from U+0100 in order."""
    own = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class Pieces(dict):
    """piece -> what `made` makes of it; keeps at most `CACHE` pieces, none longer than 64 characters or with a line end inside."""

    def __init__(self, made: Callable[[str], object]) -> None:
        self.made = made

    def __missing__(self, piece: str) -> object:
        value = self.made(piece)
        if len(self) >= CACHE:
            self.clear()
        if len(piece) <= 64 and "\n" not in piece[1:]:
            self[piece] = value
        return value


class Codec:
    """One tokenizer, read from its JSON text."""

    def __init__(self, spec: str) -> None:
        made = json.loads(spec)
        model = made["model"]
        if made["normalizer"] or made["pre_tokenizer"]["type"] != "ByteLevel" or made["pre_tokenizer"]["add_prefix_space"] or model["dropout"] or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE without normalizer or prefix space")
        vocab: dict[str, int] = model["vocab"]
        letters = byte_letters()
        of_byte = {c: b for b, c in enumerate(letters)}
        self.first = [vocab[c] for c in letters]
        self.rank: dict[int, int] = {}  # of a pair, packed
        self.pair: list[tuple[int, int, int]] = []  # by rank: left, right and merged id
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a] << 32 | vocab[b]] = len(self.pair)
            self.pair.append((vocab[a], vocab[b], vocab[a + b]))
        self.special = {x["content"]: x["id"] for x in made["added_tokens"]}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in made["added_tokens"]):
            raise ValueError("special tokens with options are not supported")
        self.bytes_of = [b""] * (1 + max(*vocab.values(), *self.special.values(), 0))
        for s, i in vocab.items():
            self.bytes_of[i] = bytes(of_byte[c] for c in s)
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.known: dict[str, list[int]] = Pieces(lambda piece: self.merge(piece.encode()))
        self.spaced: dict[str, list[int]] = Pieces(lambda word: self.in_pieces(" " + word))
        self.lengths: dict[str, int] = {}
        keys = np.fromiter(self.rank, np.int64, len(self.rank))
        self.sorted_ranks = np.argsort(keys)
        self.sorted_pairs = keys[self.sorted_ranks]
        self.firsts = np.array(self.first, np.int64)
        self.byte_ranks = self.ranks_of((self.firsts[:, None] << 32 | self.firsts[None, :]).reshape(-1))
        self.merged = np.array([new for _, _, new in self.pair], np.int64)
        self.find = regex.compile(PIECES).findall
        self.odd = regex.compile(r" (?:\s|\Z)").search
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else lambda t: [t]

    def merge(self, data: bytes) -> list[int]:
        ids = [self.first[b] for b in data]
        n, rank, pairs = len(ids), self.rank.get, self.pair
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        # rank and place in one number: a rank has one pair, so ties go to the left
        queue = [r << 32 | i for i in range(n - 1) if (r := rank(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            x = heapq.heappop(queue)
            i = x & 0xFFFFFFFF
            left, right, new = pairs[x >> 32]
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # stale
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank(new << 32 | ids[k])) is not None:
                    heapq.heappush(queue, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank(ids[h] << 32 | new)) is not None:
                heapq.heappush(queue, r << 32 | h)
        return [x for x in ids if x >= 0]

    def in_pieces(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.find(text))))

    def parts(self, text: str) -> list[str]:
        """Texts and special tokens, in turn."""
        return self.cut(text) if any(s in text for s in self.special) else [text]

    def encode(self, text: str) -> list[int]:
        out: list[list[int]] = []
        for k, part in enumerate(self.parts(text)):
            if k % 2:
                out.append([self.special[part]])
            elif self.odd(part):
                out.append(self.in_pieces(part))
            else:
                first, *words = part.split(" ")
                out.append(self.in_pieces(first))
                out.extend(map(self.spaced.__getitem__, words))
        return list(chain.from_iterable(out))

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """How many ids merge gives each piece of at most 64 bytes: in every round all pieces take their lowest pair at once."""
        n = np.array([len(p) for p in pieces], np.int64)
        out = n.copy()
        none = np.int64(len(self.pair))
        for lo, hi in ((2, 4), (5, 6), (7, 8), (9, 10), (11, 13), (14, 18), (19, 28), (29, 64)):
            at = np.flatnonzero((n >= lo) & (n <= hi))
            if not len(at):
                continue
            cols = np.arange(hi + 1)
            data = np.zeros((len(at), hi + 1), np.int64)
            data[cols < n[at, None]] = np.frombuffer(b"".join([pieces[i] for i in at.tolist()]), np.uint8)
            ranks = np.where(cols[1:] < n[at, None], self.byte_ranks[data[:, :-1] << 8 | data[:, 1:]], none)
            ids = np.where(cols < n[at, None], self.firsts[data], 1 << 31)
            while len(at):
                best = ranks.argmin(axis=1)  # the leftmost of the lowest
                row = np.arange(len(at))
                more = ranks[row, best] < none
                at, ids, ranks, best = at[more], ids[more], ranks[more], best[more]
                row = row[: len(at)]
                if not len(at):
                    break
                out[at] -= 1
                new = self.merged[ranks[row, best]]
                # what is right of the pair moves one place to the left
                ids = np.take_along_axis(ids, np.minimum(cols + (cols > best[:, None]), hi), axis=1)
                ids[row, best] = new
                ranks = np.take_along_axis(ranks, np.minimum(cols[:-1] + (cols[:-1] > best[:, None]), hi - 1), axis=1)
                ranks[row, best] = self.ranks_of(new << 32 | ids[row, np.minimum(best + 1, hi)])
                some = best > 0
                ranks[row[some], best[some] - 1] = self.ranks_of(ids[row[some], best[some] - 1] << 32 | new[some])
        return out

    def ranks_of(self, pairs: np.ndarray) -> np.ndarray:
        """The ranks of packed pairs; the number of pairs for those that do not merge."""
        at = np.minimum(np.searchsorted(self.sorted_pairs, pairs), len(self.sorted_pairs) - 1)
        return np.where(self.sorted_pairs[at] == pairs, self.sorted_ranks[at], len(self.pair))

    def lengths_of(self, texts: list[str]) -> list[int]:
        """How many ids encode gives each text. Unknown words of all texts are merged together; what is known is kept until it is more than `CACHE` words."""
        if len(self.lengths) > CACHE:
            self.lengths.clear()
        cut = [[part if k % 2 or self.odd(part) else part.split(" ") for k, part in enumerate(self.parts(t))] for t in texts]
        words: set[str] = set()
        words.update(*(part[1:] for parts in cut for part in parts if isinstance(part, list)))
        words -= self.lengths.keys()
        # Latin letters are one piece, and a mark after them another one of one id
        ended = {w: w[:-1] for w in words if w[-1:] in MARKS and w[:-1].isalpha() and max(w) < LATIN}
        words.difference_update(ended)
        plain = list({w for w in (*words, *ended.values()) if w.isalpha() and len(w) < 32 and (w.isascii() or max(w) < LATIN)} - self.lengths.keys())
        self.lengths.update(zip(plain, self.counts([(" " + w).encode() for w in plain]).tolist(), strict=True))
        words.difference_update(plain)
        words.update(w for w in ended.values() if w not in self.lengths)
        pieces = {w: self.find(" " + w) for w in words}
        fresh = list({p for ps in pieces.values() for p in ps if len(p) <= 16})
        known = dict(zip(fresh, self.counts([p.encode() for p in fresh]).tolist(), strict=True))
        self.lengths.update((w, sum([known[p] if p in known else len(self.known[p]) for p in ps])) for w, ps in pieces.items())
        found = self.lengths.__getitem__
        self.lengths.update((w, found(stem) + 1) for w, stem in ended.items())
        out = []
        for parts in cut:
            n = 0
            for k, part in enumerate(parts):
                if isinstance(part, list):
                    n += len(self.in_pieces(part[0])) + sum(map(found, part[1:]))
                else:
                    n += 1 if k % 2 else len(self.in_pieces(part))
            out.append(n)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _codec(spec: str, held: dict[str, Codec] = {}) -> Codec:  # noqa: B006  one for each worker
    if spec not in held:
        held.clear()
        held[spec] = Codec(spec)
    return held[spec]


def read_spec(path: str) -> str:
    """The tokenizer file's text, read where the driver runs; it travels with the task."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def bpe_encode(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids array<int> of every whole text."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec.value)
        for b in batches:
            for some in (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
                ids = [codec.encode(t or "") for t in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def bpe_lengths(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens (long) of every whole text."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec.value)
        for b in batches:
            for some in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
                n = codec.lengths_of([t or "" for t in some.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long")


def bpe_decode(tokens: DataFrame, tokenizer: str, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text: the vocabulary's strings of the ids, joined. Null ids give a null text."""
    spec = tokens.sparkSession.sparkContext.broadcast(read_spec(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec.value)
        for b in batches:
            texts = [None if x is None else codec.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = tokens.schema[doc_id].dataType.simpleString()
    return tokens.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{ids}`").alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")


def bpe_digest(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes as above, without carrying ids out of the worker."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec.value)
        written = codec.text_of.__getitem__
        for b in batches:
            n, seen, back = [], [], []
            for t in b.column(1):
                ids = codec.encode(t.as_py() or "")
                n.append(len(ids))
                seen.append(hashlib.sha256(",".join(map(written, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(seen, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
