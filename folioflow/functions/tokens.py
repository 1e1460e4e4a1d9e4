"""Characters to token ids and back, and small text helpers, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SPECIALS

PAD, START, NAN, END = range(4)
#: The reference's production vocabulary: code points below UNICODE, these custom characters beyond them, in its order, and the length its model takes.
UNICODE, MAX_LENGTH = 128, 512
CUSTOM = list("\xe4\xfc\xf6\u2014\u201e\u201d\xa3\xe8\u201c\xb4\xe9\xdf\xe0\u2019\xa7\u017f\ua75b\xb0\xbb\xab\xc9\x8d\xc4\xdc\xd6\u2020\xe1\x90\u204a\xeb\xf4\u201a\u201b\u0364\xe7\xe2\u2018\u03bf\u03b1\xfb\xea\u2606\u2670\xee\u0391\u03b9\u2039\u03c3\u03c4\xf3\u0395\u039c\xf1\u03c1\u039a\x8f\u201f\xe6")


class Tokenizer(Protocol):
    """What text models need of a tokenizer. The ids 0 to 3 are padding, start, unknown and end."""

    def encode(self, text: Column) -> Column: ...

    def decode(self, ids: Column) -> Column: ...

    def __len__(self) -> int: ...


@dataclass(frozen=True)
class Characters:
    """The tokenizer of single characters: code points below `unicode`, and custom ones."""

    unicode: int = UNICODE
    custom: tuple[str, ...] = tuple(CUSTOM)
    max_length: int | None = None
    pad: bool = False

    @property
    def letters(self) -> list[str]:
        found = alphabet(self.unicode, list(self.custom))
        if found[:4] != SPECIALS:
            raise ValueError("the first four ids belong to the specials")
        return found

    def encode(self, text: Column) -> Column:
        return tokenise(text, self.unicode, list(self.custom), self.max_length, self.pad)

    def decode(self, ids: Column) -> Column:
        return detokenise(ids, self.letters)

    def __len__(self) -> int:
        return len(self.letters)


def alphabet(length: int, custom: list[str] | None = None) -> list[str]:
    """The four specials, the first `length` code points, and custom characters not among them."""
    return list(dict.fromkeys([*SPECIALS, *map(chr, range(length)), *(custom or [])]))


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def tokenise(text: Column, unicode: int, custom: list[str] | None = None, max_length: int | None = None, pad: bool = False) -> Column:
    """START, an id for each character (NAN for unknown ones), END; padded on the right if asked and cut at max_length, END included.

    Code points below `unicode` need no table: their id is the code point plus 4. Only custom characters are looked up.
    """
    extra = {ord(c): i + unicode + 4 for i, c in enumerate(alphabet(unicode, custom)[len(SPECIALS) + unicode :]) if len(c) == 1}
    ids = F.arrow_udf(lambda texts: _encoded(texts, unicode, extra), "array<int>")(text)
    if pad and max_length is not None:
        ids = F.concat(ids, F.array_repeat(F.lit(PAD), F.greatest(F.lit(max_length) - F.size(ids), F.lit(0))))
    return F.slice(ids, 1, max_length) if max_length is not None else ids


def _encoded(texts: pa.Array, unicode: int, extra: dict[int, int]) -> pa.Array:
    """START, the ids and END of each text; null for null. extra: the ids of code points from `unicode` on."""
    known, to = np.array(sorted(extra), np.int64), np.array([extra[c] for c in sorted(extra)], np.int64)
    out = []
    for b in sliced(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
        codes, ends = code_points(b.column("text"))
        ids = codes + 4
        far = np.flatnonzero(codes >= unicode)
        at = np.minimum(np.searchsorted(known, codes[far]), max(len(known) - 1, 0))
        ids[far] = np.where(known[at] == codes[far], to[at], NAN) if len(known) else NAN
        n = np.arange(len(b))
        flat = np.empty(len(ids) + 2 * len(b), np.int32)
        stop = ends + 2 * n + 2
        start = np.concatenate([[0], stop[:-1]])
        inside = np.ones(len(flat), bool)
        inside[start] = inside[stop - 1] = False
        flat[inside], flat[start], flat[stop - 1] = ids, START, END
        out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]), pa.int32()), pa.array(flat), mask=b.column("text").is_null()))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))


def sliced(b: pa.RecordBatch, *texts: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """b in slices of up to `most` bytes of text (a longer text is a slice of its own), so that what numpy makes of them stays bounded."""
    sizes = sum(pc.fill_null(pc.binary_length(b.column(t)), 0).to_numpy(zero_copy_only=False) for t in texts)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(ends):
        upto = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")), at + 1)
        yield b.slice(at, upto - at)
        at = upto


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts one after the other, and where each text ends; null texts have none."""
    codes = np.frombuffer("".join(t for t in texts.to_pylist() if t).encode("utf-32-le"), np.uint32).astype(np.int64)
    return codes, np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)


def narrow_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same as single bytes where all lie below 128, else as four bytes each: read from Arrow's memory, no Python text is made of a row."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    _, starts, data = texts.buffers()
    if not len(ends) or not ends[-1]:
        return np.empty(0, np.uint8), ends
    at = int(np.frombuffer(starts, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset])
    codes = np.frombuffer(data, np.uint8)[at : at + ends[-1]]
    if codes.max() < 128:
        return codes, ends
    codes = np.frombuffer(codes.tobytes().decode().encode("utf-32-le"), np.uint32)
    return codes, np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)


def code_point(c: Column) -> Column:
    return F.ascii(c)


def detokenise(ids: Column, letters: list[str], specials: bool = False) -> Column:
    """Text of the ids after the first up to END; PAD, START and NAN only show if asked."""
    hidden = [] if specials else [PAD, START, NAN]
    return F.arrow_udf(lambda found: _decoded(found, letters, hidden), "string")(ids)


def _decoded(ids: pa.Array, letters: list[str], hidden: list[int], most: int = 1 << 20) -> pa.Array:
    """The letters of each row's ids between the first and END, without hidden ones and ids that have no letter; null for null. Up to `most` ids at a time."""
    sizes = np.array([len(x) for x in letters], np.int64)
    spelt, begins = np.array([ord(c) for x in letters for c in x], np.uint32), np.cumsum(sizes) - sizes
    shown = ~np.isin(np.arange(len(letters)), hidden)
    lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    ends, out, at = np.cumsum(lengths, dtype=np.int64), [], 0
    while at < len(ids):
        upto = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")), at + 1)
        flat = pc.fill_null(ids.slice(at, upto - at).flatten().cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
        n = lengths[at:upto]
        stop = np.cumsum(n, dtype=np.int64)
        start = np.minimum(stop - n + 1, stop)
        marks = np.append(np.flatnonzero(flat == END), len(flat))
        last = np.minimum(marks[np.searchsorted(marks, start)], stop)
        row = np.repeat(np.arange(len(n)), last - start)
        flat = flat[np.arange(len(row)) + np.repeat(start - np.cumsum(last - start) + (last - start), last - start)]
        some = (flat >= 0) & (flat < len(letters))
        some[some] = shown[flat[some]]
        flat, row = flat[some], row[some]
        size = sizes[flat]
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        text = spelt[np.repeat(begins[flat], size) + place].tobytes().decode("utf-32-le")
        to = np.cumsum(np.bincount(row, size, len(n)).astype(np.int64)).tolist()
        out += [text[a:b] for a, b in zip([0, *to[:-1]], to, strict=True)]
        at = upto
    return pa.array(out, pa.string(), mask=ids.is_null().to_numpy(zero_copy_only=False))


def extended(known: Column, more: Column) -> Column:
    """known and the letters of more that it lacks, each once, in the order in which they come."""
    return F.array_distinct(F.concat(known, more))


def replaced(text: Column, by: dict[str, str]) -> Column:
    """Substrings replaced one after the other, in the order given."""
    for old, new in by.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def with_slash(path: Column) -> Column:
    return F.when(F.endswith(path, F.lit("/")), path).otherwise(F.concat(path, F.lit("/")))


def without_slash(path: Column) -> Column:
    return F.regexp_replace(path, "/$", "")


def stem(path: Column, suffix: int = 4) -> Column:
    """File name without directories and its last characters."""
    name = F.substring_index(path, "/", -1)
    return F.substr(name, F.lit(1), F.length(name) - suffix)


def short_stem(path: Column, suffix: int = 4) -> Column:
    """As stem, and empty for names shorter than the suffix."""
    name = F.substring_index(path, "/", -1)
    return F.substr(name, F.lit(1), F.greatest(F.length(name) - suffix, F.lit(0)))
