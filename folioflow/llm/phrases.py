"""Phrase collocation mining: compressed position bitmaps per word, extended depth-first by shift, AND and popcount.

Texts are cut at punctuation and line ends into pieces and these into words; everything is counted per language. A
phrase's score is the square of its count over the product of its two parts' counts, in millionths, for the cut where
this is lowest; a phrase that a longer one covers for a given share of its occurrences is dropped.

How it runs: documents are laid out in shards of about `SHARD` tokens, written once to the shared folder, as word
numbers with a gap after every piece. A shard keeps a bitmap of positions for each of its words that is frequent in the
whole corpus: the non-zero words of `WIDTH` bits with their places. A phrase's bitmap holds the positions of its last
words; shifted by one and combined by AND with the bitmaps of all words that have bits in the same places, it gives the
bitmaps of all phrases one word longer, and their popcounts are the shard's counts. A gap belongs to no word, so no
phrase crosses a piece. The walk is depth-first over groups of first words that hold `GROUP` bits, so few bitmaps live
at once. Counts of all shards are added up length by length; only phrases that are frequent in all go back to the shards
that hold them, and a phrase is extended only if it is frequent without its last word and without its first.

Frequent words are numbered without gaps in the order of the written table, and phrases are told apart by their words'
numbers, two in a long, so nothing depends on hashes. All counts are exact; products are decimals of 38 digits, exact for counts below 1e15.

Defined cases: a null text is empty; a null language is `und`, together with one of that name; repeated rows count each
time; ties are broken by count and then by the phrase's UTF-8 bytes; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, staged_by
from .katz import pack, unpack

SHARD = 2_000_000
WIDTH = 16
GROUP = 200_000
#: Parts in which a language's best phrases are found before they are ranked together.
PARTS = 64
#: A-Z lower-cased, tabs made spaces and the characters that end a piece made one; the gap between pieces is written
#: as a word that no text can have.
TABLE = bytes(x + 32 if 65 <= x <= 90 else 32 if x == 9 else 46 if x in b".,;:!?" or 10 <= x <= 13 else x for x in range(256))
GAP = b"."


class Numbers(dict):
    """word -> number, given in order of appearance from the shard's counter."""

    def __init__(self, shard: _Shard) -> None:
        super().__init__()
        self[GAP] = 0
        self.shard = shard

    def __missing__(self, word: bytes) -> int:
        self.shard.words += 1
        self[word] = self.shard.words
        return self.shard.words


class _Shard:
    """The tokens of a shard while it is laid out."""

    def __init__(self) -> None:
        self.words, self.tokens = 0, 0
        self.known: dict[str, Numbers] = {}
        self.at: list[np.ndarray] = []

    def add(self, lang: str, text: bytes) -> None:
        """A text, or whole pieces of one, in the TABLE's bytes."""
        if lang not in self.known:
            self.known[lang] = Numbers(self)
        ws = text.replace(GAP, b" . ").split()
        ids = np.fromiter(map(self.known[lang].__getitem__, ws), np.int32, len(ws))
        self.at.append(np.append(ids, np.int32(0)))
        self.tokens += len(ids) + 1

    def row(self, name: int) -> pa.RecordBatch:
        """One row: name, tokens (packed), and for each language its words, their numbers and their counts."""
        at = np.concatenate(self.at)
        n = np.bincount(at, minlength=self.words + 1)
        vocabulary = []
        for lang, known in self.known.items():
            del known[GAP]
            ids = np.fromiter(known.values(), np.int64, len(known))
            vocabulary.append({"lang": lang, "words": list(known), "places": ids, "n": n[ids]})
        kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.list_(pa.binary())), ("places", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))]))
        return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([pack(at)], pa.binary()), pa.array([vocabulary], kind)], names=["shard", "at", "vocabulary"])


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in stretches of whole pieces that a shard can take."""
    most = 4 * SHARD
    text, begin = text.translate(TABLE), 0
    while len(text) - begin > most:
        end = text.rfind(GAP, begin, begin + most) + 1 or text.find(GAP, begin + most) + 1 or len(text)
        yield text[begin:end]
        begin = end
    yield text[begin:]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, made, shard = TaskContext.get().partitionId(), 0, _Shard()
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            for some in _pieces(text.as_py() or b""):
                shard.add(lang, some)
                if shard.tokens >= SHARD:
                    yield shard.row(part << 32 | made)
                    made, shard = made + 1, _Shard()
    if shard.tokens:
        yield shard.row(part << 32 | made)


class Bitmaps:
    """The bitmaps of a shard's frequent words, by word and by place."""

    def __init__(self, at: np.ndarray, frequent: np.ndarray) -> None:
        """frequent: whether each word number is."""
        self.blocks = len(at) // WIDTH + 2
        where = np.flatnonzero(frequent[at])
        key = np.sort(at[where].astype(np.int64) << 32 | where)
        word, where = key >> 32, key & 0xFFFFFFFF
        block = where // WIDTH
        first = np.flatnonzero(np.r_[True, (np.diff(word) != 0) | (np.diff(block) != 0)][: len(where)])
        bits = np.left_shift(np.uint16(1), (where % WIDTH).astype(np.uint16))
        self.word, self.block = word[first], block[first]
        self.bits = np.bitwise_or.reduceat(bits, first) if len(first) else bits
        # the same bitmaps, those with bits in one place side by side
        order = np.argsort(self.block << 32 | self.word)
        self.by_block = self.word[order], self.bits[order]
        self.begin = np.searchsorted(self.block[order], np.arange(self.blocks + 1))
        self.words = len(frequent)

    def groups(self) -> Iterator[slice]:
        """Slices of the bitmaps by word, whole words, of about GROUP entries."""
        new = np.flatnonzero(np.r_[True, np.diff(self.word) != 0][: len(self.word)])
        ends, begin = np.append(new[1:], len(self.word)), 0
        while begin < len(self.word):
            end = int(ends[min(np.searchsorted(ends, begin + GROUP), len(ends) - 1)])
            yield slice(begin, end)
            begin = end

    def shift(self, of: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each phrase's bitmap moved by one position; a block's last bit moves to the next block."""
        over = np.flatnonzero(bits >> np.uint16(WIDTH - 1))
        key = np.concatenate([of * self.blocks + block, of[over] * self.blocks + block[over] + 1])
        moved = np.concatenate([bits << np.uint16(1), np.ones(len(over), np.uint16)])
        order = np.argsort(key, kind="stable")
        key, moved = key[order], moved[order]
        first = np.flatnonzero(np.r_[True, np.diff(key) != 0][: len(key)])
        moved = np.bitwise_or.reduceat(moved, first) if len(first) else moved
        of, block = np.divmod(key[first], self.blocks)
        some = moved != 0
        return of[some], block[some], moved[some]

    def extend(self, of: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of bitmaps in order of phrase and block: those of all phrases that are one word longer, as (of, word, popcount) of each phrase and (phrase, block, bits) of its bitmap."""
        of, block, bits = self.shift(of, block, bits)
        n = self.begin[block + 1] - self.begin[block]
        each = np.repeat(np.arange(len(of)), n)
        place = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + self.begin[block][each]
        word, other = self.by_block
        both = bits[each] & other[place]
        some = np.flatnonzero(both)
        phrase = of[each[some]] * self.words + word[place[some]]  # a shard's words and places are few enough for one number
        order = np.argsort(phrase * self.blocks + block[each[some]])
        phrase, block, both = phrase[order], block[each[some[order]]], both[some[order]]
        first = np.flatnonzero(np.r_[True, np.diff(phrase) != 0][: len(phrase)])
        count = np.add.reduceat(np.bitwise_count(both).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        of, word = np.divmod(phrase[first], self.words)
        return of, word, count, np.repeat(np.arange(len(first)), np.diff(first, append=len(phrase))), block, both


class Known:
    """The frequent phrases of one length that a shard holds, by the place of the phrase without its last word and the last word."""

    def __init__(self, prefix: np.ndarray, last: np.ndarray, words: int) -> None:
        self.words = words
        self.codes = np.unique(prefix * words + last)

    def find(self, prefix: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The phrases' places; -1 where it is not one of them, or its prefix is not."""
        code = prefix * self.words + last
        at = np.searchsorted(self.codes, code)
        hit = (prefix >= 0) & (at < len(self.codes))
        hit[hit] = self.codes[at[hit]] == code[hit]
        return np.where(hit, at, -1)


def _walk(row: pa.Table, replies: pa.Table, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, counts): the shard's phrases of `length` words that may be frequent, by the numbers of their words in the corpus."""
    at = unpack(row.column("at")[0].as_py(), np.int32)
    level = replies.column("level").to_numpy()
    words = _unpacked(replies, length - 1)
    ones = np.flatnonzero(level == 1)
    ids = np.full(int(at.max()) + 1, -1, np.int64)
    ids[replies.column("place").to_numpy()[ones]] = words[ones, 0]
    by_id = np.argsort(ids, kind="stable")
    known: list[Known | None] = [None, None]
    for m in range(2, length):
        mine = words[level == m]
        local = by_id[np.searchsorted(ids, mine[:, :m], sorter=by_id)]
        prefix = local[:, 0]
        for k in range(2, m):
            prefix = known[k].find(prefix, local[:, k - 1])
        known.append(Known(prefix, local[:, m - 1], len(ids)))
    maps = Bitmaps(at, ids >= 0)
    for group in maps.groups():
        word, block, bits = maps.word[group], maps.block[group], maps.bits[group]
        new = np.r_[True, np.diff(word) != 0]
        phrases, of = word[new][:, None], np.cumsum(new) - 1
        own = tail = phrases[:, 0]  # the phrase's place among the frequent ones, and that of the phrase without its first word
        for m in range(2, length + 1):
            before, word, count, of, block, bits = maps.extend(of, block, bits)
            rest = known[m - 1].find(tail[before], word) if m > 2 else word
            here = known[m].find(own[before], word) if m < length else np.zeros(len(word), np.int64)
            keep = (rest >= 0) & (here >= 0)
            phrases = np.concatenate([phrases[before[keep]], word[keep][:, None]], axis=1)
            own, tail, count = here[keep], rest[keep], count[keep]
            some = keep[of]
            of, block, bits = (np.cumsum(keep) - 1)[of[some]], block[some], bits[some]
        yield ids[phrases], count


def _names(m: int) -> list[str]:
    return [f"w{i}" for i in range(m)]


def _keys(m: int) -> list[str]:
    return [f"k{i}" for i in range((m + 1) // 2)]


def _packed(words: np.ndarray) -> dict[str, np.ndarray]:
    """The numbers of phrases' words, two in a long; a last one alone is the upper half."""
    if words.shape[1] % 2:
        words = np.concatenate([words, np.zeros((len(words), 1), np.int64)], axis=1)
    return {f"k{i // 2}": words[:, i] << 32 | words[:, i + 1] for i in range(0, words.shape[1], 2)}


def _unpacked(t: pa.Table, m: int) -> np.ndarray:
    keys = [t.column(c).to_numpy() for c in _keys(m)]
    return np.stack([x for k in keys for x in (k >> 32, k & 0xFFFFFFFF)], axis=1)


def _word(i: int) -> Column:
    k = F.col(f"k{i // 2}")
    return (F.shiftright(k, 32) if i % 2 == 0 else k.bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"w{i}")


def _counts(m: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(row: pa.Table, replies: pa.Table) -> pa.Table:
        made = [*_walk(row, replies, m)] if replies.num_rows else []
        words = np.concatenate([np.zeros((0, m), np.int64), *(w for w, _ in made)])
        n = np.concatenate([np.zeros(0, np.int64), *(c for _, c in made)])
        shard = np.full(len(n), row.column("shard")[0].as_py(), np.int64)
        return pa.table({"shard": shard, **_packed(words), "n": n})

    return run


def _numbered(words: DataFrame) -> DataFrame:
    """words (a written table) with w0, their numbers from 0 without gaps: places in a file's part, after the parts before."""
    part, place = F.spark_partition_id(), F.monotonically_increasing_id()
    words = staged(words.withColumn("part", part).withColumn("place", place.bitwiseAND(F.lit((1 << 33) - 1))), "frequent-words")
    sizes = sorted((r[0], r[1]) for r in words.groupBy("part").count().collect())  # a row for each partition
    total, before = 0, {}
    for k, n in sizes:
        before[k], total = total, total + n
    if total >= 1 << 31:
        raise ValueError("more frequent words than two to a long")
    starts = words.sparkSession.createDataFrame(list(before.items()), "part int, before long")
    return words.join(F.broadcast(starts), "part").withColumn("w0", F.col("before") + F.col("place")).drop("part", "place", "before")


def frequent_phrases(docs: DataFrame, min_count: int = 10, max_words: int = 3, text: str = "text", lang: str = "lang") -> tuple[DataFrame, list[DataFrame]]:
    """lang, n (words in all); and for each length from 1 the phrases that occur min_count times, as w0, w1, ... (numbers of words) and f, those of one word with lang and word."""
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("binary").alias("text"))
    kind = "shard long, at binary, vocabulary array<struct<lang:string,words:array<binary>,places:array<long>,n:array<long>>>"
    laid = staged_by(some.mapInArrow(_shards, kind), "phrase-shards", "shard", width)
    held = laid.select("shard", F.explode("vocabulary").alias("v")).select("shard", "v.lang", F.explode(F.arrays_zip("v.words", "v.places", "v.n")).alias("x"))
    held = held.select("shard", "lang", F.col("x.words").cast("string").alias("word"), F.col("x.places").alias("place"), F.col("x.n").alias("n"))
    counts = staged(held.groupBy("lang", "word").agg(F.sum("n").alias("f")), "phrase-words")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    found = [staged(_numbered(counts.where(F.col("f") >= min_count)), "frequent-1")]
    # the frequent side of these joins is never broadcast: shards get their replies in one way, however many there are
    ones = held.join(found[0].hint("shuffle_hash"), ["lang", "word"])
    replies = [staged(ones.select(F.col("shard").alias("of"), F.lit(1).alias("level"), "place", F.shiftleft("w0", 32).alias("k0")), "phrase-replies")]
    for m in range(2, max_words + 1):
        keys = _keys(m)
        told = [r.select("of", "level", "place", *[c if c in r.columns else F.lit(0).cast("long").alias(c) for c in _keys(m - 1)]) for r in replies]
        told = reduce(DataFrame.unionByName, told)
        asked = laid.select("shard", "at").groupBy("shard").cogroup(told.groupBy("of")).applyInArrow(_counts(m), ", ".join(f"{c} long" for c in ["shard", *keys, "n"]))
        asked = staged(asked, f"phrases-{m}") if m < max_words else asked
        frequent = staged(asked.groupBy(*keys).agg(F.sum("n").alias("f")).where(F.col("f") >= min_count), f"frequent-{m}")
        found.append(frequent.select(*[_word(i) for i in range(m)], "f"))
        if m < max_words:
            mine = asked.select("shard", *keys).join(frequent.select(*keys).hint("shuffle_hash"), keys, "left_semi")
            replies.append(staged(mine.select(F.col("shard").alias("of"), F.lit(m).alias("level"), F.lit(0).cast("long").alias("place"), *keys), "phrase-replies"))
    return totals, found


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exactly."""
    whole = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (whole(a) * whole(a)), whole(left) * whole(right))


def collocations(docs: DataFrame, min_count: int = 10, max_words: int = 3, cover: int = 50, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of 2 to max_words words."""
    totals, found = frequent_phrases(docs, min_count, max_words, text, lang)
    words = found[0]
    named = [words.select("w0", "lang", F.col("word").alias("phrase"), "f")]
    for m in range(2, max_words + 1):
        w, last = _names(m), f"w{m - 1}"
        before = named[-1].withColumnsRenamed({"f": "f_before", "phrase": "start"})
        after = words.select(F.col("w0").alias(last), F.col("word").alias("end"), F.col("f").alias("f_after"))
        x = found[m - 1].join(before.select(*w[:-1], "lang", "start", "f_before"), w[:-1]).join(after, last)
        cuts = [_cut(m - 1, F.col("f_before"), F.col("f_after"))]
        for k in range(1, m - 1):
            heads = found[k - 1].select(*w[:k], F.col("f").alias(f"head{k}"))
            tails = found[m - k - 1].select(*[F.col(f"w{i}").alias(f"w{i + k}") for i in range(m - k)], F.col("f").alias(f"tail{k}"))
            x = x.join(heads, w[:k]).join(tails, w[k:])
            cuts.append(_cut(k, F.col(f"head{k}"), F.col(f"tail{k}")))
        x = x.select(*w, "lang", F.concat_ws(" ", "start", "end").alias("phrase"), "f", F.array_min(F.array(*cuts)).alias("cut"))
        named.append(staged(x, f"scored-{m}"))
    kept = []
    for m in range(2, max_words + 1):
        x = named[m - 1]
        inside = None
        for longer in range(m + 1, max_words + 1):
            parts = F.explode(F.array(*[F.struct(*[F.col(f"w{i + j}").alias(f"w{j}") for j in range(m)]) for i in range(longer - m + 1)]))
            mine = found[longer - 1].select(parts.alias("p"), "f").groupBy("p").agg(F.max("f").alias("most")).select("p.*", "most")
            inside = mine if inside is None else inside.unionByName(mine)
        if inside is not None:
            x = x.join(inside.groupBy(*_names(m)).agg(F.max("most").alias("most")), _names(m), "left").where(F.col("most").isNull() | (100 * F.col("most") < cover * F.col("f")))
        kept.append(x.select("lang", "phrase", F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score")))
    out = kept[0]
    for x in kept[1:]:
        out = out.unionByName(x)
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    out = out.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    out = out.join(totals, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _cut(k: int, left: Column, right: Column) -> Column:
    return F.struct(score(F.col("f"), left, right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))
