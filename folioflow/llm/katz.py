"""Language-model scoring: a Katz backoff model of any order, counted over the whole training part and evaluated per token.

P(w | h) = d(c) c(h w) / c(h) where the words h w were seen in training, else a(h) P(w | h'), where h' lacks h's first
word; P(w) = d(c) c(w) / N where the word was seen, else the mass that the words' discounts leave (one unknown type).
d are Good-Turing discounts with Katz's correction for counts up to 5, for each length of n-grams; a(h) = (1 - sum of
h's discounted followers) / (1 - sum of their P(w | h')), so every history's probabilities add up to one. Where no
discount leaves mass, one count is added to the total and left over. A document is preceded by start marks.

How it runs: a first pass turns each stretch of documents (about `STRETCH` tokens, written to the shared folder) into a
sorted list of word hashes and a stream of places in it. A stretch sends each of its distinct words, and then, length
by length, each of its distinct n-grams, once, with its training count, to the bucket of the word or of the n-gram's
history; the bucket adds the counts of all stretches up and answers each of them, in order. Buckets (`BUCKET` tokens
each) are the model's partitioned tables; the answers are all that a stretch needs to score its documents, so the model
is never collected or broadcast. Answers about a history are whole numbers: how many followers were seen 1 to 5 times,
how many of them have 1 to 5 counts without the history's first word, and the sum of the larger such counts; sums of
discounted probabilities follow from these. The n-grams of a history with more than 1 / min(buckets, `HOT`) of all
tokens are dealt over several buckets by their last word; the numbers of these histories, at most HOT of them, are
added up and sent to all tasks. Words are told apart by 64-bit hashes; each then has a number of its own (bucket and
place in it), and n-grams are told apart by these numbers. Arrays travel as zstd bytes.

Defined cases: null and empty texts have the end token alone; rows whose `train` is null are not learnt from; without
training rows every probability is that of one unknown type (score 0) and N is 0; repeated rows count and are scored
each; texts of any length stay whole (a text longer than a stretch is one stretch); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, staged_by
from .minhash import U, WordHash, mix

STRETCH = 1_500_000
BUCKET = 1_500_000
HOT = 65_536
K = 5
END = U(0xEF46DB3751D8E999)
#: The number of the start mark, above those of all words.
BEGIN = np.int64(1 << 62)


def pack(a: np.ndarray, ordered: bool = False) -> bytes:
    """zstd of the array's byte planes; a sorted one as differences."""
    if ordered and len(a):
        a = np.diff(a, prepend=a.dtype.type(0))
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    return len(a).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpack(b: bytes, kind: type, ordered: bool = False) -> np.ndarray:
    n, size = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    flat = np.frombuffer(pa.decompress(b[8:], n * size, codec="zstd", asbytes=True), np.uint8)
    a = np.ascontiguousarray(flat.reshape(size, n).T).reshape(-1).view(kind)
    return np.cumsum(a, dtype=kind) if ordered else a


def discounts(n: list[int]) -> np.ndarray:
    """d[0..K+1]: Katz's discount of counts 0 to K, and 1 above, from the numbers n[r] of types seen r times (r = 0..K+1).

    Where the numbers admit no discounts in (0, 1] for counts up to K, the largest smaller bound that does is taken.
    """
    for k in range(K, 0, -1):
        if min(n[1 : k + 2]) <= 0:
            continue
        common = (k + 1) * n[k + 1] / n[1]
        d = np.ones(K + 2)
        if common < 1:
            d[1 : k + 1] = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) for r in range(1, k + 1)]
            if (d[1 : k + 1] > 0).all() and (d[1 : k + 1] <= 1).all():
                return d
    return np.ones(K + 2)


class Unigrams:
    """The distribution of single words, from counts of counts."""

    def __init__(self, total: int, types: int, n: list[int]) -> None:
        self.total, self.types, self.d = total, types, discounts(n)
        left = sum((1 - self.d[r]) * r * n[r] for r in range(1, K + 1))
        self.scale = max(total, 1) if left > 1e-9 or not total else total + 1.0
        self.unknown = left / self.scale if left > 1e-9 else 1.0 / (total + 1)

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.d[np.minimum(c, K + 1)] * c / self.scale, self.unknown)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHash()
    task, made = TaskContext.get().partitionId(), 0
    held: list[np.ndarray] = []
    rows: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        words, at = np.unique(np.concatenate(held), return_inverse=True)
        cols = [pa.array([(task << 24) + made], pa.int64()), pa.array([sum(len(h) for h in held)], pa.int64()), pa.array([pack(words, True)], pa.binary()), pa.array([pack(at.astype(np.int32))], pa.binary())]
        cols += [pa.array([[r[i] for r in rows]], kind) for i, kind in ((0, pa.list_(pa.int64())), (1, pa.list_(pa.bool_()))) ]
        cols.append(pa.array([[len(h) for h in held]], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(cols, names=["stretch", "tokens", "words", "at", "ids", "train", "lengths"])

    for b in batches:
        for i, learn, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            ws = (t.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
            h = np.full(len(ws) + 1, END)
            h[:-1] = np.fromiter(map(known.__getitem__, ws), U, len(ws))
            if held and size + len(h) > STRETCH:
                yield flush()
                held, rows, size, made = [], [], 0, made + 1
            held.append(h)
            rows.append((i, bool(learn)))
            size += len(h)
    if held:
        yield flush()


class Grams:
    """The distinct n-grams of one length in a stretch, sorted: places of their histories (n-grams one shorter; the last place is that of start marks alone), of their last words and of what they are without their first word; training counts; each token's n-gram."""

    def __init__(self, shorter: np.ndarray, n_shorter: int, s: Stretch) -> None:
        before = np.empty_like(shorter)
        before[1:] = shorter[:-1]
        before[s.starts] = n_shorter
        code, self.which = np.unique(before * len(s.words) + s.at, return_inverse=True)
        self.history, self.word = code // len(s.words), code % len(s.words)
        self.tail = np.empty(len(code), np.int64)
        self.tail[self.which] = shorter
        self.n = np.bincount(self.which[s.learn], minlength=len(code)).astype(np.int32)


class Stretch:
    """One stretch's tokens and what is known of its n-grams: `at` are places in `words`."""

    def __init__(self, row: dict) -> None:
        self.row = row
        self.words = unpack(row["words"], U, True)
        self.at = unpack(row["at"], np.int32).astype(np.int64)
        self.lengths = np.array(row["lengths"], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.learn = np.repeat(np.array(row["train"], dtype=bool), self.lengths)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.at[self.learn], minlength=len(self.words)).astype(np.int32)

    def open(self, replies: pa.Table, starts: int, total: int, bits: int) -> None:
        """Takes the words' answers. keys: the numbers of the longest n-grams so far, start marks last; counts: theirs."""
        self.deal, self.starts_seen = (total, bits), starts
        rows = sorted((r for r in replies.to_pylist() if r["level"] == 1), key=lambda r: r["bucket"])
        self.ids = np.concatenate([(r["bucket"] << 32) + unpack(r["ids"], np.int64, True) for r in rows])
        self.counts = np.append(np.concatenate([unpack(r["counts"], np.int64) for r in rows]), starts)
        self.keys = [np.append(self.ids, BEGIN)]
        self.grams: list[Grams] = []

    def deepen(self) -> Grams:
        """The next longer n-grams; `dealt` speaks of them until `take` has their counts."""
        g = Grams(self.grams[-1].which, len(self.grams[-1].history), self) if self.grams else Grams(self.at, len(self.words), self)
        self.grams.append(g)
        return g

    def dealt(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order that sorts the longest n-grams by bucket (then as they were), the buckets in that order, and which histories are hot."""
        g, (total, bits) = self.grams[-1], self.deal
        h = np.zeros(len(self.counts), U)
        for k in self.keys:
            h = mix(h + k.view(U))
        spread = np.maximum(1, -(-self.counts * min(1 << bits, HOT) // max(total, 1)))
        base = h >> U(64 - bits) if bits else np.zeros(len(h), U)
        bucket = (base[g.history] + mix(self.ids.view(U))[g.word] % spread[g.history].astype(U)) % U(1 << bits)
        order = np.argsort(bucket, kind="stable")
        return order, bucket[order], spread > 1

    def take(self, counts: np.ndarray) -> None:
        """The training counts of the longest n-grams."""
        g = self.grams[-1]
        self.keys = [np.append(k[g.history], BEGIN) for k in self.keys] + [np.append(self.ids[g.word], BEGIN)]
        self.counts = np.append(counts, self.starts_seen)

    def answers(self, replies: pa.Table, level: int) -> Iterator[tuple[np.ndarray, dict]]:
        """The places of the longest n-grams that each bucket has answered, and its answer."""
        order, buckets, _ = self.dealt()
        found = {r["bucket"]: r for r in replies.to_pylist() if r["level"] == level}
        for k, cut in _cut(buckets):
            yield order[cut], found[k]

    def counted(self, replies: pa.Table, level: int) -> np.ndarray:
        out = np.empty(len(self.grams[-1].history), np.int64)
        for mine, r in self.answers(replies, level):
            out[mine] = unpack(r["counts"], np.int64)
        return out


def _cut(buckets: np.ndarray) -> list[tuple[int, slice]]:
    ends = np.flatnonzero(np.append(np.diff(buckets) != 0, True)) + 1 if len(buckets) else []
    begin, out = 0, []
    for e in ends:
        out.append((int(buckets[begin]), slice(begin, int(e))))
        begin = int(e)
    return out


def _rows(table: pa.Table, key: str) -> list[dict]:
    return sorted(table.to_pylist(), key=lambda r: r[key])


def _table(columns: dict[str, list], **kinds: pa.DataType) -> pa.Table:
    return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in columns.items()})


def _times(c: np.ndarray) -> list[int]:
    """How many have a count of 1 to K + 1."""
    return np.bincount(np.minimum(c, K + 2), minlength=K + 3)[1 : K + 2].tolist()


REPLY = "of long, level int, bucket int, counts binary, ids binary, few binary, low binary, rest binary"
I32, I64 = pa.int32(), pa.int64()


def katz_scores(docs: DataFrame, train: Column, order: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10) of every document, under a model of n-grams of up to `order` words."""
    if order < 1:
        raise ValueError("the order is at least 1")
    spark = docs.sparkSession
    some = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), train.alias("train"), F.col(f"`{text}`").alias("text"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = staged_by(some.mapInArrow(_stretches, "stretch long, tokens long, words binary, at binary, ids array<long>, train array<boolean>, lengths array<int>"), "lm-stretches", "stretch", width)
    tokens = laid.agg(F.sum("tokens")).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(tokens / BUCKET, min(width, 1 + tokens // 10_000), 1)))))

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                s = Stretch(r)
                n = s.word_counts()
                cuts = _cut(s.words >> U(64 - bits) if bits else np.zeros(len(s.words), U))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([k for k, _ in cuts], I32), "stretch": pa.array([r["stretch"]] * len(cuts), I64), "words": pa.array([pack(s.words[c], True) for _, c in cuts], pa.binary()), "n": pa.array([pack(n[c]) for _, c in cuts], pa.binary())})

    def count_words(t: pa.Table) -> pa.Table:
        rows = _rows(t, "stretch")
        parts = [unpack(r["words"], U, True) for r in rows]
        words, at = np.unique(np.concatenate(parts), return_inverse=True)
        c = np.bincount(at, np.concatenate([unpack(r["n"], np.int32) for r in rows]), len(words)).astype(np.int64)
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        stats = [int(c.sum()), int((c > 0).sum()), *_times(c)]
        out = {"stretch": [*(r["stretch"] for r in rows), None], "bucket": [rows[0]["bucket"]] * (len(rows) + 1), "counts": [*(pack(x) for x in np.split(c[at], cuts)), None], "ids": [*(pack(x.astype(np.int64), True) for x in np.split(at, cuts)), None], "stats": [*([None] * len(rows)), stats]}
        return _table(out, stretch=I64, bucket=I32, stats=pa.list_(I64))

    asked = laid.mapInArrow(ask_words, "bucket int, stretch long, words binary, n binary")
    words = staged(asked.groupBy("bucket").applyInArrow(count_words, "stretch long, bucket int, counts binary, ids binary, stats array<long>"), "lm-words")
    sums = words.where("stats is not null").agg(*[F.sum(F.col("stats")[i]) for i in range(K + 3)]).first()  # one row
    total, types, *n1 = [int(x or 0) for x in sums]
    uni = Unigrams(total, types, [0, *n1])
    starts = int(laid.select(F.sum(F.expr("size(filter(train, x -> x))"))).first()[0] or 0)
    none = F.lit(None).cast("binary")
    replies = words.where("counts is not null").select(F.col("stretch").alias("of"), F.lit(1).alias("level"), "bucket", "counts", "ids", none.alias("few"), none.alias("low"), none.alias("rest"))
    by = laid.groupBy("stretch")
    discount = [uni.d]
    hot_of = []

    def opened(row: pa.Table, replies: pa.Table, level: int) -> Stretch:
        """The stretch with its n-grams shorter than `level` counted and those of that length found."""
        s = Stretch(row.to_pylist()[0])
        s.open(replies, starts, total, bits)
        for k in range(2, level):
            s.deepen()
            s.take(s.counted(replies, k))
        s.deepen()
        return s

    def ask(level: int):  # noqa: ANN202
        def run(row: pa.Table, replies: pa.Table) -> pa.Table:
            s = opened(row, replies, level)
            g, low = s.grams[-1], s.counts
            order, buckets, hot = s.dealt()
            h, w, n, low = g.history[order], s.ids[g.word[order]], g.n[order], low[g.tail[order]]
            out: dict[str, list] = {k: [] for k in ("bucket", "stretch", "h", "times", "hot", "w", "low", "n")}
            for k, cut in _cut(buckets):
                new = np.flatnonzero(np.diff(h[cut], prepend=-1))
                names = h[cut][new]
                out["bucket"].append(k)
                out["stretch"].append(s.row["stretch"])
                out["h"].append([pack(x[names], not i) for i, x in enumerate(s.keys)])
                out["times"].append(pack(np.diff(new, append=cut.stop - cut.start).astype(np.int32)))
                out["hot"].append(pack(hot[names].astype(np.uint8)))
                out["w"].append(pack(w[cut]))
                out["low"].append(pack(low[cut]))
                out["n"].append(pack(n[cut]))
            return _table(out, bucket=I32, stretch=I64, h=pa.list_(pa.binary()))

        return run

    def count(t: pa.Table) -> pa.Table:
        rows = _rows(t, "stretch")
        times = [unpack(r["times"], np.int32) for r in rows]
        each_h = [np.concatenate([np.repeat(unpack(r["h"][i], np.int64, not i), x) for r, x in zip(rows, times, strict=True)]) for i in range(len(rows[0]["h"]))]
        w, low, n = (np.concatenate([unpack(r[k], kind) for r in rows]) for k, kind in (("w", np.int64), ("low", np.int64), ("n", np.int32)))
        order = np.lexsort((w, *reversed(each_h)))
        new_h = np.zeros(len(w), bool)
        new_h[0] = True
        for x in each_h:
            new_h[1:] |= np.diff(x[order]) != 0
        first = np.flatnonzero(new_h | np.r_[True, np.diff(w[order]) != 0])
        c = np.add.reduceat(n[order].astype(np.int64), first)
        each = np.empty(len(w), np.int64)
        each[order] = np.repeat(c, np.diff(first, append=len(w)))
        place = np.empty(len(w), np.int64)  # each n-gram's history among the bucket's
        place[order] = np.cumsum(new_h) - 1
        of = np.flatnonzero(new_h[first])  # histories among the distinct n-grams
        lower = np.where(c > 0, low[order][first], 0)
        sums = lambda x: np.add.reduceat(x, of)
        few, less = (np.stack([sums((x == r).astype(np.int32)) for r in range(1, K + 1)], axis=1).astype(np.int32) for x in (c, lower))
        rest = sums(np.where(lower > K, lower, 0))
        out: dict[str, list] = {k: [] for k in ("stretch", "bucket", "counts", "few", "low", "rest")}
        begin, hot_at = 0, [np.zeros(0, np.int64)]
        for r, x in zip(rows, times, strict=True):
            end = begin + int(x.sum())
            at = place[begin + np.cumsum(x) - x]
            cold = unpack(r["hot"], np.uint8) == 0
            hot_at.append(at[~cold])
            out["stretch"].append(r["stretch"])
            out["bucket"].append(r["bucket"])
            out["counts"].append(pack(each[begin:end]))
            for k, v in (("few", few), ("low", less), ("rest", rest)):
                out[k].append(pack(v[at].reshape(-1)))
            begin = end
        of_h = order[first][of]
        hot = [{"h": [int(x[of_h[i]]) for x in each_h], "few": few[i].tolist(), "low": less[i].tolist(), "rest": int(rest[i])} for i in np.unique(np.concatenate(hot_at))]
        for k in ("stretch", "counts", "few", "low", "rest"):
            out[k].append(None)
        out["bucket"].append(rows[0]["bucket"])
        put = {**out, "stats": [*([None] * len(rows)), _times(c)], "hot": [*([None] * len(rows)), hot]}
        longs = pa.list_(I64)
        return _table(put, stretch=I64, bucket=I32, stats=longs, hot=pa.list_(pa.struct([("h", longs), ("few", longs), ("low", longs), ("rest", I64)])))

    for level in range(2, order + 1):
        short = replies.select("of", "level", "bucket", "counts", "ids", *[none.alias(c) for c in ("few", "low", "rest")])
        asked = by.cogroup(short.groupBy("of")).applyInArrow(ask(level), "bucket int, stretch long, h array<binary>, times binary, hot binary, w binary, low binary, n binary")
        longs = "array<long>"
        grams = staged(asked.groupBy("bucket").applyInArrow(count, f"stretch long, bucket int, counts binary, few binary, low binary, rest binary, stats {longs}, hot array<struct<h:{longs},few:{longs},low:{longs},rest:long>>"), f"lm-grams-{level}")
        sums = grams.where("stats is not null").agg(*[F.sum(F.col("stats")[i]) for i in range(K + 1)]).first()  # one row
        discount.append(discounts([0, *[int(x or 0) for x in sums]]))
        x = grams.where("hot is not null").select(F.explode("hot").alias("x"))
        each = [F.sum(F.col(f"x.{c}")[i]).alias(f"{c}{i}") for c in ("few", "low") for i in range(K)]
        hot_rows = x.groupBy("x.h").agg(*each, F.sum("x.rest").alias("rest")).collect()  # at most HOT histories
        hot_of.append(spark.sparkContext.broadcast({tuple(r[0]): r[1:] for r in hot_rows}))
        replies = replies.unionByName(grams.where("counts is not null").select(F.col("stretch").alias("of"), F.lit(level).alias("level"), "bucket", "counts", none.alias("ids"), "few", "low", "rest"))

    def score(row: pa.Table, replies: pa.Table) -> pa.Table:
        s = Stretch(row.to_pylist()[0])
        s.open(replies, starts, total, bits)
        c1 = s.counts[:-1]
        lp = np.log10(uni.p(c1)) if total else np.zeros(len(c1))
        scale: np.ndarray = np.array([uni.scale])  # of a word's probability; below, of each history's followers
        tail = np.zeros(len(c1) + 1, np.int64)  # each history without its first word
        which = s.at
        for level in range(2, order + 1):
            d, below = discount[level - 1], discount[level - 2]
            g = s.deepen()
            _, _, hot = s.dealt()
            few, low, rest, c = np.zeros((len(s.counts), K)), np.zeros((len(s.counts), K)), np.zeros(len(s.counts)), np.empty(len(g.history), np.int64)
            for mine, r in s.answers(replies, level):
                c[mine] = unpack(r["counts"], np.int64)
                names = g.history[mine][np.flatnonzero(np.diff(g.history[mine], prepend=-1))]
                few[names], low[names] = (unpack(r[k], np.int32).reshape(-1, K) for k in ("few", "low"))
                rest[names] = unpack(r["rest"], np.int64)
            for i in np.flatnonzero(hot):
                x = hot_of[level - 2].value.get(tuple(int(k[i]) for k in s.keys), (0,) * (2 * K + 1))
                few[i], low[i], rest[i] = x[:K], x[K : 2 * K], x[2 * K]
            # backoff weights: what the discounts leave, over what the followers leave of the shorter history's distribution
            r = np.arange(1, K + 1)
            left = (few * (1 - d[1 : K + 1]) * r).sum(axis=1)
            own = np.where(left > 1e-9, np.maximum(s.counts, 1), s.counts + 1.0)
            left = np.where(left > 1e-9, left, 1.0) / own
            seen = ((low * below[1 : K + 1] * r).sum(axis=1) + rest) / scale[tail]
            log_a = np.where(s.counts > 0, np.log10(left / (1 - seen)), 0.0)
            lp = np.where(c > 0, np.log10(np.maximum(d[np.minimum(c, K + 1)] * c, 1e-300) / own[g.history]), log_a[g.history] + lp[g.tail])
            scale, tail, which = own, np.append(g.tail, len(s.counts) - 1), g.which
            s.take(c)
        base = np.log10((c1 + 1) / (total + types + 1))
        add = lambda v: np.add.reduceat(v, s.starts)
        return pa.table({
            "doc_id": pa.array(s.row["ids"], pa.int64()),
            "n_tokens": pa.array(s.lengths, pa.int64()),
            "n_known": pa.array(add((c1 > 0).astype(np.int64)[s.at]), pa.int64()),
            "train_tokens": pa.array(np.full(len(s.lengths), total), pa.int64()),
            "base_score": pa.array(add(base[s.at])),
            "score": pa.array(add(lp[which])),
        })

    return by.cogroup(replies.groupBy("of")).applyInArrow(score, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
