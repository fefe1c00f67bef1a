"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

Words fall into ``CLASSES`` classes: the end of a text, the most frequent words each by itself, and the rest by a hash of their last
letters. The probability of a word after its history is

    P(class | history) * P(share | class, history) * P(word | class, share)

The first factor is a softmax whose features are hashed: the word before (n-gram), the classes of the two words before (n-gram), and the classes of the words
two and three back (skip). The second is a softmax over the ``SHARES`` shares into which a hash deals the words of an ending, with hashed features of its own,
each together with the class: the word before, the classes of the two words before (n-grams), and the word two back (skip). Weights are trained by gradient
updates: training texts are dealt by key and text to trainers, each of which runs AdaGrad mini-batches over its texts, in order of key, from the common weights. The
trainers' updates are averaged by a tree, weighted by how often each feature was seen. A trainer gets ``TRAINER_SHARE`` bytes of text for each byte of the weights, so
that what all of them send grows with the text, and neither files nor partitions of the input change a score. The third factor is a smoothed unigram within the
share. All are proper distributions, an unseen word of a share having one part.

Counts cover the whole corpus. Documents are dealt into blocks by key and text; a block lists its distinct words with their training counts, a window function over
the word hashes adds up, and each block gets back the counts of its own words by place in its list. The frequent words are those of the largest exact counts. The
vocabulary is never in one place. What the driver holds: weights (``CLASSES`` for each row of a feature; the rows of the word feature grow with the root of the
training tokens, as a vocabulary does), class totals and the frequent words. Rows alike in key and text share a block and a trainer.

Defined cases: a null text is empty and has its end only. A null key counts as the text ''. With no training document every word is unknown; the class model is then uniform. Repeated rows
count and are scored each by itself. An empty table gives an empty table. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillbar.llm.frames import BLOCK_BYTES, settled, width
from quillbar.llm.words import U64, Texts, mix, signed, slices

CLASSES = 64
FREQUENT = 31
ENDINGS = CLASSES - 1 - FREQUENT
SHARES = CLASSES
KINDS = FREQUENT + 1 + ENDINGS * SHARES
WORD_KINDS = ENDINGS * SHARES
PAIRS = CLASSES * CLASSES
BUCKETS = 4096
FEATURES = 2 * PAIRS + BUCKETS
BATCH = 8192
RATE = 0.3
ROUNDS = 1
SMOOTH = 0.1
RUN = 8192
TRAINER_SHARE = 4
SLICE = 1 << 20
"""Batches end with a slice of about this many bytes of text, so it is part of the model."""
FAN = 8
TURNS = 64
STRIP = 512
"""Weights change so many rows at a time, which stay in a core's cache."""
_LOWER = np.arange(256)
_LOWER[65:91] += 32


def buckets_for(tokens: float) -> int:
    """The rows of the word feature: as many as the root of the training tokens, as a vocabulary grows, and a power of two."""
    return max(BUCKETS, 1 << math.ceil(math.log2(max(tokens, 1)) / 2))


def held_out(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def share_of(hashes: np.ndarray) -> np.ndarray:
    """A number below SHARES for each word."""
    return (mix(hashes ^ U64(0x2545F4914F6CDD1D)) % U64(SHARES)).astype(np.int64)


class Stream:
    """The tokens of consecutive texts: their words and an end after each."""

    def __init__(self, texts: Texts, frequent: np.ndarray, hashes: np.ndarray | None = None):
        n = len(texts.offsets) - 1
        hashes = texts.hashes(lower=True) if hashes is None else hashes
        words = FREQUENT + 1 + endings(texts)
        if len(frequent):
            place = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
            words = np.where(frequent[place] == hashes, place + 1, words)
        ends = texts.first[1:] + np.arange(n)
        self.is_end = np.zeros(len(hashes) + n, dtype=bool)
        self.is_end[ends] = True
        self.hash = np.zeros(len(self.is_end), dtype=U64)
        self.hash[~self.is_end] = hashes
        self.cls = np.zeros(len(self.is_end), dtype=np.int64)
        self.cls[~self.is_end] = words
        self.share = np.zeros(len(self.is_end), dtype=np.int64)
        self.share[~self.is_end] = share_of(hashes)
        # the end and the frequent words are the whole of their class
        self.shared = self.cls > FREQUENT
        self.kind = np.where(self.shared, FREQUENT + 1 + (self.cls - FREQUENT - 1) * SHARES + self.share, self.cls)
        self.count = texts.count + 1
        self.first = np.append(0, np.cumsum(self.count))
        self.doc = np.repeat(np.arange(n), self.count)
        self.at = np.arange(len(self.doc)) - self.first[:-1][self.doc]

    def back(self, values: np.ndarray, steps: int) -> np.ndarray:
        """The values ``steps`` tokens before in the same text; 0 before its start."""
        out = np.zeros_like(values)
        out[steps:] = values[:-steps] if len(values) > steps else values[:0]
        out[self.at < steps] = 0
        return out

    def features(self, buckets: int = BUCKETS) -> np.ndarray:
        one, two, three = (self.back(self.cls, k) for k in (1, 2, 3))
        word = (mix(self.back(self.hash, 1) ^ U64(0x5DEECE66D)) >> U64(65 - buckets.bit_length())).astype(np.int64)
        return np.stack([2 * PAIRS + word, one * CLASSES + two, PAIRS + two * CLASSES + three]).astype(np.int32)

    def share_features(self, buckets: int, take: np.ndarray) -> np.ndarray:
        """The features of the share of the tokens ``take``, all of them of an ending."""
        own = self.cls[take] - FREQUENT - 1
        one, two = (self.back(self.cls, k)[take] for k in (1, 2))
        base = 2 * PAIRS + buckets
        out = [base + own]
        for k, past in enumerate((self.back(self.hash, 1)[take], (one * CLASSES + two).astype(U64), self.back(self.hash, 2)[take])):
            place = mix(mix(past ^ U64(0x5DEECE66D + k)) + own.astype(U64)) >> U64(65 - buckets.bit_length())
            out.append(base + ENDINGS + k * buckets + place.astype(np.int64))
        return np.stack(out).astype(np.int32)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums by text, each over its own tokens alone: every text has its end."""
        return np.add.reduceat(values.astype(float), self.first[:-1]) if len(self.doc) else np.zeros(0)


def endings(texts: Texts) -> np.ndarray:
    """A number below ENDINGS from the last three bytes of each word in lower case."""
    if not len(texts.start):
        return np.zeros(0, dtype=np.int64)
    out = np.zeros(len(texts.start), dtype=np.int64)
    for k in range(1, 4):
        at = texts.end - k
        out = out * 257 + np.where(at >= texts.start, _LOWER[texts.data.take(at, mode="clip")] + 1, 0)
    return (mix(out.view(U64)) % U64(ENDINGS)).astype(np.int64)


def exponents(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    """What the probabilities of each token are proportional to, 1 at most."""
    # places are in range; 'clip' only spares a checked copy
    logits = weights.take(features[0], axis=0, mode="clip")
    part = np.empty_like(logits)
    for f in features[1:]:
        logits += weights.take(f, axis=0, mode="clip", out=part)
    logits -= logits.max(axis=1, keepdims=True)
    return np.exp(logits, out=logits)


def probabilities(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    out = exponents(weights, features)
    out /= out.sum(axis=1, keepdims=True)
    return out


def sums_by_feature(feature: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct features, how often each occurs, and the sums of its rows of ``values``, in their order and in double precision.

    The first rows of all features are taken at once, then their second rows and so on; a feature of more than ``TURNS`` rows is summed by itself.
    """
    low = feature.min()
    place = feature - low
    # 16-bit numbers are sorted by counting
    order = np.argsort(place.astype(np.uint16) if place.max() < 1 << 16 else place, kind="stable")
    place = place[order]
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    count = np.diff(first, append=len(place))
    often = np.argsort(-count, kind="stable")
    first, count = first[often], count[often]
    sums = values.take(order[first], axis=0, mode="clip").astype(np.float64)
    more = np.searchsorted(-count, -np.arange(TURNS + 1))  # features of more than 0, 1, 2, ... rows
    many = more[TURNS]
    for i in range(many):
        sums[i] = values.take(order[first[i]:first[i] + count[i]], axis=0, mode="clip").sum(axis=0, dtype=np.float64)
    for turn in range(1, TURNS):
        if more[turn] <= many:
            break
        sums[many:more[turn]] += values.take(order[first[many:more[turn]] + turn], axis=0, mode="clip")
    return place[first].astype(np.int64) + low, count, sums


class Trainer:
    """AdaGrad from the common weights; remembers how often each feature was seen."""

    def __init__(self, weights: np.ndarray):
        self.start = weights
        self.weights = weights.copy()
        self.squares = np.full(weights.shape, 1e-2, dtype=np.float32)
        self.seen = np.zeros(len(weights), dtype=np.float32)

    def learn(self, features: np.ndarray, cls: np.ndarray) -> None:
        n = len(cls)
        error = probabilities(self.weights, features)
        error[np.arange(n), cls] -= 1
        for f in features:
            rows, count, sums = sums_by_feature(f, error)
            for at in range(0, len(rows), STRIP):
                some, step = rows[at:at + STRIP], sums[at:at + STRIP].astype(np.float32)
                # sums of a batch grow with the feature's tokens; their noise with the root
                step /= np.sqrt(count[at:at + STRIP], dtype=np.float32)[:, None]
                squares = self.squares.take(some, axis=0, mode="clip")
                squares += step * step
                self.squares[some] = squares
                step /= np.sqrt(squares, out=squares)
                step *= RATE
                weights = self.weights.take(some, axis=0, mode="clip", out=squares)
                weights -= step
                self.weights[some] = weights
            self.seen[rows] += count


def totals_of(counted: DataFrame, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The frequent words (hashes, sorted), the training tokens of each class and of each share of an ending, and the distinct training words of
    each share, the frequent ones left out of their shares."""
    once = counted.where((F.col("role") % 2 == 1) & (F.col("total") > 0)).withColumn("kind", F.col("place") % WORD_KINDS)
    top = once.orderBy(F.desc("total"), "word").select("word", "total", "kind").limit(FREQUENT).collect()
    chosen = sorted(top, key=lambda r: r["word"] % 2**64)
    tokens, shares, words = np.zeros(CLASSES), np.zeros(WORD_KINDS), np.zeros(WORD_KINDS)
    for r in once.groupBy("kind").agg(F.count(F.lit(1)).alias("words"), F.sum("total").alias("tokens")).collect():
        shares[r["kind"]], words[r["kind"]] = r["tokens"], r["words"]
    tokens[0] = texts
    for i, r in enumerate(chosen):
        tokens[i + 1] = r["total"]
        shares[r["kind"]] -= r["total"]
        words[r["kind"]] -= 1
    tokens[FREQUENT + 1:] = shares.reshape(ENDINGS, SHARES).sum(axis=1)
    return np.array([r["word"] % 2**64 for r in chosen], dtype=U64), tokens, shares.reshape(ENDINGS, SHARES), words


def start(tokens: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Weights that give each class and each share of a class as often as it is seen at all."""
    buckets = buckets_for(tokens.sum())
    weights = np.zeros((2 * PAIRS + ENDINGS + 4 * buckets, CLASSES), dtype=np.float32)
    weights[2 * PAIRS:2 * PAIRS + buckets] = np.log((tokens + 1) / (tokens + 1).sum())
    weights[2 * PAIRS + buckets:][:ENDINGS] = np.log((shares + 1) / (shares + 1).sum(axis=1, keepdims=True))
    return weights


def buckets_of(weights: np.ndarray) -> int:
    return (len(weights) - 2 * PAIRS - ENDINGS) // 4


def trained(rows: DataFrame, text_bytes: int, frequent: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weights after one pass of gradient updates over all training texts of ``rows`` (``key, text, held``)."""
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(weights)
    buckets = buckets_of(weights)
    trainers = max(1, math.ceil(text_bytes / (TRAINER_SHARE * weights.nbytes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        trainer = Trainer(shared.value)
        for batch in batches:
            number = batch.column(1)[0].as_py() if len(batch) else number
            for _, _, texts in slices(batch.column(0), SLICE):
                stream = Stream(texts, frequent)
                features = stream.features(buckets)
                for at in range(0, len(stream.cls), BATCH):
                    trainer.learn(features[:, at:at + BATCH], stream.cls[at:at + BATCH])
                take = np.flatnonzero(stream.shared)
                features = stream.share_features(buckets, take)
                for at in range(0, len(take), BATCH):
                    trainer.learn(features[:, at:at + BATCH], stream.share[take[at:at + BATCH]])
        if trainer.seen.any():
            moved = (trainer.weights - trainer.start) * trainer.seen[:, None]
            flat = np.concatenate([trainer.seen, moved.ravel()])
            padded = np.zeros(-(-len(flat) // RUN) * RUN, dtype=np.float32)
            padded[:len(flat)] = flat
            padded = padded.reshape(-1, RUN)
            used = np.flatnonzero(padded.any(axis=1))
            # a few at a time: what is summed up is read in small batches, too
            for some in np.split(used, range(64, len(used), 64)):
                parts = pa.FixedSizeListArray.from_arrays(pa.array(padded[some].ravel()), RUN).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), number, dtype=np.int32)), parts],
                                                 names=["part", "trainer", "v"])

    def add(table: pa.Table) -> pa.Table:
        # in the order of the trainers, so that sums repeat to the last bit
        table = table.sort_by("trainer")
        total = table["v"].combine_chunks().flatten().to_numpy().reshape(-1, RUN).sum(axis=0, dtype=np.float64)
        return pa.table({"part": table["part"][:1], "trainer": table["trainer"][:1], "v": pa.array([total.astype(np.float32)], pa.list_(pa.float32()))})

    schema = "part int, trainer int, v array<float>"
    trainer = F.pmod(F.xxhash64(F.lit("trainer"), "key", "text"), F.lit(trainers)).cast("int")
    dealt = rows.where("not held").select("key", "text", trainer.alias("trainer")).repartitionById(trainers, "trainer")
    updates = dealt.sortWithinPartitions("key", "text").select("text", "trainer").mapInArrow(run, schema)
    while trainers > FAN:
        trainers = math.ceil(trainers / FAN)
        updates = updates.withColumn("trainer", F.floor(F.col("trainer") / FAN).cast("int")).groupBy("part", "trainer").applyInArrow(add, schema)
    size = len(weights) + weights.size
    flat = np.zeros(-(-size // RUN) * RUN, dtype=np.float32)
    found = updates.groupBy("part").applyInArrow(add, schema).toArrow()
    for part, values in zip(found["part"].to_pylist(), found["v"]):
        flat[part * RUN:(part + 1) * RUN] = values.values.to_numpy()
    shared.unpersist()
    seen, moved = flat[:len(weights)], flat[len(weights):size].reshape(weights.shape)
    return weights + moved / np.maximum(seen, 1)[:, None]


def _distinct(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct words of a block in order of hash, their training counts and kinds (ending, and share of it), and for each slice of the texts
    the place of every word in the list."""
    hashes, kinds, train, places = [], [], [], []
    held = table["held"].to_numpy(zero_copy_only=False).astype(bool)
    for low, high, texts in slices(table["text"], SLICE):
        named, sample, inverse = np.unique(texts.hashes(lower=True), return_index=True, return_inverse=True)
        hashes.append(named)
        kinds.append(endings(texts)[sample] * SHARES + share_of(named))
        train.append(np.bincount(inverse, weights=~held[low:high][texts.doc], minlength=len(named)).astype(np.int64))
        places.append(inverse.astype(np.int32))
    if not hashes:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
    named, sample, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    counts = np.bincount(inverse, weights=np.concatenate(train), minlength=len(named)).astype(np.int64)
    own = np.split(inverse, np.cumsum([len(h) for h in hashes])[:-1])
    return named, counts, np.concatenate(kinds)[sample], [to[place] for to, place in zip(own, places)]


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score``, logarithms to base 10."""
    def listed(group: tuple, table: pa.Table) -> pa.Table:
        hashes, counts, kinds, _ = _distinct(table)
        return pa.table({"word": signed(hashes), "block": pa.array(np.full(len(hashes), group[0].as_py(), dtype=np.int32)),
                         "place": np.arange(len(hashes)) * WORD_KINDS + kinds, "n": counts})

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), held_out(key).alias("held"))
    trains = (~F.col("held")).cast("long")
    size = rows.agg(F.coalesce(F.sum(trains), F.lit(0)).alias("texts"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"),
                    F.coalesce(F.sum(trains * F.octet_length("text")), F.lit(0)).alias("train_bytes")).first()
    blocks = max(math.ceil(size["bytes"] / block_bytes), width(docs.sparkSession))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("key", "text"), F.lit(blocks)).cast("int"))
    by_word = Window.partitionBy("word")
    # role: 1 for the first block that lists the word, and 2 more where other blocks have it in training texts, too
    role = (F.col("block") == F.col("head")).cast("int") + 2 * (F.col("total") > F.col("n")).cast("int")
    counted = settled(dealt.groupBy("block").applyInArrow(listed, "word long, block int, place long, n long").withColumns(
        {"total": F.sum("n").over(by_word), "head": F.min("block").over(by_word)}).select("word", "block", "place", "total", role.alias("role")))
    texts = int(size["texts"])
    frequent, tokens, shares, words = totals_of(counted, texts)
    weights = start(tokens, shares)
    if texts:
        for _ in range(rounds):
            weights = trained(rows, size["train_bytes"], frequent, weights).astype(np.float32)
    train_tokens = int(tokens.sum())
    distinct = (texts > 0) + len(frequent) + int(words.sum())
    whole = math.log10(train_tokens + SMOOTH * (distinct + 1))
    end = math.log10(texts + SMOOTH)
    off = np.zeros(KINDS)
    off[FREQUENT + 1:] = np.log10(shares.ravel() + SMOOTH * (words + 1))
    known_end = int(texts > 0)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def chances(model: np.ndarray, features: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        out = np.empty(len(wanted), dtype=np.float32)
        for at in range(0, len(out), BATCH):
            part = slice(at, at + BATCH)
            each = exponents(model, features[:, part])
            out[part] = each[np.arange(len(each)), wanted[part]] / each.sum(axis=1)
        return np.log10(np.maximum(out, 1e-30).astype(np.float64))

    def score(group: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        named, counts, _, places = _distinct(table)
        counts[replies["place"].to_numpy() // WORD_KINDS] = replies["total"].to_numpy()
        model = shared.value
        buckets = buckets_of(model)
        out = {name: [np.zeros(0, kind)] for name, kind in (("n_tokens", np.int64), ("n_known", np.int64), ("base_score", float), ("score", float))}
        for place, (_, _, part) in zip(places, slices(table["text"], SLICE)):
            stream = Stream(part, frequent, named[place])
            c = np.zeros(len(stream.hash), dtype=np.int64)
            words = ~stream.is_end
            c[words] = counts[place]
            logs = np.full(len(c), end)
            logs[words] = np.log10(c[words] + SMOOTH)
            model_logs = chances(model, stream.features(buckets), stream.cls)
            take = np.flatnonzero(stream.shared)
            model_logs[take] += chances(model, stream.share_features(buckets, take), stream.share[take]) + logs[take] - off[stream.kind[take]]
            out["n_tokens"].append(stream.count)
            out["n_known"].append(stream.sums(c > 0).astype(np.int64) + known_end)
            out["base_score"].append(stream.sums(logs) - stream.count * whole)
            out["score"].append(stream.sums(model_logs))
        done = {name: np.concatenate(parts) for name, parts in out.items()}
        return pa.table({"key": table["key"], "held_out": table["held"], "n_tokens": done["n_tokens"], "n_known": done["n_known"],
                         "train_tokens": np.full(len(table), train_tokens, dtype=np.int64), "base_score": done["base_score"], "score": done["score"]})

    schema = "key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    replies = counted.where("role >= 2").select("block", "place", "total")
    return dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, schema)
