"""Scoring documents by masked pseudo-likelihood.

A small network in numpy predicts each word from the three before and the three after
it; the word itself is masked by construction. All words of all texts are counted
first, in a distributed table, the lexicon, which grows with the corpus. The most
frequent words are outputs of the network by themselves; any other word is in one of
GROUPS groups by its last letters, and the network predicts the group. A hidden layer
adds embeddings of these six, and two softmax layers give the class
of the output and its member within the class; their biases start from the counts, so
training starts from the words' own frequencies. Within a group a word's probability
is its share of the group's words (Witten-Bell: a share of types is left for words
that the corpus does not have, which are spelled byte by byte). A document's score is
the sum of its words' conditional log probabilities.

Words of groups that are common enough, KNOWN at most, travel to the tasks with the
network; all others are joined to the lexicon, where each occurs in few places, as it
would be known otherwise.

Training covers all texts; a hash of the text says in which round. In each round
every task trains its own copy of the network on its texts of the round, all copies start from the same
weights, and the next round starts from their mean, weighted by words. Copies are
averaged in slices of the weights, first among some tasks and then over all, so
no task and not the driver holds more than about the square root of their number.

Cases: a null or empty text has no words and a score of 0, with a null mean; short
texts see a mark for the edge in place of missing neighbours; repeated rows get
equal scores; an empty table trains nothing and gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import documents, keep
from .wordbytes import U64, Words, chunks, mix, trim

CLASSES, MEMBERS, WIDTH = 32, 64, 16
OUTPUTS = CLASSES * MEMBERS
#: Groups of words, the rest of the outputs being words, and words of groups that travel with the network.
GROUPS, KNOWN = 512, 1 << 18
FREQUENT = OUTPUTS - GROUPS
#: Places that the network sees; one embedding serves those before a word and another those after it.
PLACES = (-3, -2, -1, 1, 2, 3)
EDGE = OUTPUTS
SHAPES = {"sides": (2, OUTPUTS + 1, WIDTH), "hidden": (WIDTH,), "classes": (CLASSES, WIDTH), "class_bias": (CLASSES,), "members": (CLASSES, MEMBERS, WIDTH), "member_bias": (CLASSES, MEMBERS)}
SIZE = sum(math.prod(s) for s in SHAPES.values())
#: Weights in one slice that travels.
SLICE = 16384
#: Words of a step: few at first, more as a task goes on. Steps start from GAIN, as if gradients had been seen before.
LEAST_BATCH, BATCH, GROWTH, RATE, GAIN, ROUNDS = 512, 16384, 16, 0.3, 1e-5, 3
#: Bytes of text whose words a task counts at a time.
COUNTED = 8 << 20


class Network:
    """Views into one flat array of weights."""

    def __init__(self, weights: np.ndarray):
        self.flat, at = weights, 0
        for name, shape in SHAPES.items():
            setattr(self, name, weights[at : at + math.prod(shape)].reshape(shape))
            at += math.prod(shape)

    @staticmethod
    def start(mass: np.ndarray, seed: int = 3) -> np.ndarray:
        """mass: how often each output occurs."""
        net = Network(np.zeros(SIZE, np.float32))
        rng = np.random.default_rng(seed)
        for name in ("sides", "classes", "members"):
            getattr(net, name)[:] = rng.normal(0, 0.1, SHAPES[name])
        by = np.log((mass + 0.5).reshape(MEMBERS, CLASSES).T)
        net.class_bias[:] = np.log(np.exp(by).sum(axis=1) / np.exp(by).sum())
        net.member_bias[:] = by - by.mean(axis=1, keepdims=True)
        return net.flat

    def scores(self, around: np.ndarray, word: np.ndarray, grad: Network | None = None) -> np.ndarray:
        """Log probability of each output given the ones around it; adds the gradient of their sum to `grad`."""
        # words of one class stand together
        order = np.argsort((word % CLASSES).astype(np.int16), kind="stable")
        word, around = word[order], around[:, order]
        cls, member, rows = word % CLASSES, word // CLASSES, np.arange(len(word))
        z = self.hidden + self.sides[0][around[0]]
        for k in range(1, len(PLACES)):
            z += self.sides[int(PLACES[k] > 0)][around[k]]
        h = np.tanh(z)
        logits = h @ self.classes.T + self.class_bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        total = p.sum(axis=1, keepdims=True)
        found = logits[rows, cls] - np.log(total[:, 0])
        if grad is not None:
            p /= -total
            p[rows, cls] += 1
            grad.classes += p.T @ h
            grad.class_bias += p.sum(axis=0)
            back = p @ self.classes
        edges = np.searchsorted(cls, np.arange(CLASSES + 1))
        for c in np.flatnonzero(np.diff(edges)):
            at = slice(edges[c], edges[c + 1])
            own, some = h[at], rows[: edges[c + 1] - edges[c]]
            logits = own @ self.members[c].T + self.member_bias[c]
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            total = p.sum(axis=1, keepdims=True)
            found[at] += logits[some, member[at]] - np.log(total[:, 0])
            if grad is not None:
                p /= -total
                p[some, member[at]] += 1
                grad.members[c] += p.T @ own
                grad.member_bias[c] += p.sum(axis=0)
                back[at] += p @ self.members[c]
        if grad is not None:
            dz = back * (1 - h * h)
            grad.hidden += dz.sum(axis=0)
            half = len(PLACES) // 2
            for side in (0, 1):
                seen = around[half * side : half * (side + 1)].ravel()
                by = np.argsort(seen.astype(np.int16), kind="stable")
                heads = np.flatnonzero(np.diff(seen[by], prepend=-1))
                grad.sides[side][seen[by[heads]]] += np.add.reduceat(dz[by % len(word)], heads, axis=0)
        out = np.empty_like(found)
        out[order] = found
        return out


def groups_of(w: Words) -> np.ndarray:
    """The group of each word, by its last four bytes."""
    if not len(w.starts):
        return np.zeros(0, np.int64)
    tail = np.zeros(len(w.starts), U64)
    for k in range(1, 5):
        inside = w.ends - k >= w.starts
        tail = tail << U64(8) | np.where(inside, w.data[np.maximum(w.ends - k, 0)], 0).astype(U64)
    return (mix(tail) % U64(GROUPS)).astype(np.int64)


@dataclass(frozen=True)
class Vocabulary:
    """Words that every task knows, sorted by hash, their outputs and log probabilities within those; and words and types of each group that aren't outputs themselves."""

    hashes: np.ndarray
    outputs: np.ndarray
    within: np.ndarray
    words: np.ndarray
    types: np.ndarray

    def look_up(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(output, log probability within it, is that known?) of each word."""
        h = w.hashes
        outputs, within, known = FREQUENT + groups_of(w), np.zeros(len(h)), np.zeros(len(h), bool)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            known = self.hashes[at] == h
            outputs, within = np.where(known, self.outputs[at], outputs), np.where(known, self.within[at], 0.0)
        return outputs.astype(np.int32), within, known


@dataclass(frozen=True)
class Model:
    """weights of the network, what tasks know of the vocabulary, and `rest`: (hash, within) of all other words of the corpus."""

    weights: np.ndarray
    vocabulary: Vocabulary
    rest: DataFrame


def lexicon_of(texts: DataFrame) -> DataFrame:
    """(hash, grp, n) of each word of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, bounds in chunks(batch.column(0), COUNTED):
                w = Words(data, bounds)
                own, first, n = np.unique(w.hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(groups_of(w)[first].astype(np.int32)), pa.array(n)], ["hash", "grp", "n"])
        trim()

    return keep(texts.mapInArrow(count, "hash long, grp int, n long").groupBy("hash").agg(F.min("grp").alias("grp"), F.sum("n").alias("n")), "lexicon")


def vocabulary_of(lexicon: DataFrame) -> tuple[Vocabulary, np.ndarray, DataFrame]:
    """(vocabulary, how often each output occurs, the rest of the words). The driver gets FREQUENT + KNOWN words at most."""
    most = FREQUENT + KNOWN
    # the least count of words that all fit, to a part of an octave
    octave = F.floor(F.log2(F.col("n")) * 64).cast("int")
    sizes = sorted(lexicon.groupBy(octave.alias("o")).agg(F.count("*").alias("n")).collect(), reverse=True)
    least, held = None, 0
    for o, n in sizes:
        if held + n > most:
            break
        least, held = o, held + n
    common = octave >= F.lit(1 << 30 if least is None else least)
    told = lexicon.where(common).toArrow()
    hashes, grp, n = told.column("hash").to_numpy().view(U64), told.column("grp").to_numpy(), told.column("n").to_numpy()
    order = np.lexsort((hashes, -n))
    hashes, grp, n = hashes[order], grp[order], n[order]
    own = np.zeros(GROUPS), np.zeros(GROUPS)
    for r in lexicon.where(~common).groupBy("grp").agg(F.sum("n").alias("words"), F.count("*").alias("types")).collect():
        own[0][r["grp"]], own[1][r["grp"]] = r["words"], r["types"]
    tail = slice(FREQUENT, None)
    words = own[0] + np.bincount(grp[tail], n[tail], GROUPS)
    types = own[1] + np.bincount(grp[tail], minlength=GROUPS)
    outputs, within = np.arange(len(n)), np.zeros(len(n))
    outputs[tail] = FREQUENT + grp[tail]
    within[tail] = np.log(n[tail] / (words + types)[grp[tail]])
    mass = np.concatenate([n[:FREQUENT], np.zeros(max(0, FREQUENT - len(n))), words]).astype(float)
    by = np.argsort(hashes)
    total = F.element_at(F.array(*[F.lit(float(x)) for x in words + types]), F.col("grp") + 1)
    rest = lexicon.where(~common).select("hash", F.log(F.col("n") / total).alias("within"))
    return Vocabulary(hashes[by], outputs[by], within[by], words, types), mass, rest


def windows(ids: np.ndarray, w: Words) -> np.ndarray:
    """Outputs around each word."""
    reach = max(PLACES)
    padded = np.full(len(ids) + reach * len(w.bounds), EDGE, np.int32)
    place = np.arange(len(ids)) + reach * (w.text_of + 1)
    padded[place] = ids
    return np.stack([padded[place + k] for k in PLACES])


def train(weights: np.ndarray, vocabulary: Vocabulary):
    """Rows (task, slice, words, values) of a copy trained on the task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, gain, seen = Network(weights.copy()), np.full(SIZE, GAIN, np.float32), 0
        for batch in batches:
            for _, _, data, bounds in chunks(batch.column(0), 1 << 20):
                w = Words(data, bounds)
                ids = vocabulary.look_up(w)[0]
                around, at = windows(ids, w), 0
                while at < len(ids):
                    grad = Network(np.zeros(SIZE, np.float32))
                    some = slice(at, at + min(BATCH, max(LEAST_BATCH, seen // GROWTH)))
                    net.scores(around[:, some], ids[some], grad)
                    step = grad.flat / len(ids[some])
                    gain += step * step
                    net.flat += RATE * step / np.sqrt(gain)
                    at, seen = some.stop, seen + len(ids[some])
        if seen:
            parts = [net.flat[i : i + SLICE].tobytes() for i in range(0, SIZE, SLICE)]
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([task] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32()), pa.array([float(seen)] * len(parts)), pa.array(parts)], ["task", "slice", "words", "part"])
        trim()

    return run


def mean(group: pd.DataFrame) -> pd.DataFrame:
    total, words = np.zeros(len(group["part"].iloc[0]) // 4), 0.0
    for n, part in zip(group["words"], group["part"], strict=True):
        total += n * np.frombuffer(part, np.float32)
        words += n
    return pd.DataFrame({"task": [0], "slice": [group["slice"].iloc[0]], "words": [words], "part": [(total / words).astype(np.float32).tobytes()]})


KIND = "task int, slice int, words double, part binary"


def fit(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> Model:
    """A model trained on all texts; the driver gets one copy of the weights a round."""
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    vocabulary, mass, rest = vocabulary_of(lexicon_of(texts))
    weights = Network.start(mass)
    for turn in range(rounds):
        copies = texts.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == turn).mapInArrow(train(weights, vocabulary), KIND)
        salts = max(1, math.isqrt(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        some = copies.groupBy("slice", F.pmod(F.col("task"), F.lit(salts)).alias("salt")).applyInPandas(mean, KIND)
        parts = {r["slice"]: r["part"] for r in some.groupBy("slice").applyInPandas(mean, KIND).select("slice", "part").collect()}
        if parts:
            weights = np.frombuffer(b"".join(bytes(parts[k]) for k in sorted(parts)), np.float32).copy()
    return Model(weights, vocabulary, rest)


REST = "hash long, n int, unseen double"


def score(docs: DataFrame, model: Model, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_prob, mean_log_prob) of each row."""
    weights, vocabulary = model.weights, model.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, row = Network(weights), TaskContext.get().partitionId() << 33
        # what a word that the corpus doesn't have gets, before its bytes
        new = np.log(np.maximum(vocabulary.types, 1) / (vocabulary.words + np.maximum(vocabulary.types, 1)))
        for batch in batches:
            done = 0
            for lo, hi, data, bounds in chunks(batch.column(1), 1 << 20):
                w = Words(data, bounds)
                ids, within, known = vocabulary.look_up(w)
                around = windows(ids, w)
                each = np.concatenate([[0.0], *(net.scores(around[:, at : at + BATCH], ids[at : at + BATCH]) for at in range(0, len(ids), BATCH))])
                each[1:] += within
                sums = np.diff(np.cumsum(each)[w.first])
                # the other words of each text, once with their number
                at = np.flatnonzero(~known)
                doc, h = w.text_of[at], w.hashes[at]
                order = np.lexsort((h, doc))
                doc, h, at = doc[order], h[order], at[order]
                head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])) if len(at) else at
                n = np.diff(np.append(head, len(at)))
                at = at[head]
                unseen = new[ids[at] - FREQUENT] - math.log(256) * (w.ends - w.starts)[at]
                rest = pa.StructArray.from_arrays([pa.array(h[head].view(np.int64)), pa.array(n.astype(np.int32)), pa.array(unseen)], ["hash", "n", "unseen"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[head], np.arange(hi - lo + 1)).astype(np.int32)), rest)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(row + np.arange(hi - lo)), pa.array(np.diff(w.first)), pa.array(sums), lists], ["doc_id", "row", "n_tokens", "known", "rest"])
                row += hi - lo
                done = hi
            assert done == batch.num_rows
        trim()

    kind = docs.schema[id_].dataType.simpleString()
    base = docs.select(F.col(id_).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, row long, n_tokens long, known double, rest array<struct<{REST.replace(' ', ':').replace(',:', ',')}>>")
    base = keep(base, "known-scores")
    each = base.select("row", F.explode("rest").alias("x")).select("row", "x.*").join(model.rest, "hash", "left")
    added = each.groupBy("row").agg(F.sum(F.col("n") * F.coalesce("within", "unseen")).alias("added"))
    out = base.select("doc_id", "row", "n_tokens", "known").join(added, "row", "left")
    out = out.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("added", F.lit(0.0))).alias("log_prob"))
    return out.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: the score of every document under a network trained on all of them."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return score(docs, fit(docs))
