"""Removing passages that occur more than once, by super-k-mer partitioning.

A window is n consecutive words of one text. Its minimiser is the least of its
runs of m words, in an order of 64-bit hashes in which runs that are very
frequent in the corpus come last; neighbouring windows with the same minimiser
form a super-k-mer. Super-k-mers travel as packed strings to the bucket of their
minimiser: equal windows have equal minimisers, so one bucket sees all of them.
There windows are sorted by hash and equal neighbours compared word by word.

A task packs equal super-k-mers of its texts once, with their number. If there
is more than one (equal word by word), all their windows are repeats and are
reported at once; otherwise the one place travels along. A bucket thus gets no more than one copy
of a super-k-mer from each flush of a task, however often a passage occurs. The
frequent runs that come last number at most 2 * SHARE by construction. There is a
bucket for each WORDS words of the corpus, so a bucket doesn't grow with it.

Cases: a null or empty text has no words and no windows; texts shorter than a
window keep all words; windows never cross texts; repeated rows are copies of one
another, so all their windows are repeats (their spans are the same, and travel as
a set, so their number doesn't multiply); equal words are equal bytes; an empty
table gives no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import documents, keep
from .wordbytes import ROLL, U64, Words, chunks, mix, per_text, ragged, runs_hash, sliding_min, trim

WINDOW, RUN = 35, 4
#: A run of words is frequent from 1 / SHARE of all runs on.
SHARE = 50_000
#: Bytes of text that a task gathers before it sends its super-k-mers.
FLUSH = 6 << 20
#: Windows in one super-k-mer at most: longer ones go as several.
LONGEST = 4096
#: Words of the corpus for which there is a bucket.
WORDS = 2_000_000


def frequent_runs(docs: DataFrame, run: int = RUN, share: int = SHARE) -> tuple[np.ndarray, int]:
    """(sorted hashes of the frequent runs, 2 * share at most, number of all runs), from all texts. A text run in few places of many tasks may be missed: that is a matter of balance alone."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, bounds in chunks(batch.column(0), 4 << 20):
                w = Words(data, bounds)
                runs = runs_hash(w.hashes, run)
                if not len(runs):
                    continue
                doc = w.text_of
                runs = np.sort(runs[doc[: len(runs)] == doc[run - 1 :]])
                head = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]])) if len(runs) else np.zeros(0, np.int64)
                n = np.diff(np.append(head, len(runs)))
                some = n >= max(3, len(runs) / (2 * share))
                # the row without a hash has the number of all runs
                keys = pa.array(np.append(runs[head[some]], U64(0)).view(np.int64), mask=np.append(np.zeros(some.sum(), bool), True))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.append(n[some], len(runs)))], ["run", "n"])

    seen = keep(docs.select("text").mapInArrow(count, "run long, n long").groupBy("run").agg(F.sum("n").alias("n")).where("run is null or n >= 16"), "frequent-runs")
    total = seen.where("run is null").agg(F.sum("n")).first()[0] or 0
    rows = seen.where(F.col("run").isNotNull() & (F.col("n") >= max(16, total / (2 * share)))).select("run").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(U64)), int(total)


class Order:
    """The order of runs: frequent ones last."""

    def __init__(self, frequent: np.ndarray):
        self.frequent = frequent
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(frequent & U64(0xFFFFF)).astype(np.int64)] = True

    def __call__(self, runs: np.ndarray) -> np.ndarray:
        out = runs >> U64(1)
        at = np.flatnonzero(self.maybe[(runs & U64(0xFFFFF)).astype(np.int64)])
        if len(at):
            found = np.minimum(np.searchsorted(self.frequent, runs[at]), len(self.frequent) - 1)
            out[at[self.frequent[found] == runs[at]]] |= U64(1 << 63)
        return out


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ROLL ** k and its inverse modulo 2 ** 64, for k below n."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", ROLL), ("down", pow(ROLL, -1, 1 << 64))):
            x = np.full(n, base, U64)
            x[:1] = 1
            _POWERS[name] = np.cumprod(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def super_kmers(w: Words, order: Order, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimiser, hash of the words) of each super-k-mer."""
    h, doc, n = w.hashes, w.text_of, len(w.starts) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(U64), none.astype(U64)
    least = sliding_min(order(runs_hash(h, run)), window - run + 1)
    valid = doc[:n] == doc[window - 1 :]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    stop = np.zeros(n + 1, bool)
    stop[:n] = new | ~valid
    stop[n] = True
    first = np.flatnonzero(new)
    stops = np.flatnonzero(stop)
    length = stops[np.searchsorted(stops, first, "right")] - first
    parts = -(-length // LONGEST)
    nth = ragged(np.zeros(len(first), np.int64), parts)
    first, length = np.repeat(first, parts) + nth * LONGEST, np.minimum(LONGEST, np.repeat(length, parts) - nth * LONGEST)
    up, down = powers(len(h))
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(h * up)])
    words = mix((sums[first + length + window - 1] - sums[first]) * down[first]) ^ mix(length.astype(U64))
    return first, length, least[first], words


def packed(sizes: np.ndarray, number: np.ndarray, owner: np.ndarray, start: np.ndarray, text: bytes) -> bytes:
    head = np.stack([sizes, number, owner, start]).astype("<i4")
    return zstandard.ZstdCompressor(level=6).compress(np.array([len(sizes)], "<i8").tobytes() + head.tobytes() + text)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i4", 4 * n, 8).reshape(4, n)
    return *head, raw[8 + 16 * n :]


def alike(h: np.ndarray, first: np.ndarray, words: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place of each group, group of each place, size of each group) of equal sequences: h[first] to h[first + words - 1]. Equal keys propose, words decide."""
    _, one, back, number = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    other = np.flatnonzero(one[back] != np.arange(len(first)))
    if not len(other):
        return one, back, number
    rep = one[back[other]]
    wrong = words[other] != words[rep]
    size = np.where(wrong, 0, words[other])
    differs = h[ragged(first[other], size)] != h[ragged(first[rep], size)]
    wrong[np.repeat(np.arange(len(other)), size)[differs]] = True
    if wrong.any():  # different words, one key: a group for each sequence
        names: dict[tuple[int, bytes], int] = {}
        for i in other[wrong].tolist():
            name = int(back[i]), h[first[i] : first[i] + words[i]].tobytes()
            back[i] = names.setdefault(name, len(number) + len(names))
        _, one, back, number = np.unique(back, return_index=True, return_inverse=True, return_counts=True)
    return one, back, number


SENT = "bucket int, at_once boolean, docs binary, blob binary"


def sender(frequent: np.ndarray, buckets: int, window: int, run: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, held, size = Order(frequent), [], 0
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in (0, 1)])
            for lo, hi, data, bounds in chunks(batch.column(2), FLUSH):
                held.append((keys[:, lo:hi], data, bounds))
                size += len(data)
                if size >= FLUSH:
                    yield from flush(held, order)
                    held, size = [], 0
        if held:
            yield from flush(held, order)
        trim()

    def flush(held: list, order: Order) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([k for k, _, _ in held], axis=1)
        data = np.concatenate([d for _, d, _ in held])
        ends = np.cumsum([len(d) for _, d, _ in held])
        bounds = np.concatenate([[0], *(b[1:] + e - len(d) for (_, d, b), e in zip(held, ends, strict=True))])
        w = Words(data, bounds)
        first, length, least, words = super_kmers(w, order, window, run)
        if not len(first):
            return
        doc = w.text_of[first]
        begin = first - w.first[doc]
        one, back, number = alike(w.hashes, first, length + window - 1, words ^ mix(least))
        rows = []
        # several equal ones: all their windows are repeats
        again = np.flatnonzero(number[back] > 1)
        span = np.unique(np.stack([doc[again], begin[again], begin[again] + length[again]]), axis=1).astype("<i4")
        if span.shape[1]:
            bucket = (mix(keys[0].astype(U64) ^ mix(keys[1].astype(U64))) % U64(buckets)).astype(np.int64)[span[0]]
            by = np.argsort(bucket, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
                docs, owner = np.unique(span[0, part], return_inverse=True)
                rows.append((int(bucket[part[0]]), True, keys[:, docs].astype("<i8").tobytes(), zstandard.compress(np.stack([owner, span[1, part], span[2, part]]).astype("<i4").tobytes())))
        bucket = (mix(least[one]) % U64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        at, stop = w.starts[first[one]], w.ends[first[one] + length[one] + window - 2]
        for part in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
            single = number[part] == 1
            docs, owner = np.unique(doc[one[part]][single], return_inverse=True)
            owners = np.full(len(part), -1)
            owners[single] = owner
            text = data[ragged(at[part], stop[part] - at[part])].tobytes()
            rows.append((int(bucket[part[0]]), False, keys[:, docs].astype("<i8").tobytes(), packed(stop[part] - at[part], np.minimum(number[part], 2), owners, begin[one[part]], text)))
        for i in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows[i : i + 256], strict=True), (pa.int32(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], ["bucket", "at_once", "docs", "blob"])

    return send


def repeats(h: np.ndarray, at: np.ndarray, weight: np.ndarray, window: int) -> np.ndarray:
    """For each window (its words' hashes are h[at] and the next): does its word sequence occur twice or more, counted with weights?"""
    key = runs_hash(h, window)[at]
    by = np.argsort(key, kind="stable")
    same = key[by][1:] == key[by][:-1]
    a, b = at[by[1:][same]], at[by[:-1][same]]
    equal = np.ones(len(a), bool)
    for k in range(window):
        equal &= h[a + k] == h[b + k]
    out = np.zeros(len(at), bool)
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    if len(at):
        out[by] = np.repeat(np.add.reduceat(weight[by], head) > 1, np.diff(np.append(head, len(by))))
    if not equal.all():  # windows that differ share a hash: count those groups by their words
        odd = np.isin(key, key[by[1:][same]][~equal])
        total: dict[bytes, int] = {}
        names = {i: h[at[i] : at[i] + window].tobytes() for i in np.flatnonzero(odd)}
        for i, name in names.items():
            total[name] = total.get(name, 0) + int(weight[i])
        for i, name in names.items():
            out[i] = total[name] > 1
    return out


def counter(window: int):
    def count(group: pd.DataFrame) -> pd.DataFrame:
        sizes, number, owner, start, texts, keys, spans = [], [], [], [], [], [], []
        base = 0
        for at_once, docs, blob in zip(group["at_once"], group["docs"], group["blob"], strict=True):
            key = np.frombuffer(docs, "<i8").reshape(2, -1)
            if at_once:
                own, a, b = np.frombuffer(zstandard.decompress(blob), "<i4").reshape(3, -1)
                spans.append(np.stack([key[0, own], key[1, own], a, b + window - 1]))
                continue
            s, n, o, at, text = unpacked(blob)
            sizes.append(s)
            number.append(n)
            owner.append(np.where(o >= 0, o + base, -1))
            start.append(at)
            texts.append(text)
            keys.append(key)
            base += key.shape[1]
        if sizes:
            sizes, number, owner, start, keys = np.concatenate(sizes), np.concatenate(number), np.concatenate(owner), np.concatenate(start), np.concatenate(keys, axis=1)
            data = np.frombuffer(b"".join(texts), np.uint8)
            w = Words(data, np.concatenate([[0], np.cumsum(sizes)]))
            many = np.diff(w.first) - window + 1
            at, of = ragged(w.first[:-1], many), np.repeat(np.arange(len(sizes)), many)
            hit = repeats(w.hashes, at, number[of].astype(np.int64), window) & (owner[of] >= 0)
            at, of = at[hit], of[hit]
            if len(at):
                new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1])])
                head = np.flatnonzero(new)
                last = np.append(head[1:], len(at)) - 1
                which = of[head]
                a = start[which] + at[head] - w.first[which]
                spans.append(np.stack([keys[0, owner[which]], keys[1, owner[which]], a, a + at[last] - at[head] + window]))
        all_ = np.concatenate(spans, axis=1) if spans else np.zeros((4, 0), np.int64)
        out = pd.DataFrame({"k1": all_[0], "k2": all_[1], "a": all_[2].astype(np.int32), "b": all_[3].astype(np.int32)})
        trim()
        return out

    return count


def repeated_spans(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """docs: k1, k2 (a text's key, two longs), text. Returns k1, k2, a, b: words a to b - 1 are covered by repeated windows; spans may overlap."""
    spark = docs.sparkSession
    frequent, total = frequent_runs(docs, run)
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // WORDS)
    sent = docs.select("k1", "k2", "text").mapInArrow(sender(frequent, buckets, window, run), SENT)
    return sent.groupBy("bucket").applyInPandas(counter(window), "k1 long, k2 long, a int, b int")


def remover():
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(0), batch.column(1)
            lists = np.diff(np.frombuffer(spans.buffers()[1], np.int32)[spans.offset : spans.offset + len(spans) + 1])
            flat = spans.flatten()
            a, b = (flat.field(k).to_numpy() for k in (0, 1))
            done, out = 0, []
            lists = np.where(spans.is_valid().to_numpy(zero_copy_only=False), lists, 0)
            for lo, hi, data, bounds in chunks(texts):
                w = Words(data, bounds)
                many = lists[lo:hi]
                base = np.repeat(w.first[:-1], many)
                cover = np.zeros(len(w.starts) + 1, np.int64)
                np.add.at(cover, a[done : done + len(base)] + base, 1)
                np.add.at(cover, b[done : done + len(base)] + base, -1)
                done += len(base)
                kept = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
                doc, sizes = w.text_of[kept], w.ends[kept] - w.starts[kept]
                # each kept word and the byte after it, which becomes the space between words
                joined = np.append(data, np.uint8(32))[ragged(w.starts[kept], sizes + 1)]
                stops = np.cumsum(sizes + 1)
                joined[stops - 1] = 32
                n = per_text(doc, hi - lo)
                cut = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(n)])]
                raw = joined.tobytes()
                out.append((pa.array([raw[cut[i] : max(cut[i], cut[i + 1] - 1)].decode() for i in range(hi - lo)], pa.string()), np.diff(w.first), np.diff(w.first) - n))
            if out:
                rest = [batch.column(i) for i in range(2, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*rest, pa.concat_arrays([o[0] for o in out]), pa.array(np.concatenate([o[1] for o in out]).astype(np.int64)), pa.array(np.concatenate([o[2] for o in out]).astype(np.int64))], [*batch.schema.names[2:], "kept", "n_words", "n_removed"])
            del out
            trim()

    return remove


def remove_repeats(docs: DataFrame, id_: str = "doc_id", text: str = "text", window: int = WINDOW, run: int = RUN) -> DataFrame:
    """The columns of `docs` without the text, as a struct `row`, with `kept` (the words that no repeated window covers, joined by one space), `n_words` and `n_removed`.

    Spans find their text by the hashes of its id and of the text itself, so rows need not have different ids.
    """
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns if c != text] or [F.lit(0).alias("none")]).alias("row"), F.xxhash64(docs[id_]).alias("k1"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("k2"), F.coalesce(docs[text], F.lit("")).alias("text"))
    spans = repeated_spans(keyed, window, run).groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    joined = keyed.join(spans, ["k1", "k2"], "left").select("text", "spans", "row")
    row = keyed.schema["row"].dataType.simpleString()
    return joined.mapInArrow(remover(), f"row {row}, kept string, n_words long, n_removed long")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: what stays of every document."""
    out = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
