"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Each document becomes token ids and an end id; only a document longer than a
sequence is cut, into whole sequences after a first piece with the rest. How
many pieces there are of each length (2048 numbers at most, whatever the corpus)
is all that the packing decision needs: a bin is filled greedily with the longest
pieces that fit, then its smallest piece is exchanged for two unpacked ones that
fill the widened gap more tightly, and the finished bin is used as often as the
pieces last. Pieces are then numbered within their length, slice by slice, and
the number says which sequence and which place a piece gets.

Cases: a null or empty text is one piece that holds the end id alone; repeated
rows are documents of their own; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import on_line, small
from .storage import documents, keep
from .wordbytes import SPACE, Words, chunks, hash_spans, ragged, trim

LENGTH = 2048


class Encoder:
    """Ids as the tokenizer file gives them. Units (white space and the word after it) are encoded once and looked up after that: the vocabulary's pattern never joins characters across the end of a word.

    `ranks` holds the same vocabulary for the faster library; without it units go through the tokenizer. Texts with other white space or a special token go through the tokenizer whole.
    """

    most = 300_000  # units kept at a time

    def __init__(self, path: str, ranks: str | None, pattern: str | None):
        self.path, self.fast = path, None
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"].encode() for t in json.load(f)["added_tokens"]]
        if ranks and pattern:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
            self.bytes_of = np.zeros(max(table.values()) + 1, np.int64)
            for token, i in table.items():
                self.bytes_of[i] = len(token)
        self.clear()

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def clear(self) -> None:
        self.row: dict[int, int] = {}
        self.size = 0
        self.ids, self.at, self.n = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def text(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def _words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each unit's begin, how many they are) of units that end with a word."""
        sizes, bare = ends - starts, ~SPACE[data[starts]]
        stops = np.cumsum(sizes + bare)
        # a line feed keeps a unit without leading space apart from the one before
        joined = np.full(int(stops[-1]), 10, np.uint8)
        joined[ragged(stops - sizes, sizes)] = data[ragged(starts, sizes)]
        try:
            if self.fast is None:
                raise LookupError
            ids = np.array(self.fast.encode_ordinary(joined.tobytes().decode()), np.uint32)
        except BaseException as e:  # the library's panics are no Exception
            if isinstance(e, KeyboardInterrupt | SystemExit | MemoryError):
                raise
            return self._each([data[i:j].tobytes() for i, j in zip(starts, ends, strict=True)])
        cut = np.searchsorted(np.cumsum(self.bytes_of[ids]), stops) + 1
        begin = np.concatenate([[0], cut[:-1]]) + bare
        return ids, begin, cut - begin

    def _each(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = [self.text(u.decode()) for u in units]
        n = np.array([len(x) for x in got], np.int64)
        return np.concatenate(got), np.cumsum(n) - n, n

    def rows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, word_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all kept units, where each unit's begin, how many they are). word_ends: the unit ends with a word."""
        if len(self.row) > self.most:
            self.clear()
        seen, first, back = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        get = self.row.get
        rows = np.array([get(h, -1) for h in seen.tolist()], np.int64) if len(seen) else np.zeros(0, np.int64)
        new = np.flatnonzero(rows < 0)
        for some, words in ((new[word_ends[first[new]]], True), (new[~word_ends[first[new]]], False)):
            if not len(some):
                continue
            i, j = starts[first[some]], ends[first[some]]
            ids, begin, n = self._words(data, i, j) if words else self._each([data[x:y].tobytes() for x, y in zip(i, j, strict=True)])
            base = len(self.at)
            rows[some] = np.arange(base, base + len(some))
            self.row.update(zip(seen[some].tolist(), range(base, base + len(some)), strict=True))
            self.at = np.concatenate([self.at, begin + self.size])
            self.n = np.concatenate([self.n, n])
            self.ids = np.concatenate([self.ids, ids])
            self.size += len(ids)
        rows = rows[back]
        return self.ids, self.at[rows], self.n[rows]


def odd_space(data: np.ndarray) -> np.ndarray:
    """Bytes that begin white space or separators other than U+0009 to U+000D and the space."""
    a, b, c = data, np.append(data[1:], 0), np.append(data[2:], [0, 0])[: len(data)]
    some = ((c >= 0x80) & (c <= 0x8B)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)
    return ((a >= 0x1C) & (a <= 0x1F)) | ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & ((b == 0x9A) | (b == 0xA0))) | ((a == 0xE2) & (((b == 0x80) & some) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80)) | ((a == 0xEF) & (b == 0xBB))


@cache
def encoder(path: str, ranks: str | None, pattern: str | None) -> Encoder:
    return Encoder(path, ranks, pattern)


def encode(column: pa.Array, enc: Encoder) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each run of texts: the first one's row, all ids and where each text's ids begin (one more at the end)."""
    for lo, hi, data, bounds in chunks(column):
        w = Words(data, bounds)
        texts = w.text_of
        heads = np.concatenate([[0], w.ends[:-1]]) if len(w.ends) else w.starts
        begins = np.where(np.arange(len(w.starts)) == w.first[:-1][texts], bounds[:-1][texts], heads)
        last = np.where(np.diff(w.first) > 0, w.ends[w.first[1:] - 1] if len(w.ends) else 0, bounds[:-1])
        tail = np.flatnonzero(last < bounds[1:])
        starts, ends = np.concatenate([begins, last[tail]]), np.concatenate([w.ends, bounds[1:][tail]])
        owner, words = np.concatenate([texts, tail]), np.arange(len(starts)) < len(begins)
        order = np.lexsort((starts, owner))
        starts, ends, owner, words = starts[order], ends[order], owner[order], words[order]
        odd = np.diff(np.searchsorted(np.flatnonzero(odd_space(data)), bounds)) > 0
        raw = data.tobytes()
        for special in enc.special:
            at = raw.find(special)
            while at >= 0:
                odd[np.searchsorted(bounds, at, "right") - 1] = True
                at = raw.find(special, at + 1)
        plain = ~odd[owner]
        store, at, n = enc.rows(data, starts[plain], ends[plain], words[plain])
        per_text = np.bincount(owner[plain], weights=n, minlength=hi - lo).astype(np.int64)
        ids = store[ragged(at, n)]
        if odd.any():
            cut, parts = np.concatenate([[0], np.cumsum(per_text)]), []
            for i in range(hi - lo):
                parts.append(enc.text(raw[bounds[i] : bounds[i + 1]].decode()) if odd[i] else ids[cut[i] : cut[i + 1]])
            per_text, ids = np.array([len(p) for p in parts]), np.concatenate(parts)
        yield lo, ids, np.concatenate([[0], np.cumsum(per_text)])


def pieces(docs: DataFrame, path: str, ranks: str | None = None, pattern: str | None = None, length: int = LENGTH, end: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of docs (doc_id, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, ranks, pattern)
        for batch in batches:
            for lo, ids, at in encode(batch.column(1), enc):
                rows = {k: [] for k in ("doc", "piece", "start", "length", "crc", "ids")}
                for i in range(len(at) - 1):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(end)).astype("<u4")
                    begin = 0
                    for piece in range(-(-len(own) // length)):
                        stop = begin + ((len(own) - begin - 1) % length + 1)
                        rows["doc"].append(lo + i)
                        rows["piece"].append(piece)
                        rows["start"].append(begin)
                        rows["length"].append(stop - begin)
                        rows["crc"].append(zlib.crc32(own[begin:stop]))
                        if with_ids:
                            rows["ids"].append(own[begin:stop].astype(np.int32))
                        begin = stop
                arrays = [batch.column(0).take(pa.array(rows["doc"], pa.int64())), pa.array(rows["piece"], pa.int32()), *(pa.array(rows[k], pa.int64()) for k in ("start", "length", "crc"))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(rows["ids"], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)
        enc.clear()
        trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_two_fit(counts: dict[int, int], length: int = LENGTH) -> list[tuple[dict[int, int], int]]:
    """Bins as (how often each length occurs in it, how many such bins), given how many pieces there are of each length."""
    left = np.zeros(length + 1, np.int64)
    for k, n in counts.items():
        left[k] = n
    out = []
    while left.any():
        held: dict[int, int] = {}
        gap, free = length, left.copy()

        def put(k: int, held=held, free=free) -> None:
            held[k] = held.get(k, 0) + 1
            free[k] -= 1

        while gap and len(fit := np.flatnonzero(free[: gap + 1])):
            # as many of one length as fit and are there
            k = int(fit[-1])
            for _ in range(min(gap // k, int(free[k]))):
                put(k)
                gap -= k
        while gap:
            least = min(held)
            room = least + gap
            there = np.flatnonzero(free[: room + 1])
            mate = np.searchsorted(there, np.minimum(room - there, there), "right") - 1
            some = mate >= 0
            big, small_ = there[some], there[mate[some]]
            alone = (big == small_) & (free[big] < 2)
            if alone.any():
                lower = mate[some][alone] - 1
                small_ = small_.copy()
                small_[alone] = np.where(lower >= 0, there[lower], -length)
            total = big + small_
            if not len(total) or (best := int(total.argmax())) < 0 or total[best] <= least:
                break
            held[least] -= 1
            free[least] += 1
            if not held[least]:
                del held[least]
            put(int(big[best]))
            put(int(small_[best]))
            gap = room - int(total[best])
        times = min(int(left[k]) // n for k, n in held.items())
        for k, n in held.items():
            left[k] -= n * times
        out.append((held, times))
    return out


def pack(parts: DataFrame, length: int = LENGTH, seed: int = 11) -> DataFrame:
    """`parts` (any columns and `length`, of pieces that a sequence can hold) with `sequence_id` and `offset`. `parts` is read twice: it should be a written table."""
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used, sequence = dict.fromkeys(counts, 0), 0
    for held, times in best_two_fit(counts, length):
        offset = 0
        for k in sorted(held, reverse=True):
            runs.setdefault(k, []).append((used[k], held[k], sequence, offset))
            used[k] += held[k] * times
            offset += k * held[k]
        sequence += times
    table = {k: np.array(v, np.int64).T for k, v in runs.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for k in np.unique(size):
                rows = np.flatnonzero(size == k)
                lo, many, first, begin = table[int(k)]
                run = np.searchsorted(lo, rank[rows], "right") - 1
                nth = rank[rows] - lo[run]
                seq[rows], off[rows] = first[run] + nth // many[run], begin[run] + nth % many[run] * k
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seq), pa.array(off)], ["id", "sequence_id", "offset"])

    of = parts.sparkSession.createDataFrame([(k, n, n) for k, n in counts.items()], "of long, docs long, whole long")
    line = on_line(parts.select(F.struct(*parts.columns).alias("id"), F.col("length").alias("sources"), F.lit(1).alias("size")), small(of, len(counts)), seed)
    kind = line.schema["id"].dataType.simpleString()
    out = line.select("id", F.col("sources").alias("length"), "before").mapInArrow(place, f"id {kind}, sequence_id long, offset long")
    return out.select("id.*", "sequence_id", "offset")


def paths() -> dict[str, str]:
    """The installed vocabulary that the registered query uses, for `pieces`."""
    import public_tokenizers as p

    return {"path": p.path("byte_bpe_50k.json"), "ranks": p.path("byte_bpe_50k.tiktoken"), "pattern": p.PATTERN}


def placements(docs: DataFrame) -> DataFrame:
    """Where each piece of each document goes."""
    return pack(keep(pieces(docs, **paths()), "pieces"))


def sequences(docs: DataFrame, length: int = LENGTH, **vocabulary) -> DataFrame:
    """(sequence_id, ids, doc_ids) of the packed sequences themselves."""
    parts = keep(pieces(docs, length=length, with_ids=True, **vocabulary), "pieces")
    placed = pack(parts, length)
    return placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: a row for each piece of every document."""
    return placements(documents(spark, sf_dir)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
