"""Near copies by Order MinHash and banded alignment.

Texts are sequences of overlapping runs of five words, each labelled with how
often it occurred before in the text. A band hashes all labelled runs with its
own function, takes the LEAST smallest and keeps them in text order: texts agree
on a band with a probability that follows their edit similarity, not only their
sets. Texts of fewer than SHORT words, where one other word spoils most runs, have
as many bands again of one run each. Every text of a bucket is a candidate to the
bucket's leader (its least key), so a bucket gives no more candidates than it has
texts. Candidates are verified where the leader and its followers meet, by
alignment of their words: two texts of a and b words are similar if e edits (words
put in, left out or replaced) make one the other and 1 - e / max(a, b) >= SIMILAR;
e is found in a band of diagonals, which widens up to what the similarity allows.
Followers that don't match the leader are compared with one another where they
share a band. A leader with many followers meets them in several shares; if some of
those don't match it, all of its followers are joined again by their rarest pairs of
neighbouring words: in any one order of all pairs, similar texts have one in common
among their first two fifths (a proof, not a probability), and with frequent pairs
last, texts that share no more than a template meet nowhere. Leaders of those buckets
that still part classes in several shares have them compared share against share. So every pair of
texts that agree on a band is compared, or in one class already.

Exact copies are one text from the start. Links become classes by alternating
large-star and small-star steps over joins. Keys that hold many rows (a text with
very many copies, the centre of a large class) are found by their counts, at most
storage.HOT of them, and their side is broadcast, so their rows stay where they are.

Cases: a null text counts as empty; all texts without words, equal byte for
byte, are copies of one another; a text of fewer than five words is one run;
ties between leaders cannot occur among different texts; repeated rows fall in
one class; an empty table gives no rows; a null id is less than no other, so a
class has a null id only if all its ids are null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .storage import by_key, discard, documents, free_name, keep
from .wordbytes import U64, Words, chunks, mix, ragged, runs_hash, trim

SHINGLE, BANDS, LEAST, SIMILAR = 5, 40, 3, 0.8
#: Texts of fewer words have bands of one run, too.
SHORT = 40
#: Followers of a leader that meet in one place.
SHARE = 200
#: Words that stand together in the second join, slots in which such runs are counted, slots that are added up in one place, and shares in which they are first.
PAIR, SLOTS, SLICE, SALTS = 2, 1 << 16, 1 << 13, 8


def labelled(w: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the labelled runs of n words, where each text's begin and one more at the end). A shorter text with words is one run."""
    words = np.diff(w.first)
    many = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    at = np.concatenate([[0], np.cumsum(many)])
    doc = np.repeat(np.arange(len(words)), many)
    keys = np.zeros(at[-1], U64)
    full = words[doc] >= n
    place = ragged(w.first[:-1], many)
    if full.any():
        keys[full] = runs_hash(w.hashes, n)[place[full]]
    for d in np.flatnonzero((words > 0) & (words < n)):
        keys[at[d]] = runs_hash(w.hashes[w.first[d] : w.first[d + 1]], int(words[d]))[0] ^ U64(int(words[d]))
    own = mix(keys ^ mix(doc.astype(U64) + U64(1)))
    order = np.argsort(own, kind="stable")
    new = np.concatenate([[True], own[order][1:] != own[order][:-1]]) if len(own) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    nth = np.zeros(len(own), np.int64)
    nth[order] = np.arange(len(own)) - np.repeat(head, np.diff(np.append(head, len(own))))
    return mix(keys + nth.astype(U64) * U64(0x9E3779B97F4A7C15)), at


def sketch(keys: np.ndarray, bands: int, least: int, seed: int = 20) -> np.ndarray:
    """A number for each band: the band's `least` smallest keys, hashed in text order."""
    rng = np.random.default_rng(seed)
    flip, odd = rng.integers(0, 2**64, bands, U64), rng.integers(0, 2**64, bands, U64) | U64(1)
    least = min(least, len(keys))
    if len(keys) > 20_000:
        at = np.stack([np.argpartition((keys ^ f) * o, least - 1)[:least] for f, o in zip(flip, odd, strict=True)])
    else:
        at = np.argpartition((keys[None] ^ flip[:, None]) * odd[:, None], least - 1, axis=1)[:, :least]
    at.sort(axis=1)
    out = flip.copy()
    for k in range(least):
        out = mix(out ^ keys[at[:, k]])
    return out.view(np.int64)


def _bands(text: pa.Array, bands: int, least: int) -> pa.Array:
    flat, sizes = [np.zeros(0, np.int64)], []
    for lo, hi, data, bounds in chunks(text):
        w = Words(data, bounds)
        keys, at = labelled(w)
        words = np.diff(w.first)
        for i in range(hi - lo):
            own = keys[at[i] : at[i + 1]]
            sizes.append(0)
            if len(own):
                flat.append(sketch(own, bands, least))
                sizes[-1] = bands
                if words[i] < SHORT:
                    flat.append(sketch(own, bands, 1, 21))
                    sizes[-1] += bands
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    trim()
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat)))


def bands_of(text: Column, bands: int = BANDS, least: int = LEAST) -> Column:
    return arrow_udf(lambda t: _bands(t, bands, least), "array<bigint>")(text)


def slots_of(keys: np.ndarray) -> np.ndarray:
    return (keys % U64(SLOTS)).astype(np.int64)


def run_counts(texts: DataFrame) -> np.ndarray:
    """How often the labelled runs of PAIR words of each slot occur in `texts`: SLOTS numbers, for all runs, added up a slice at a time. They only order runs, so runs may share a slot."""
    slices = SLOTS // SLICE
    names, kind = ["slice", "part", "n"], "slice int, part int, n binary"

    def rows(part: int, n: np.ndarray) -> pa.RecordBatch:
        own = n.reshape(slices, SLICE)
        return pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([part] * slices, pa.int32()), pa.array([x.tobytes() for x in own])], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, _, data, bounds in chunks(batch.column(0)):
                n += np.bincount(slots_of(labelled(Words(data, bounds), PAIR)[0]), minlength=SLOTS)
        trim()
        if n.any():
            yield rows(TaskContext.get().partitionId(), n)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, n in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(n.as_buffer(), np.int64)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([0] * len(held), pa.int32()), pa.array([n.tobytes() for n in held.values()])], names)

    some = texts.select("text").mapInArrow(count, kind).repartition(SALTS * slices, "slice", F.col("part") % SALTS).mapInArrow(add, kind)
    out = np.zeros((slices, SLICE), np.int64)
    for r in some.repartition(slices, "slice").mapInArrow(add, kind).collect():
        out[r["slice"]] += np.frombuffer(r["n"], np.int64)
    return out.ravel()


def in_common(words: int) -> int:
    """Labelled runs of PAIR words that a text of so many words has in common with any similar one, at least.

    An edit spoils PAIR runs of the longer text, which has L >= words; (1 - SIMILAR) * L edits leave L - PAIR + 1 - PAIR * (1 - SIMILAR) * L of them, and more the larger L is.
    """
    return max(1, math.ceil(words * (1 - PAIR * (1 - SIMILAR)) - PAIR + 1 - 1e-6))


def rarest_of(text: Column, rank: np.ndarray) -> Column:
    """The labelled runs of PAIR words of each text, rarest first, as many as any similar text must have one of.

    Of m runs in common the first in the order of all runs has m - 1 after it, so it is among the first of a text's n runs up to the place n - m + 1.
    """

    def run(column: pa.Array) -> pa.Array:
        flat, sizes = [np.zeros(0, U64)], []
        for lo, hi, data, bounds in chunks(column):
            w = Words(data, bounds)
            keys, at = labelled(w, PAIR)
            words = np.diff(w.first)
            for i in range(hi - lo):
                own = keys[at[i] : at[i + 1]]
                many = max(0, len(own) - in_common(int(words[i])) + 1)
                flat.append(own[np.lexsort((own, rank[slots_of(own)]))[:many]])
                sizes.append(many)
        trim()
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat).view(np.int64)))

    return arrow_udf(run, "array<bigint>")(text)


def allowed(longer: int) -> int:
    """Edits that leave a text of so many words similar to one that isn't longer."""
    return math.floor(longer * (1 - SIMILAR) + 1e-9)


def edits(a: list, b: list, most: int, masks: dict | None = None) -> int | None:
    """Least number of items put in, left out or replaced that makes a into b, None above `most`. A wide band is narrow first. masks: `masks_of` a, if that isn't shorter."""
    d = most if most <= NARROW else max(NARROW // 4, abs(len(a) - len(b)))
    while True:
        found = in_band(a, b, min(d, most), masks)
        if found <= d:
            return found if found <= most else None
        if d >= most:
            return None
        d *= 4


#: Widest band that is tried at once, and words of a text whose places are kept as bits.
NARROW, BITS = 64, 2048


def masks_of(a: list) -> dict:
    """The places of each item as bits."""
    out: dict = {}
    for i, x in enumerate(a):
        out[x] = out.get(x, 0) | 1 << i
    return out


class Window:
    """The places of items as bits, of those that stand at `low` or less than `width` beyond it, for a `low` that grows: long texts have no bits in whole."""

    def __init__(self, a: list, width: int):
        self.places: dict = {}
        for i, x in enumerate(a):
            self.places.setdefault(x, []).append(i)
        self.width, self.held = width, {}

    def at(self, x, low: int) -> int:
        own = self.places.get(x)
        if own is None:
            return 0
        bits, base, nth = self.held.get(x, (0, low, 0))
        bits >>= low - base
        while nth < len(own) and own[nth] < low + self.width:
            if own[nth] >= low:
                bits |= 1 << (own[nth] - low)
            nth += 1
        self.held[x] = bits, low, nth
        return bits


def in_band(a: list, b: list, d: int, masks: dict | None = None) -> int:
    """Edit distance of a and b over paths within d of the diagonal, more than d if it is; a column (an item of b) at a time: differences down the column are bits of whole numbers."""
    if len(a) < len(b):
        a, b, masks = b, a, None
    n, m = len(a), len(b)
    if n - m > d:
        return d + 1
    d = min(d, n)
    width = 2 * d + 1
    if masks is None and n <= BITS:
        masks = masks_of(a)
    window = Window(a, width) if masks is None else None
    whole, top = (1 << width) - 1, 1 << (width - 1)
    up, down = ((1 << (d + 1)) - 1) << d, 0
    # the cost runs down the last diagonal of the band to the end of a, and then along it
    cost, last, turn = d, top >> 1, n - d
    for j, x in enumerate(b):
        # bit r stands for item j - d + r of a
        if window is None:
            here = masks.get(x, 0)
            if here:
                here = (here >> (j - d) if j >= d else here << (d - j)) & whole
        else:
            here = window.at(x, j - d)
        same = ((((here & up) + up) ^ up) | here | down) & whole
        right = (down | ~(same | up)) & whole
        left = same & up
        if j < turn:
            if not same & top:
                cost += 1
                if cost > d + (m - turn):
                    return d + 1
        else:
            cost += bool(right & last) - bool(left & last)
            last >>= 1
        moved = same >> 1
        up = (left | ~(moved | right)) & whole
        down = moved & right
    return cost


class Text:
    """The words of one text, as numbers, and in order with their labels."""

    __slots__ = ("bits", "known", "list", "words")

    def __init__(self, words: np.ndarray, labels: np.ndarray):
        self.words, self.known, self.bits, self.list = words, np.sort(labels), None, None

    def near(self, other: Text) -> bool:
        """Do few enough edits make one the other?"""
        a, b = (self, other) if len(self.words) >= len(other.words) else (other, self)
        most, short = allowed(len(a.words)), len(b.words)
        if len(a.words) <= BITS:
            for x in (a, b):
                if x.list is None:
                    x.list = x.words.tolist()
            if a.bits is None:
                a.bits = masks_of(a.list)
            return edits(a.list, b.list, most, a.bits) is not None
        # what long texts begin and end with alike costs nothing
        apart = np.flatnonzero(a.words[:short] != b.words[:short])
        head = int(apart[0]) if len(apart) else short
        rest = a.words[len(a.words) - short + head :], b.words[head:]
        apart = np.flatnonzero(rest[0][::-1] != rest[1][::-1])
        tail = int(apart[0]) if len(apart) else short - head
        return edits(a.words[head : len(a.words) - tail].tolist(), b.words[head : short - tail].tolist(), most) is not None

    def similar(self, other: Text) -> bool:
        return bool(Several([self, other]).may_be(0, np.array([1])).size) and self.near(other)


class Several:
    """Texts of a meeting: which can be similar by their lengths and the words that they share."""

    def __init__(self, texts: list[Text]):
        self.texts, self.n = texts, np.array([len(t.words) for t in texts], np.int64)
        self.flat, self.at = np.concatenate([t.known for t in texts]), np.cumsum(self.n) - self.n

    def may_be(self, i: int, others: np.ndarray) -> np.ndarray:
        n, m = self.n[i], self.n[others]
        longer = np.maximum(n, m)
        most = np.floor(longer * (1 - SIMILAR) + 1e-9)
        fine = (m > 0) & (n > 0) & (longer - np.minimum(n, m) <= most)
        others, m, longer, most = others[fine], m[fine], longer[fine], most[fine]
        if not len(others):
            return others
        theirs = self.flat[ragged(self.at[others], m)]
        own = self.texts[i].known
        found = own[np.minimum(np.searchsorted(own, theirs), n - 1)] == theirs
        common = np.add.reduceat(found, np.cumsum(m) - m, dtype=np.int64)
        # labelled words in common bound the distance from below
        return others[longer - common <= most]


def texts_of(column: pa.Array) -> Iterator[Text]:
    for lo, hi, data, bounds in chunks(column):
        w = Words(data, bounds)
        keys, at = labelled(w, 1)
        for i in range(hi - lo):
            yield Text(w.hashes[w.first[i] : w.first[i + 1]].copy(), keys[at[i] : at[i + 1]])


def sharing(bands: list[np.ndarray]) -> np.ndarray:
    """Which texts have a mark in common."""
    n = len(bands)
    out = np.zeros((n, n), bool)
    marks, owner = np.concatenate(bands), np.repeat(np.arange(n), [len(b) for b in bands])
    if not len(marks):
        return out
    order = np.argsort(marks, kind="stable")
    marks, owner = marks[order], owner[order]
    head = np.flatnonzero(np.concatenate([[True], marks[1:] != marks[:-1]]))
    many = np.diff(np.append(head, len(marks)))
    two = head[many == 2]
    out[owner[two], owner[two + 1]] = True
    for at, size in zip(head[many > 2].tolist(), many[many > 2].tolist(), strict=True):
        own = owner[at : at + size]
        out[own[:, None], own] = True
    return out | out.T


def verify(group: list[tuple[bytes, bytes, int, np.ndarray, Text]], leader: bytes) -> list[tuple[bytes, bytes]]:
    """Links of a forest that joins a leader's followers in one share as their similar pairs do, beyond the classes that they are in already.

    group: key, class, side, bands and words of each text. Where two shares meet (side 0 and 1), only pairs across are compared.
    """
    keys = [g[0] for g in group]
    known_as: dict[bytes, int] = {}
    top = [known_as.setdefault(g[1], i) for i, g in enumerate(group)]
    joined: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    several = Several([g[4] for g in group])

    def against(i: int, others: np.ndarray) -> None:
        own = group[i][4]
        for j in several.may_be(i, others).tolist():
            if root(i) != root(j) and own.near(group[j][4]):
                joined.append((i, j))
                top[root(j)] = root(i)

    lead, all_ = keys.index(leader) if leader in keys else None, np.arange(len(group))
    if lead is not None:
        against(lead, all_[all_ != lead])
    rest = np.array([j for j in range(len(group)) if lead is None or root(j) != root(lead)], np.int64)
    if len(rest) > 1 or (len(rest) and len(group) > 2):
        shares = sharing([g[3] for g in group])
        side = np.array([g[2] for g in group])
        across = side.any()
        todo = np.zeros(len(group), bool)
        todo[rest] = True
        for i in rest.tolist():
            if across and side[i]:
                continue
            # a pair of two that are left is met once
            todo[i] = across and todo[i]
            against(i, np.flatnonzero(shares[i] & (side == 1)) if across else np.flatnonzero(shares[i] & (todo | ~np.isin(all_, rest)) & (all_ != i)))
    # every class that has grown is told as a star about its least key
    least: dict[int, bytes] = {}
    for i, tk in enumerate(keys):
        least[root(i)] = min(tk, least.get(root(i), tk))
    grown = {root(i) for i, _ in joined}
    return [(least[root(i)], tk) for i, tk in enumerate(keys) if root(i) in grown and tk != least[root(i)]]


def verify_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`verify` of each meeting: rows (leader, share, other, side, tk, top, bands, text) come meeting by meeting."""
    meeting, group = None, {}

    def out() -> pa.RecordBatch:
        links = verify(list(group.values()), meeting[0]) if len(group) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        names = list(zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), strict=True))
        sides, keys, tops = (batch.column(k).to_pylist() for k in (3, 4, 5))
        bands = batch.column(6)
        at = np.concatenate([[0], np.cumsum(bands.value_lengths().to_numpy())])
        flat = bands.flatten().to_numpy()
        for i, text in enumerate(texts_of(batch.column(7))):
            if names[i] != meeting:
                if group:
                    yield out()
                meeting, group = names[i], {}
            group.setdefault(keys[i], (keys[i], tops[i], sides[i], flat[at[i] : at[i + 1]], text))
    if group:
        yield out()
    trim()


def is_done(edges: DataFrame) -> bool:
    """Are all edges (u, v) those of stars, whose centres v are in no other? Then every star is a whole class: steps keep what is linked linked."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.count("*").alias("n")).where("out > 1 or (out = 1 and n > 1)").isEmpty()


def classes(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, top): the least node that links, and classes that are known already, join each node to; nodes without links are absent."""
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if known is not None:
        links = links.unionByName(known.select(F.col("node").alias("u"), F.col("top").alias("v")))
    edges = keep(links.where("u <> v").distinct(), "links", links.count())
    while not is_done(edges):
        n = edges.count()
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least", 2 * n)
        large = by_key(both, least, "u", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # a node has few smaller neighbours: it was told of one for each group that it met others in
        small = large.groupBy("u").agg(F.collect_set("v").alias("vs")).select("u", "vs", F.array_min("vs").alias("m"))
        told = F.concat(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v"))), F.transform(F.filter("vs", lambda v: v != F.col("m")), lambda v: F.struct(v.alias("u"), F.col("m").alias("v"))))
        before, edges = edges, keep(small.select(F.explode(told).alias("e")).select("e.*").distinct(), "links", 2 * n)
        discard(before, least)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("top"))


def pairs_of(of: DataFrame, crowded: bool = False) -> DataFrame:
    """(tk, leader) of texts (tk, bands, top) for each bucket that holds more than one class so far.

    Buckets of the same texts give the same pairs. Crowded texts, which share whole passages, have many such: one mark stands for all of them there.
    Elsewhere the digest of a bucket's texts would add 16 bytes to every mark of all texts in the exchange.
    """
    marks = of.select("tk", "top", F.explode("bands").alias("mark"))
    held = [F.bit_xor(F.xxhash64(F.lit(k), "tk")).alias(f"held{k}") for k in (0, 1)] if crowded else []
    buckets = marks.groupBy("mark").agg(F.min("tk").alias("leader"), F.min("top").alias("low"), F.max("top").alias("high"), F.count("*").alias("n"), *held).where("low <> high")
    if crowded:
        buckets = buckets.groupBy("leader", "n", "held0", "held1").agg(F.min("mark").alias("mark"))
    buckets = keep(buckets.select("mark", "leader", "n"), "buckets")
    total = buckets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return keep(by_key(marks.drop("top"), buckets, "mark", total).where("tk <> leader").select("tk", "leader").distinct(), "pairs", total)


def shares_of(pairs: DataFrame, total: int) -> DataFrame:
    return keep(pairs.groupBy("leader").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"), F.count("*").alias("n")), "shares", total)


def led(pairs: DataFrame) -> DataFrame:
    """Meetings (tk, leader, share, other, side) of leaders with their followers, a share at a time."""
    total = pairs.count()
    size = shares_of(pairs, total)
    meet = by_key(pairs, size, "leader", total).select("tk", "leader", F.pmod(F.xxhash64("tk"), F.col("shares")).cast("int").alias("share"))
    meet = meet.unionByName(size.select(F.col("leader").alias("tk"), "leader", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")))
    return keep(meet.select("tk", "leader", "share", F.lit(-1).alias("other"), F.lit(0).alias("side")), "meetings", 2 * total)


def apart(pairs: DataFrame, tops: DataFrame) -> DataFrame:
    """Pairs (tk, leader, top, led: the leader's class) of leaders that have several shares of followers, some of them in another class."""
    own = tops.select(F.col("node").alias("leader"), F.col("top").alias("led"))
    total = pairs.count()
    leaders = keep(shares_of(pairs, total).where("shares > 1").join(own, "leader", "left").select("leader", "n", F.coalesce("led", "leader").alias("led")), "crowds", total)
    of = tops.select(F.col("node").alias("tk"), "top")
    known = keep(by_key(pairs, leaders, "leader", total).join(of, "tk", "left").select("tk", "leader", F.coalesce("top", "tk").alias("top"), "led"), "crowded", total)
    parted = keep(known.groupBy("leader").agg(F.count("*").alias("n"), F.count_if(F.col("top") != F.col("led")).alias("out")).where("out > 0").select("leader", "n"), "parted", total)
    return by_key(known, parted, "leader", total)


def across(known: DataFrame) -> DataFrame:
    """Meetings of each share of the followers that are in another class than their leader with each share of all (share against share; other is below 0 for those of the leader's class)."""
    known = keep(known, "across")
    total = known.count()
    size = keep(known.groupBy("leader").agg(F.ceil(F.count_if(F.col("top") != F.col("led")) / SHARE).cast("int").alias("m"), F.ceil(F.count_if(F.col("top") == F.col("led")) / SHARE).cast("int").alias("k"), F.count("*").alias("n")), "sides", total)
    dealt = by_key(known, size, "leader", total)
    deal = lambda k: F.pmod(F.xxhash64(F.lit(1), "tk"), F.col(k)).cast("int")
    to = lambda k: F.explode(F.when(F.col(k) > 0, F.sequence(F.lit(0), F.col(k) - 1))).alias("j")
    out, same = dealt.where("top <> led").withColumn("own", deal("m")), dealt.where("top = led").withColumn("own", deal("k"))
    meet = out.select("tk", "leader", "own", to("m")).select("tk", "leader", F.least("own", "j").alias("share"), F.greatest("own", "j").alias("other"), (F.col("own") > F.col("j")).cast("int").alias("side"))
    meet = meet.unionByName(out.select("tk", "leader", F.col("own").alias("share"), to("k")).select("tk", "leader", "share", (-1 - F.col("j")).alias("other"), F.lit(0).alias("side")))
    return keep(meet.unionByName(same.select("tk", "leader", "own", to("m")).select("tk", "leader", F.col("j").alias("share"), (-1 - F.col("own")).alias("other"), F.lit(1).alias("side"))), "meetings")


#: Keys of texts that may be broadcast (some 50 bytes each), and meetings of one text that are joined to one copy of it.
FEW, MEETINGS = 100_000, 1000


def wanted(texts: DataFrame, need: DataFrame) -> DataFrame:
    """(tk, text): one row of `texts` (own, tk, text) for each of `need` (tk, id). Copies don't travel."""
    need = need.select(F.col("tk").alias("t"), "id")
    small = F.broadcast(need) if need.count() <= FEW else need
    return texts.join(small, (F.col("t") == F.col("tk")) & F.col("own").eqNullSafe(F.col("id")), "left_semi").select("tk", "text").dropDuplicates(["tk"])


def verified(texts: DataFrame, of: DataFrame, meet: DataFrame) -> DataFrame:
    """Links found in meetings (a kept table, discarded here). texts: own, tk, text; of: tk, id, top and bands of each text, for which a row of texts with that id stands."""
    times = meet.groupBy("tk").agg(F.count("*").alias("n"), F.ceil(F.count("*") / MEETINGS).alias("times"))
    need = keep(times.join(of.select("tk", "id", "top", "bands"), "tk"), "met")
    own = wanted(texts, need).join(need.select("tk", "top", "bands", "times"), "tk")
    if need.where("times > 1").isEmpty():
        there = own.join(meet, "tk")
    else:
        salted = by_key(meet, need.select("tk", "n", "times"), "tk", meet.count()).withColumn("salt", F.pmod(F.xxhash64("leader", "share", "other"), F.col("times"))).drop("times")
        there = own.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1))).join(salted, ["tk", "salt"])
    there = there.select("leader", "share", "other", "side", "tk", "top", "bands", "text")
    by = ["leader", "share", "other"]
    found = keep(there.repartition(*by).sortWithinPartitions(*by).mapInArrow(verify_all, "a binary, b binary"), "similar")
    discard(meet, need)
    return found


def find(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base, of, tops): base has (id, tk: key of its text) of each row of docs, of (tk, n: its rows, id: the least) of each text; tops (node, top) are the classes of keys that similar pairs join."""
    texts = docs.select(docs[id_].alias("own"), F.coalesce(docs[text], F.lit("")).alias("text")).withColumn("tk", F.unhex(F.md5("text")))
    base = keep(texts.select(F.col("own").alias("id"), "tk", bands_of(F.col("text")).alias("bands")), "bands")
    of = keep(base.groupBy("tk").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.col("tk").alias("top"), F.count("*").alias("n")), "texts")
    pairs = pairs_of(of)
    tops = classes(verified(texts, of, led(pairs)))
    again = keep(apart(pairs, tops).select("tk", "top").distinct().join(of.select("tk", "id"), "tk"), "again")
    if again.isEmpty():
        return base, of, tops
    some = keep(wanted(texts, again).join(again, "tk").select("tk", "id", "top", "text"), "some")
    rare = keep(some.select("*", rarest_of(F.col("text"), run_counts(some)).alias("bands")), "rarest")
    own, crowd = rare.select("tk", F.col("id").alias("own"), "text"), rare.drop("text")
    pairs = pairs_of(crowd, True)
    more = verified(own, crowd, led(pairs))
    if not more.isEmpty():
        tops = classes(more, tops)
    known = apart(pairs, tops)
    if known.isEmpty():
        return base, of, tops
    now = crowd.drop("top").join(tops, crowd.tk == tops.node, "left").select("tk", "id", "bands", F.coalesce("top", "tk").alias("top"))
    more = verified(own, now, across(known))
    return base, of, tops if more.isEmpty() else classes(more, tops)


def with_classes(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, tk, top, class_id) for each row of docs: texts with the same `top` are one class, class_id is its least id."""
    base, of, tops = find(docs, id_, text)
    many = of.count()
    own = keep(of.drop("top").join(tops, of.tk == tops.node, "left").select("tk", "id", "n", F.coalesce("top", "tk").alias("top")), "tops", many)
    least = keep(own.groupBy("top").agg(F.min("id").alias("class_id"), F.count("*").alias("n")), "ids", many)
    labels = keep(by_key(own.withColumnRenamed("n", "rows"), least, "top", many).select("tk", "top", "class_id", F.col("rows").alias("n")), "labels", many)
    return by_key(base.select("id", "tk"), labels, "tk", base.count()).select("id", "tk", "top", "class_id")


def keep_one(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, with least id and then least text key; columns as in `docs`."""
    names = [free_name(docs.columns, x) for x in ("tk", "chosen", "rows", "id")]
    tk, chosen, rows, own = names
    found = keep(with_classes(docs, id_, text), "classes")
    total = found.count()
    best = found.groupBy("top").agg(F.min_by(F.struct("id", "tk"), F.struct(F.col("id").isNull(), "id", "tk")).alias("w"))
    many = found.groupBy("id", "tk").agg(F.count("*").alias("n"))
    chosen_ones = best.select("w.*").join(many.select(F.col("id").alias("i"), F.col("tk").alias("t"), "n"), (F.col("tk") == F.col("t")) & F.col("id").eqNullSafe(F.col("i")))
    chosen_ones = keep(chosen_ones.select(F.col("tk").alias(chosen), F.col("id").alias(own), F.col("n").alias(rows)), "kept", total)
    wide = docs.withColumn(tk, F.unhex(F.md5(F.coalesce(docs[text], F.lit("")))))
    joined = wide.join(chosen_ones, (wide[tk] == chosen_ones[chosen]) & wide[id_].eqNullSafe(chosen_ones[own]))
    single = joined.where(F.col(rows) == 1).select(*[docs[c] for c in docs.columns])
    several = joined.where(F.col(rows) > 1).groupBy(tk, own).agg(F.first(F.struct(*[docs[c] for c in docs.columns])).alias(chosen)).select(f"{chosen}.*")
    return single.unionByName(several)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the class of every document."""
    return with_classes(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "class_id")
