"""Quality rules by weak supervision.

Each rule reads counts of one text and votes good (+1), bad (-1) or abstains (0).
Expectation-maximisation over the counts of vote patterns (at most 3 to the
number of rules, whatever the corpus) estimates how often each rule votes either
way on good and on bad documents, hence its accuracy, and the share of good ones. An
abstention says nothing: it adds no weight, neither to estimates nor to the verdict. A
document's posterior probability of being good is then a sum of weights of votes, a
plain column expression; it replaces a filter that every rule must pass.

Texts are counted once; the counts are written beside what they belong to, and both
the estimate and the verdict read them there.

Cases: a null text counts as empty; on a text without words every rule but the
one on length abstains; repeated rows get equal verdicts; an
empty table leaves the starting accuracies; other columns pass through, whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .storage import documents, free_name, keep
from .wordbytes import U64, Words, chunks, count_in, hash_spans, mix, per_text, runs_hash, trim

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_stopped_lines", "longest_run")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;\"')")] = True


def text_counts(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS for each text; two lines or windows are equal if their 64-bit hashes are."""
    n, w = len(bounds) - 1, Words(data, bounds)
    doc, salt = w.text_of, mix(np.arange(1, n + 1).astype(U64))
    out = {"n_words": np.diff(w.first), "n_symbols": count_in(_SYMBOL[data], bounds)}
    space = np.zeros(len(data) + 1, np.int32)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[w.starts] += 1
    inside[w.ends] -= 1
    np.cumsum(inside, out=space)
    out["word_chars"] = count_in((space[:-1] > 0) & ((data & 0xC0) != 0x80), bounds)
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    out["n_letter_words"] = per_text(doc[letters[w.ends] > letters[w.starts]], n)

    cut = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([bounds[:-1], cut + 1]))
    texts = np.concatenate([np.arange(n), np.searchsorted(bounds, cut, "right") - 1])
    order = np.lexsort((texts, np.concatenate([bounds[:-1], cut + 1])))
    texts = texts[order]
    ends = np.sort(np.concatenate([cut, bounds[1:]]))
    words = np.searchsorted(w.starts, ends) - np.searchsorted(w.starts, starts)
    full = words > 0
    starts, ends, texts = starts[full], ends[full], texts[full]
    out["n_lines"] = per_text(texts, n)
    keys = np.unique(np.stack([texts.astype(U64), hash_spans(data, starts, ends)]), axis=1) if len(texts) else np.zeros((2, 0), U64)
    out["n_dup_lines"] = out["n_lines"] - per_text(keys[0].astype(np.int64), n)
    last = w.ends[np.searchsorted(w.starts, ends) - 1] - 1
    out["n_stopped_lines"] = per_text(texts[_STOP[data[last]]], n)

    h = w.hashes
    triple = runs_hash(h, 3)
    at = np.flatnonzero(doc[: len(triple)] == doc[2:]) if len(triple) else np.zeros(0, np.int64)
    covered = np.zeros(len(h) + 1, np.int8)
    if len(at):
        key = mix(triple[at] ^ salt[doc[at]])
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            covered[at[twice] + k] = 1
    out["n_repeat_words"] = per_text(doc[covered[:-1] > 0], n)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(new)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc[heads], np.diff(np.append(heads, len(h))))
    out["longest_run"] = longest
    return out


def _counts(text: pa.Array) -> pa.Array:
    parts = [text_counts(d, b) for _, _, d, b in chunks(text)]
    trim()
    return pa.StructArray.from_arrays([pa.array(np.concatenate([p[c] for p in parts] or [np.zeros(0)]).astype(np.int64)) for c in COUNTS], list(COUNTS))


def counts_of(text: Column) -> Column:
    return arrow_udf(_counts, "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">")(text)


def over(counts: str, sql: str) -> Column:
    """SQL in which {name} is one of COUNTS in the struct column `counts`."""
    for c in COUNTS:
        sql = sql.replace(f"{{{c}}}", f"`{counts}`.`{c}`")
    return F.expr(sql)


@dataclass(frozen=True)
class Rule:
    """Votes bad where `bad` holds, else good where `good` holds; abstains elsewhere. On texts without words the rule named length votes bad and the others abstain. Both are SQL over COUNTS."""

    name: str
    bad: str
    good: str

    def vote(self, counts: str) -> Column:
        return F.when(over(counts, "{n_words} = 0"), -1 if self.name == "length" else 0).when(over(counts, self.bad), -1).when(over(counts, self.good), 1).otherwise(0)


#: Between what speaks for and what speaks against a document, rules abstain.
RULES = (
    Rule("length", "{n_words} < 20", "{n_words} >= 100"),
    Rule("word_length", "{word_chars} < 2 * {n_words} or {word_chars} > 14 * {n_words}", "{word_chars} >= 3 * {n_words} and {word_chars} <= 9 * {n_words}"),
    Rule("symbols", "10 * {n_symbols} > {n_words}", "{n_symbols} = 0"),
    Rule("symbol_mass", "2 * {n_symbols} > {n_words}", "50 * {n_symbols} <= {n_words}"),
    Rule("duplicate_lines", "{n_dup_lines} >= 4 and 10 * {n_dup_lines} > 3 * {n_lines}", "{n_lines} >= 3 and {n_dup_lines} = 0"),
    Rule("repetition", "10 * {n_repeat_words} > 4 * {n_words}", "10 * {n_repeat_words} <= {n_words}"),
    Rule("letters", "10 * {n_letter_words} < 7 * {n_words}", "20 * {n_letter_words} >= 19 * {n_words}"),
    Rule("line_ends", "{n_lines} >= 4 and 10 * {n_stopped_lines} < {n_lines}", "2 * {n_stopped_lines} >= {n_lines}"),
    Rule("word_runs", "{longest_run} >= 8", "{longest_run} <= 2"),
)

#: The base rules of the contract.
FAILED = "{n_words} < 50 or 100 * {n_repeat_words} > 50 * {n_words}"


@dataclass(frozen=True)
class Model:
    """prior: share of good documents. near: what a good vote multiplies the odds by, at most. chance[j]: how often rule j votes (bad, abstains, good), on good and on bad documents."""

    prior: float
    near: float
    chance: tuple[tuple[tuple[float, float, float], tuple[float, float, float]], ...]

    def weights(self) -> tuple[float, list[tuple[float, float]]]:
        """Log odds before any vote, and what a bad vote and a good vote of each rule add."""
        return float(np.log(self.prior / (1 - self.prior))), [(float(np.log(good[0] / bad[0])), min(float(np.log(good[2] / bad[2])), float(np.log(self.near)))) for good, bad in self.chance]

    def accuracy(self) -> list[tuple[float, float]]:
        """How often each rule, when it votes, is right on good and on bad documents."""
        return [(g[2] / (g[0] + g[2]), b[0] / (b[0] + b[2])) for g, b in self.chance]


#: Chances of a bad vote, an abstention and a good vote before the first round, on good and on bad documents.
START = ((0.005, 0.395, 0.6), (0.3, 0.2, 0.5))


def estimate(votes: np.ndarray, n: np.ndarray, rounds: int = 200, prior: float = 0.8, weight: float = 100.0, most: float = 0.95, apart: float = 3.0, near: float = 1.5) -> Model:
    """EM on vote patterns (rows of `votes`, each seen n times).

    One imaginary document of either class with the starting chances is added,
    and `weight` documents with the starting prior, so a handful of rows doesn't
    settle what is good. The prior stays in [1 - most, most], and a bad vote stays at least `apart`
    times as likely on bad documents, which settles which class is which. A rule looks for one kind of defect, which
    most bad documents don't have either: its good vote multiplies the odds by `near` at most.
    """
    first = prior
    chance = np.tile(np.array(START)[None], (votes.shape[1], 1, 1))
    hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    for _ in range(rounds):
        gain = (np.log(chance[:, 0]) - np.log(chance[:, 1])) * (1.0, 0.0, 1.0)
        gain[:, 2] = np.minimum(gain[:, 2], np.log(near))
        p = 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + np.einsum("pjv,jv->p", hot, gain))))
        new = np.stack([np.einsum("p,pjv->jv", n * w, hot) + np.array(START[c]) for c, w in enumerate((p, 1 - p))], axis=1)
        new /= new.sum(axis=2, keepdims=True)
        new[:, 0, 0] = np.minimum(new[:, 0, 0], new[:, 1, 0] / apart)
        new = new.clip(1e-3)
        new /= new.sum(axis=2, keepdims=True)
        share = float(np.clip((n @ p + weight * first) / (n.sum() + weight), 1 - most, most))
        done = abs(share - prior) < 1e-10 and np.abs(new - chance).max() < 1e-10
        prior, chance = share, new
        if done:
            break
    return Model(prior, near, tuple((tuple(map(float, g)), tuple(map(float, b))) for g, b in chance))


def fit(counted: DataFrame, rules: tuple[Rule, ...] = RULES, counts: str = "counts") -> Model:
    """From a table with the struct `counts`; the driver gets one row for each vote pattern that occurs."""
    seen = counted.select(F.array(*[r.vote(counts) for r in rules]).alias("v")).groupBy("v").count().collect()
    seen.sort(key=lambda r: r["v"])
    votes = np.array([r["v"] for r in seen]).reshape(len(seen), len(rules))
    return estimate(votes, np.array([r["count"] for r in seen], float))


def posterior_of(model: Model, rules: tuple[Rule, ...] = RULES, counts: str = "counts") -> Column:
    base, added = model.weights()
    odds = F.lit(base)
    for rule, (down, up) in zip(rules, added, strict=True):
        vote = rule.vote(counts)
        odds = odds + F.when(vote == 1, F.lit(up)).when(vote == -1, F.lit(down)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def score(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", counts: str = "counts", posterior: str = "posterior", base_failed: str = "base_failed") -> DataFrame:
    """`docs`, written with the struct `counts`, and with the probability `posterior` and `base_failed` added; the three names must be free."""
    counted = keep(docs.withColumn(counts, counts_of(F.coalesce(F.col(text), F.lit("")))), "counts")
    return counted.withColumn(posterior, posterior_of(fit(counted, rules, counts), rules, counts)).withColumn(base_failed, over(counts, FAILED))


def filter_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", least: float = 0.5) -> DataFrame:
    """Rows that the base rules pass and whose posterior is `least` or more, with the columns of `docs`."""
    c, p, f = (free_name(docs.columns, x) for x in ("counts", "posterior", "base_failed"))
    return score(docs, rules, text, c, p, f).where(~F.col(f) & (F.col(p) >= least)).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the counts, the base rules and the verdict for every document."""
    docs = documents(spark, sf_dir).select("doc_id", counts_of(F.coalesce("text", F.lit(""))).alias("counts"))
    counted = keep(docs, "counts")
    out = counted.withColumn("posterior", posterior_of(fit(counted))).withColumn("base_failed", over("counts", FAILED))
    told = [F.col(f"counts.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return out.select("doc_id", *told, "base_failed", (~F.col("base_failed") & (F.col("posterior") >= 0.5)).alias("kept"), F.round("posterior", 9).alias("posterior"))
