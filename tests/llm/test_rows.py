from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import string
import time
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from groupfit.llm import chat, mixing, packing, pseudo_likelihood, secret_scan, top_k, url_rules, wordbytes

SF = "/root/testdata/sf0.001"


def native(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# mixing


def test_mixing_query(spark):
    out = mixing.query(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(out) == len(docs) and all(r.size == len(brute.words(docs[r.doc_id].text)) for r in out)
    size = {}
    for d in docs.values():
        size[d.source] = size.get(d.source, 0) + len(brute.words(d.text))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(size))}
    left, free, goal = 1.5 * sum(size.values()), set(size), {}
    while over := {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * size[s]}:
        goal |= {s: 2.0 * size[s] for s in over}
        left, free = left - sum(2 * size[s] for s in over), free - over
    goal |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    taken = {}
    for r in out:
        source = docs[r.doc_id].source
        assert r.source_size == size[source] and abs(r.target - goal[source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[source] = taken.get(source, 0) + r.taken
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    again = mixing.query(spark, SF).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def test_flow_is_cheapest():
    patterns, quotas = {("a",): 10, ("a", "b"): 10, ("b",): 4}, {"a": 12, "b": 16}
    flow = mixing.flow_by_component(patterns, quotas)
    used = {p: sum(f for (q, _), f in flow.items() if q == p) for p in patterns}
    assert sum(used.values()) == 28 and all(used[p] <= 2 * patterns[p] for p in patterns)
    # 24 words once, and no more than the 4 missing ones twice
    assert sum(max(0, used[p] - patterns[p]) for p in patterns) == 4
    assert sum(f for (_, s), f in flow.items() if s == "a") == 12
    assert mixing.flow_by_component({("a",): 3}, {"a": 100}) == {(("a",), "a"): 6}
    assert mixing.targets({}, {}) == {}


def test_mixing_overlap_and_slices(spark, monkeypatch):
    rows = [(i, [["a"], ["a", "b"], ["b", "c"], ["c"], [None]][i % 5], 10 + i % 7) for i in range(500)] + [(9999, ["a"], 0), (7, ["a"], 10), (7, ["a"], 10)]
    df = spark.createDataFrame(rows, "id long, sources array<string>, size long")
    monkeypatch.setattr(mixing.on_line, "__defaults__", (9,))
    out, goals = mixing.plan(df, mixing.weights_3_1_2, share=1.0)
    got = out.collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r.size and r.taken == sum(p.words for p in r.parts) for r in got)
    assert all(p.source in r.sources for r in got for p in r.parts)
    total = {}
    for r in got:
        for p in r.parts:
            total[p.source] = total.get(p.source, 0) + p.words
    assert all(abs(total[s] - goals[s][1]) <= 1 for s in goals)


def test_take(spark):
    rows = [(1, None, "a", 1), (1, None, "a", 1), (2, "x y z", None, 1), (3, "p q " * 50, None, 1)] + [(4, "p q " * 50, "b", 1)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, key int")
    got = mixing.take(df, mixing.weights_3_1_2)
    assert got.columns == df.columns
    n = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert n[1] == 2 and all(k <= 10 for k in n.values())
    assert mixing.take(df.limit(0), mixing.weights_3_1_2).count() == 0
    odd = df.withColumns({"m": F.create_map(F.lit("k"), "doc_id"), "deep": F.array(F.struct(F.create_map(F.lit(1), "source").alias("x"))), "n": F.lit(1), "rows": F.lit(2), "times": F.lit(3)})
    same = mixing.take(odd, mixing.weights_3_1_2)
    assert same.columns == odd.columns and same.count() == got.count()


def test_repeated_rows_stand_as_one(spark):
    df = spark.range(20_000).select(F.lit(5).cast("long").alias("id"), F.array(F.lit("a")).alias("sources"), F.lit(3).cast("long").alias("size")).unionByName(spark.createDataFrame([(k, ["a"], 7) for k in range(50)], "id long, sources array<string>, size long"))
    out, goals = mixing.plan(df, mixing.weights_3_1_2, share=1.5)
    got = out.groupBy("id", "size").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.max("taken").alias("most")).collect()
    assert sum(r.n for r in got) == 20_050 and abs(sum(r.taken for r in got) - goals["a"][1]) <= 1 and all(r.most <= 2 * r.size for r in got)
    of = spark.createDataFrame([(["a"], 20_050, 60_350)], "of array<string>, docs long, whole long")
    line = mixing.on_line(df, of, 7).select("before", "size").orderBy("before").collect()
    at = 0
    for r in line:
        assert r.before == at
        at += r.size


# packing


ALPHABET = ["a", "b", " ", "  ", "\n", "\n\n", "\t", "é", "\u00a0", "\u3000", "'s", "don't", "12", "!!", "<|endoftext|>", "\u2009", "x" * 30, "\x1c", "ß", "\r\n", "日本"]


@pytest.mark.parametrize("ranks", [True, False])
def test_ids_are_the_tokenizers(ranks):
    paths = packing.paths()
    enc = packing.Encoder(**(paths if ranks else paths | {"ranks": None}))
    own = Tokenizer.from_file(paths["path"])
    rng = random.Random(5)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 25))) for _ in range(1500 if ranks else 200)] + ["", None, " ", "\n"]
    plain = [a for a in ALPHABET if a.isascii() and a not in ("<|endoftext|>", "\x1c")]
    texts += ["".join(rng.choice(plain) for _ in range(rng.randint(0, 25))) for _ in range(1500 if ranks else 200)]
    for lo, ids, at in packing.encode(pa.array(texts), enc):
        for i in range(len(at) - 1):
            assert ids[at[i] : at[i + 1]].tolist() == own.encode(texts[lo + i] or "", add_special_tokens=False).ids


def check_pieces(rows, docs, length=2048):
    """Rows of placements against documents (id -> text)."""
    own = Tokenizer.from_file(packing.paths()["path"])
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
    assert set(by) == set(docs)
    for d, parts in by.items():
        ids, at = [*own.encode(docs[d] or "", add_special_tokens=False).ids, 0], 0
        for k, r in enumerate(sorted(parts, key=lambda r: r.piece)):
            assert r.piece == k and r.start == at and (not k or r.length == length)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and (len(parts) == 1 or len(ids) > length)
    for parts in seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    return len(seq), sum(r.length for r in rows) / length


def test_packing_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    n, least = check_pieces(packing.query(spark, SF).collect(), docs)
    assert n <= 1.01 * least + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 40), max_size=30))
def test_best_two_fit(counts):
    bins, used = packing.best_two_fit(counts, 100), {}
    for held, times in bins:
        assert times > 0 and sum(k * n for k, n in held.items()) <= 100
        for k, n in held.items():
            used[k] = used.get(k, 0) + n * times
    assert used == counts


def test_two_for_one():
    # greedy fills 60 + 35; the gap of 5 and the 35 make room for 22 + 18
    assert packing.best_two_fit({60: 1, 35: 1, 22: 1, 18: 1}, 100) == [({60: 1, 22: 1, 18: 1}, 1), ({35: 1}, 1)]


def test_packing_awkward(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "word " * 9000, 1), (4, "a", 1), (4, "a", 1)], "doc_id long, text string, length int")
    got = packing.placements(df).collect()
    assert sum(r.length for r in got) == 1 + 1 + 2 + 2 + sum(r.length for r in got if r.doc_id == 3)
    assert len([r for r in got if r.doc_id == 4]) == 2
    assert packing.placements(df.limit(0)).count() == 0
    seqs = packing.sequences(df, 64, **packing.paths()).collect()
    assert sum(len(r.ids) for r in seqs) == sum(r.length for r in got) and all(len(r.ids) <= 64 for r in seqs)


# top k


def best_by_hand(rows, k=10, every=100):
    clean = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in clean:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in clean if i != q and len(a) == len(b))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 1 if i % 3 else 9, 8).round(1)]) for i in range(2500)]
    rows += [(None, [1.0] * 8), (5001, None), (5002, [1.0, None] * 4), (5003, [float("nan")] * 8), (5004, [1.0, 2.0]), (5100, [float("inf")] * 8), (5200, [3.0, 4.0]), (5205, []), (5300, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    assert {tuple(r) for r in top_k.search(df, df.where("vec_id % 100 = 0")).collect()} == best_by_hand(rows)
    assert top_k.search(df.limit(0), df.limit(0)).count() == 0


def test_top_k_with_large_numbers(spark):
    rows = [(i, [float((i * 7919 % 101) * 20_000.0), float(-i)]) for i in range(0, 300, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in top_k.search(df, df.where("vec_id % 100 = 0")).collect()} == best_by_hand(rows)


def test_lists_stop_early():
    values = np.arange(4000).reshape(-1, 1)[:, [0, 0]]
    lists = top_k.Lists(values)
    # what lies below the first stretch is never looked at
    lists.sorted[600:3400], lists.owner[600:3400] = 10**9, 0
    got = lists.best(np.array([[1, 1]]), 10, [None], [np.zeros(0, np.int64)])[0]
    assert set(got[0]) >= set(range(3990, 4000)) and len(got[0]) <= 40


@pytest.mark.parametrize("large", [1, 10**5, 10**8, 10**10])
def test_lists_by_hand(large):
    rng = np.random.default_rng(large)
    values, queries = rng.integers(-9, 10, (300, 6)) * large, rng.integers(-9, 10, (40, 6)) * large
    own = [np.array([q]) if q % 2 else np.zeros(0, np.int64) for q in range(40)]
    for q, (at, scores) in enumerate(top_k.Lists(values).best(queries, 5, [None] * 40, own)):
        want = sorted(((-sum(int(a) * int(b) for a, b in zip(values[i], queries[q], strict=True)), i) for i in range(300) if i not in own[q]))[:5]
        got = sorted(zip([-int(x) for x in scores], at.tolist(), strict=True))
        assert set(want) <= set(got) and got[:5] == want


def test_top_k_beyond_64_bits(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    # sums on the way leave 64 bits, scores don't
    rows = [(0, [4e6, 4e6, 1.0]), (1, [4e6, -4e6, 2.0]), (2, [-4e6, 4e6, 3.0]), (3, [1.0, 1.0, 1.0])]
    assert {tuple(r) for r in top_k.search(frame(rows), frame(rows[:1])).collect()} == best_by_hand(rows)
    for x in (1e17, 4e10):
        df = frame([(100, [x, 1.0]), (2, [x, 0.0]), (3, [1.0, 1.0])])
        with pytest.raises(Exception, match="64"):
            top_k.search(df, df.where("vec_id = 100")).collect()


def test_top_k_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(top_k, "GROUP", 2000)
    monkeypatch.setattr(top_k, "QUERIES", 8)
    monkeypatch.setattr(top_k, "HELD", 20)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 6)]) for i in range(0, 6000, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert {tuple(r) for r in top_k.search(df, df.where("vec_id % 100 = 0")).collect()} == best_by_hand(rows)


# chat


PART = "array<struct<type:string,text:string,ref:string,units:int>>"


def test_chat_parts(spark):
    parts = [("text", "see <|im", None, None), ("text", "age:0|> ", None, None), ("image", None, "a.png", 4), ("document", None, "b.pdf", None), (None, "tail<", None, None)]
    df = spark.createDataFrame([(1, 1, "assistant", [("text", "</s>[INST] <\\|x [/INST]", None, None)]), (1, 0, "user", parts), (2, None, None, None)], f"conv_id long, turn long, role string, parts {PART}")
    out = chat.format_turns(df)
    assert native(out)
    got = {r.conv_id: r for r in out.withColumn("read", chat.read_turns(F.col("formatted"))).collect()}
    assert got[1].read[0].text == "see <|image:0|> <|image:0|><|document:1|>tail<"
    assert got[1].formatted.count("<|image:0|>") == 1 and got[1].formatted.count("</s>") == 0
    assert [(a.kind, a.ref, a.tokens) for a in got[1].attachments] == [("image", "a.png", 1024), ("document", "b.pdf", 1024)] and got[1].expanded_tokens == 2048
    assert got[1].read[1].text == "</s>[INST] <\\|x [/INST]"
    assert [got[1].formatted.encode()[s.start : s.end].decode() for s in got[1].loss] == ["<\\/s>[\\INST] <\\\\|x [\\/INST]"]
    assert got[2].formatted == "<|turn|><|text|><|end|>"



def test_chat_round_trip(spark):
    rng = random.Random(9)
    bits = ["<", "[", "|", "\\", "/", "s>", "INST]", "turn|>", "text|>", "end|>", "a", "\n", "SYS>"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
    rows = [(i // 4, i % 4, rng.choice(["user", "assistant", text()]), [("text", text(), None, None)]) for i in range(1200)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {PART}")
    got = {r.conv_id: r for r in chat.format_turns(df).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("read"), "loss", chat.read_loss(F.col("formatted"), F.col("loss")).alias("kept")).collect()}
    for i in range(300):
        want = [(r[2], r[3][0][1]) for r in rows[4 * i : 4 * i + 4]]
        assert [tuple(t) for t in got[i].read] == want
        assert got[i].formatted.count("<|turn|>") == 4 and len(got[i].loss) == sum(r == "assistant" for r, _ in want)
        assert got[i].kept == "".join(t for r, t in want if r == "assistant")


def test_chat_query(spark):
    q = chat.query(spark, SF)
    assert native(q)
    got = {r.conv_id: r for r in q.collect()}
    talks = {-7: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        talks.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    assert set(got) == set(talks)
    for c, turns in talks.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


# URL rules


def test_url_rules(spark, monkeypatch):
    urls = ["http://a.net/x", "https://EXAMPLE.net/en/", "http://www.example.net/en/a?b#c", "http://example.net/e", "http://net/", "http://net", "http://xnet/", "http://b.org/fr/", "http://example.com/de/x", "http://badexample.com/de/", "x://a.b.c.d/long/path", "nothing", None, "", "http://", "a\nb://Q.NET/z", "http://user@h.net:80/?q", "://h.com/p://q"] * 2
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)], "page_id long, url string, rule_ string")
    rules = [*url_rules.RULES, ("b.c.d", "/long/", "block"), ("c.d", "/long/pa", "allow"), ("d", "/long/path", "allow"), ("d", "/long/path", "block"), (None, "/", "block"), ("h.com", "", "block")]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")

    def judge(url):
        _, sep, rest = (url or "").partition("://")
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]) if sep else ""
        tail = rest[cut:] if sep else ""
        path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
        fits = [((len(h + p), len(h), v, h + p), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(None, None, "allow"))
        return host, path, best[1], best[2]

    for few, held in ((url_rules.FEW, url_rules.FEW_BYTES), (1, url_rules.FEW_BYTES), (url_rules.FEW, -1)):
        monkeypatch.setattr(url_rules, "FEW", few)
        monkeypatch.setattr(url_rules, "FEW_BYTES", held)
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, table).collect()}
        assert got == {i: judge(u) for i, u in enumerate(urls)}
    # common URLs, fitted and not, and rows without one
    many = spark.range(4500).select(F.col("id").alias("page_id"), F.element_at(F.array(*[F.lit(u) for u in ("http://net/a", "http://none.example/x", None)]), (F.col("id") % 3 + 1).cast("int")).alias("url"))
    assert {(r.rule, r.verdict, r["count"]) for r in url_rules.judge(many, table).groupBy("rule", "verdict").count().collect()} == {("net/", "block", 1500), (None, "allow", 3000)}
    clash = url_rules.judge(pages.withColumns({"host": F.lit("own"), "Verdict": F.lit(7)}), table)
    assert clash.columns == [*pages.columns, "host", "Verdict", "_host", "path", "rule", "_verdict"]
    assert {r.page_id: (r._host, r.path, r.rule, r._verdict) for r in clash.where("host = 'own'").collect()} == {i: judge(u) for i, u in enumerate(urls)}
    kept = url_rules.drop_blocked(pages.withColumn("host", F.lit(1)), table)
    assert kept.columns == [*pages.columns, "host"] and kept.count() == sum(judge(u)[3] == "allow" for u in urls)
    assert url_rules.judge(pages.limit(0), table).count() == 0 and url_rules.judge(pages, table.limit(0)).where("verdict = 'block'").count() == 0


# secrets


BITS = ["password", "Secret", "TOKEN", "api_key", "apikey", "=", ":", " ", '"', "'", "abc", "123456", "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "é", "\n", ".", "K", "ſecret"]


def test_secret_shapes(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 30)))) for i in range(1500)] + [(9999, None), (9998, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = secret_scan.scan(df)
    assert native(out)
    got = {r.doc_id: [tuple(s) for s in r.base] for r in out.select("doc_id", "base").collect()}
    assert all(got[i] == brute.secrets(t) for i, t in rows)


def test_secret_query(spark):
    q = secret_scan.query(spark, SF)
    assert native(q)
    got = {r.doc_id: r for r in q.collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        spans = brute.secrets(r.text)
        told = [f"{brute.CODES[k]}:{a}:{b}" for a, k, b in spans]
        assert got[r.doc_id].base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert (got[r.doc_id].n_assign, got[r.doc_id].n_access, got[r.doc_id].n_hex) == tuple(sum(k == j for _, k, _ in spans) for j in range(3))
        assert set(told) <= set(got[r.doc_id].spans.split(",")) | {""}


def test_random_strings_are_found_and_words_are_not(spark):
    rng = random.Random(1)
    words = ["understandinglyoverwhelmingly", "/usr/local/share/documentation/files", "aaaaaaaaaaaaaaaaaaaaaaaa", "entekeitschpfkeitbereinheit", "abcabcabcabcabcabcabcabc"]
    rows = [(i, "the " + base64.b64encode(rng.randbytes(rng.choice([15, 18, 24, 33]))).decode() + " is " + rng.choice(words)) for i in range(300)]
    found = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    level = secret_scan.levels(found)
    got = found.select(secret_scan.random_spans(F.col("found"), level).alias("s")).collect()
    assert sum(any(x.start == 4 for x in r.s) for r in got) >= 270 and sum(any(x.start > 4 for x in r.s) for r in got) <= 5
    assert secret_scan.levels(found.limit(0)) == {}


def test_redact(spark):
    rows = [(1, "é token=abcdef12 and " + "0a" * 13 + "!", 3), (2, None, None), (3, "plain", 5), (3, "plain", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumns({"base": F.lit(1), "spans": F.lit(2), "found": F.lit(3)})
    out = secret_scan.redact(df)
    assert native(out) and out.columns == df.columns
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str)
    assert got == sorted([(1, "é [SECRET] and [SECRET]!", 24), (2, None, None), (3, "plain", 5), (3, "plain", 5)], key=str)
    assert secret_scan.redact(df.limit(0)).count() == 0


def normal_tail(z):
    return 1 / (1 + math.exp(min(300.0, 1.5976 * z + 0.07056 * z**3)))


def battery_by_hand(token):
    """p of one candidate, test by test, in plain Python."""
    body = token.rstrip("=").replace("-", "+").replace("_", "/")
    if body.isdigit():
        alphabet = "0123456789"
    elif re.fullmatch("[0-9a-f]+|[0-9A-F]+", body):
        body, alphabet = body.lower(), "0123456789abcdef"
    elif re.fullmatch("[A-Z2-7]+", body):
        alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    else:
        alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    k, n, codes = len(alphabet), len(body), [alphabet.index(c) for c in body]

    def p_of(counts, shares):
        df = len(counts) - 1
        if not df:
            return 1.0
        chi = max(0.0, sum((c - n * s) ** 2 / (n * s) for c, s in zip(counts, shares, strict=True)))
        return normal_tail(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))

    uniform = p_of([codes.count(i) for i in range(k)], [1 / k] * k)
    kinds = [x for x in (str.isupper, str.islower, str.isdigit, lambda c: c in "+/") if any(map(x, alphabet))]
    mass = p_of([sum(map(x, body)) for x in kinds], [sum(map(x, alphabet)) / k for x in kinds])
    high = [2 * c >= k for c in codes]
    up = sum(high)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    both = 2 * up * (n - up)
    if not both:
        p_runs = 2.0 ** (1 - n)
    else:
        var = both * (both - n) / (n * n * (n - 1))
        p_runs = 1.0 if var <= 0 else 2 * normal_tail(abs(runs - both / n - 1) / math.sqrt(var))
    mid = (k - 1) / 2
    serial = sum((a - mid) * (b - mid) for a, b in zip(codes, codes[1:], strict=False)) / (math.sqrt(n - 1) * ((k * k - 1) / 12))
    return min(1.0, 4 * min(uniform, mass, p_runs, 2 * normal_tail(abs(serial))))


def levels_by_hand(found):
    """The level of each band of lengths, from all different candidates (text, p)."""
    bands = {}
    for token, p in set(found):
        bands.setdefault(sum(len(token) >= x for x in (20, 24, 32, 48, 64)), []).append(p)
    out = {}
    for band, ps in bands.items():
        even = 2 * sum(p > 0.5 for p in ps)
        for level in (0.0001, 0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4):
            over = sum(p > level for p in ps)
            if over and max(0.0, over - even * (1 - level)) <= 0.05 * over:
                out[band] = level
                break
    return out


def spans_by_hand(texts):
    """All spans of each text: known shapes, and candidates that pass the battery at their band's level."""
    base, found = [brute.secrets(t) for t in texts], []
    for t, spans in zip(texts, base, strict=True):
        own = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}={0,2}", t or "")]
        found.append([(a, b, x, battery_by_hand(x)) for a, b, x in own if not any(s < b and a < e for s, _, e in spans)])
    level = levels_by_hand([(x, p) for f in found for _, _, x, p in f])
    band = lambda x: sum(len(x) >= k for k in (20, 24, 32, 48, 64))
    return [sorted([*spans, *((a, 3, b) for a, b, x, p in f if p > level.get(band(x), 2.0))]) for spans, f in zip(base, found, strict=True)]


def test_all_spans_by_hand(spark):
    """Battery, levels and the spans that they add, against plain Python over a whole small table."""
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), key=str)
    want = {d: ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans) for (d, _), spans in zip(docs, spans_by_hand([t for _, t in docs]), strict=True)}
    assert {r.doc_id: r.spans for r in secret_scan.query(spark, SF).collect()} == want
    rng = random.Random(6)
    tokens = ["".join(rng.choice(a) for _ in range(rng.choice([20, 23, 40, 70]))) for a in ("0123456789", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ab", "Az09-_", string.ascii_letters + string.digits + "+/") for _ in range(25)]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secret_scan.tests(F.col("t")).alias("p")).collect()
    assert all(abs(r.p - battery_by_hand(r.t)) < 1e-9 for r in got)


def test_long_texts_with_many_secrets(spark):
    """Work grows with the number of matches, not with its square."""
    rng = random.Random(3)
    parts = [rng.choice([rng.randbytes(13).hex(), "token=abcdef" + str(k), base64.b64encode(rng.randbytes(18)).decode(), "é"]) + " word\n" for k in range(60_000)]
    text = "".join(parts)
    df = spark.createDataFrame([(1, text, 5), (2, "short", 5)], "doc_id long, text string, n_chars long")
    began = time.monotonic()
    out = {r.doc_id: r for r in secret_scan.scan(df).select("doc_id", "base", "found").collect()}
    assert [tuple(x) for x in out[1].base] == brute.secrets(text)
    free = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}={0,2}", text)]
    taken = {k for a, _, b in brute.secrets(text) for k in range(a, b)}
    assert [(x.start, x.end) for x in out[1].found] == [(a, b) for a, b in free if not any(k in taken for k in range(a, b))]
    done = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    assert done[1].count("[SECRET]") >= len(brute.secrets(text)) - 10 and done[2] == "short"
    assert time.monotonic() - began < 120


def test_battery_computes_what_it_shares_once(spark):
    """Lambdas are interpreted: each mention of a shared value would be computed again, and those within it."""
    shown = str(secret_scan.tests(F.col("t")))
    assert shown.count("regexp_replace(t,") == 1 and shown.count("split(") == 4


# pseudo-likelihood


def test_gradient():
    rng = np.random.default_rng(0)
    w = pseudo_likelihood.Network.start(rng.random(pseudo_likelihood.OUTPUTS)).astype(float) * 3
    net, grad = pseudo_likelihood.Network(w), pseudo_likelihood.Network(np.zeros(pseudo_likelihood.SIZE))
    around, word = rng.integers(0, 60, (len(pseudo_likelihood.PLACES), 50)), rng.integers(0, pseudo_likelihood.OUTPUTS, 50)
    around[rng.random(around.shape) < 0.1] = pseudo_likelihood.EDGE
    net.scores(around, word, grad)
    for i in rng.choice(np.flatnonzero(grad.flat), 25):
        old, near = w[i], []
        for step in (1e-5, -1e-5):
            w[i] = old + step
            near.append(net.scores(around, word).sum())
        w[i] = old
        assert abs((near[0] - near[1]) / 2e-5 - grad.flat[i]) < 1e-6


def test_every_round_trains_on_small_partitions(spark, monkeypatch):
    starts, train = [], pseudo_likelihood.train
    monkeypatch.setattr(pseudo_likelihood, "train", lambda weights, *a: (starts.append(weights), train(weights, *a))[1])
    docs = spark.createDataFrame([(i, f"some words of text {i} that is short") for i in range(40)], "doc_id long, text string").repartition(4)
    starts.append(pseudo_likelihood.fit(docs).weights)
    assert len(starts) == pseudo_likelihood.ROUNDS + 1 and all((a != b).any() for a, b in zip(starts, starts[1:], strict=False))


def score_by_hand(text, corpus, weights, outputs, groups_known):
    """Score of a text in plain Python: softmax by softmax, and the shares of words within their groups from counts of the whole corpus."""
    P = pseudo_likelihood
    net = P.Network(weights.astype(float))
    w = brute.words(text)
    ids = [outputs.get(x, P.FREQUENT + group_by_hand(x)) for x in w]
    total = 0.0
    for i, x in enumerate(w):
        z = net.hidden.copy()
        for k in P.PLACES:
            there = ids[i + k] if 0 <= i + k < len(w) else P.EDGE
            z = z + net.sides[int(k > 0)][there]
        h = np.tanh(z)
        cls, member = ids[i] % P.CLASSES, ids[i] // P.CLASSES
        a, b = net.classes @ h + net.class_bias, net.members[cls] @ h + net.member_bias[cls]
        total += a[cls] - np.log(np.exp(a).sum()) + b[member] - np.log(np.exp(b).sum())
        if x not in outputs:
            words, types = groups_known[group_by_hand(x)]
            total += np.log(corpus[x] / (words + types)) if x in corpus else np.log(max(types, 1) / (words + max(types, 1))) - len(x.encode()) * np.log(256)
    return total


def group_by_hand(word):
    tail = 0
    for k in range(1, 5):
        raw = word.encode()
        tail = tail << 8 | (raw[-k] if k <= len(raw) else 0)
    for _ in range(2):
        tail = (tail ^ tail >> 32) * 0xD6E8FEB86659FD93 % 2**64
    return (tail ^ tail >> 32) % pseudo_likelihood.GROUPS


@pytest.mark.parametrize("known", [1 << 18, 700])
def test_scores_by_hand(spark, monkeypatch, known):
    """The query's own scores over a whole small table, whether rare words travel with the network or are joined, and those of words that the corpus lacks."""
    P = pseudo_likelihood
    monkeypatch.setattr(P, "KNOWN", known)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = P.fit(docs)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    corpus = Counter(x for t in texts.values() for x in brute.words(t))
    name = lambda x: int(wordbytes.Words(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x.encode())])).hashes[0])
    own = dict(zip(model.vocabulary.hashes.tolist(), model.vocabulary.outputs.tolist(), strict=True))
    outputs = {x: own[h] for x in corpus if own.get(h := name(x), P.FREQUENT) < P.FREQUENT}
    assert len(outputs) == min(P.FREQUENT, len(corpus)) or known < 1000
    assert min(corpus[x] for x in outputs) >= max((corpus[x] for x in corpus if x not in outputs), default=0)
    assert (model.rest.count() > 0) == (len(corpus) > P.FREQUENT + known)
    groups = {}
    for x, n in corpus.items():
        if x not in outputs:
            words, types = groups.get(group_by_hand(x), (0, 0))
            groups[group_by_hand(x)] = words + n, types + 1
    groups_known = {g: groups.get(g, (0, 0)) for g in range(P.GROUPS)}
    got = {r.doc_id: r for r in P.score(docs, model).collect()}
    assert set(got) == set(texts)
    for d in sorted(texts, key=lambda d: len(texts[d]))[:120]:
        assert got[d].n_tokens == len(brute.words(texts[d]))
        want = score_by_hand(texts[d], corpus, model.weights, outputs, groups_known)
        assert abs(got[d].log_prob - want) <= 1e-4 * max(1, abs(want)), d
    odd = "the neverseenword of zzzqqq"
    r = P.score(spark.createDataFrame([(1, odd)], "doc_id long, text string"), model).first()
    assert abs(r.log_prob - score_by_hand(odd, corpus, model.weights, outputs, groups_known)) < 1e-3


def test_words_are_told_from_their_neighbours(spark):
    """Held-out texts: half a nat a word better than the words' own frequencies."""
    P = pseudo_likelihood
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("text is not null").dropDuplicates(["text"]).repartition(4)
    part = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(10))
    model, held = P.fit(docs.where(part > 0)), docs.where(part == 0)
    got = P.score(held, model).agg(F.sum("log_prob"), F.sum("n_tokens")).first()
    bare = P.Model(P.Network.start(P.vocabulary_of(P.lexicon_of(docs.where(part > 0).select("text")))[1]) * 1, model.vocabulary, model.rest)
    net = P.Network(bare.weights)
    net.sides[:], net.classes[:], net.members[:] = 0, 0, 0
    alone = P.score(held, bare).agg(F.sum("log_prob"), F.sum("n_tokens")).first()
    assert got[0] / got[1] - alone[0] / alone[1] > 0.5


def test_pseudo_likelihood(spark):
    rng = random.Random(4)
    after = {f"w{i}": [f"w{(i * 7 + k) % 50}" for k in range(2)] for i in range(50)}

    def prose(n):
        w = ["w0"]
        while len(w) < n:
            w.append(rng.choice(after[w[-1]]))
        return w

    rows = [(i, " ".join(prose(200))) for i in range(600)]
    held = []
    for i in range(40):
        w = prose(200)
        mixed = rng.sample(w, len(w))
        held += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(mixed))]
    train = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model = pseudo_likelihood.fit(train)
    got = {r.doc_id: r for r in pseudo_likelihood.score(spark.createDataFrame(held, "doc_id long, text string"), model).collect()}
    assert sum(got[2 * i].mean_log_prob > got[2 * i + 1].mean_log_prob for i in range(40)) >= 39
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "one", 1), (3, "one", 1)], "doc_id long, text string, log_prob int")
    got = sorted((r.doc_id, r.n_tokens, r.log_prob == 0, r.mean_log_prob is None) for r in pseudo_likelihood.score(odd, model).collect())
    assert got == [(1, 0, True, True), (2, 0, True, True), (3, 1, False, False), (3, 1, False, False)]
    assert pseudo_likelihood.score(odd.limit(0), pseudo_likelihood.fit(odd.limit(0))).count() == 0
