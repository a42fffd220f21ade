from __future__ import annotations

import random

import brute
import corpus_pipeline
import numpy as np
from test_rows import check_pieces

from groupfit.llm import mixing, quality
from groupfit.llm.wordbytes import chunks

SF = "/root/testdata/sf0.001"


def votes(text):
    """Each rule's vote, by evaluating its SQL as Python."""
    import pyarrow as pa

    c = {k: int(v[0]) for k, v in next(quality.text_counts(d, b) for _, _, d, b in chunks(pa.array([text or ""]))).items()}

    def holds(sql):
        import re

        sql = re.sub(r"\{(\w+)\} between (.*?) and (.*)", r"(\2) <= {\1} <= (\3)", sql).replace(" = ", " == ").replace("false", "False")
        return eval(sql.format(**c))  # noqa: S307

    if not c["n_words"]:
        return [-1 if r.name == "length" else 0 for r in quality.RULES]
    return [-1 if holds(r.bad) else 1 if holds(r.good) else 0 for r in quality.RULES]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near copies", "secret scans", "mixing", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    rows = docs.collect()

    all_votes = np.array([votes(r.text) for r in rows])
    patterns, n = np.unique(all_votes, axis=0, return_counts=True)
    base, added = quality.estimate(patterns, n.astype(float)).weights()
    failed = lambda c: c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
    keep = [r for r, v in zip(rows, all_votes, strict=True) if base + sum((w[0], 0, w[1])[x + 1] for w, x in zip(added, v, strict=True)) >= 0 and not failed(brute.counts(r.text))]
    good = stages["quality rules"](spark, docs, SF)
    assert good.columns == docs.columns and sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in keep)

    tops = brute.classes([(r.doc_id, r.text) for r in keep])
    single = [r for r, c in zip(keep, tops, strict=True) if r.doc_id == c]
    alone = stages["near copies"](spark, good, SF)
    assert alone.columns == docs.columns and sorted(r.doc_id for r in alone.collect()) == sorted(r.doc_id for r in single)

    clean = stages["secret scans"](spark, alone, SF)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == docs.columns and texts == {r.doc_id: brute.redacted(r.text, brute.secrets(r.text)) for r in single}

    mixed = stages["mixing"](spark, clean, SF)
    assert mixed.columns == docs.columns
    source = {r.doc_id: r.source for r in single}
    size, taken = {}, {}
    for d, t in texts.items():
        size[source[d]] = size.get(source[d], 0) + len(brute.words(t))
    order = sorted(size)
    goal = mixing.targets(size, dict(zip(order, mixing.weights_3_1_2(order), strict=True)))
    copies = {}
    for r in mixed.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
        taken[r.source] = taken.get(r.source, 0) + len(brute.words(r.text))
        assert r.text == texts[r.doc_id]
    assert max(copies.values()) <= 2
    longest = max(len(brute.words(t)) for t in texts.values())
    assert all(abs(taken.get(s, 0) - goal[s]) <= longest for s in goal)

    once = mixed.dropDuplicates(["doc_id"])
    packed = stages["packing"](spark, once, SF)
    used, least = check_pieces(packed.collect(), {d: texts[d] for d in copies})
    assert used <= 1.02 * least + 1


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns) and out.count() > 50


def test_awkward_rows(spark, tmp_path):
    rng = random.Random(3)
    prose = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(80)) + "."
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), *[(3, "x y", "en", "a", 3)] * 3, *[(k, prose(), "en", rng.choice(["a", "b", None]), 5) for k in range(4, 40)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for some in (df, df.limit(0)):
        path = str(tmp_path / str(some is df))
        some.write.parquet(f"{path}/documents.parquet")
        n = corpus_pipeline.run(spark, path).count()
        assert (n > 20) == (some is df)
