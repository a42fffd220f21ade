"""Secrets in texts: known shapes and a battery of randomness tests, in column expressions alone.

Three kinds have known shapes (assign, access, hex). Any other run of 20 and more
characters of the base-64 alphabets is a candidate of the kind random. Its
encoding is inferred (decimal, hex, base 32, base 64), its symbols and their
classes (capitals, small letters, digits, signs) are tested for uniformity
(chi-squared), its symbols for runs above and below the middle of the alphabet and
for serial correlation, and four times the least of the p-values says how well it
passes as random. Words fail, with p near 0, but the shorter they are the more
often they pass by chance. So the level that a candidate must reach is set for
each band of lengths: from the different candidates of all texts, those that are
random would spread evenly, so what lies above a level beyond their even share
are false discoveries; the lowest level of a fixed grid with a share of ALPHA of
them or less applies, and none if no level has it.

Positions count code points and ends are exclusive. They are running sums of the
lengths of matches and of the pieces between them; sums, the greatest end so far and
what candidates touch are found in steps of doubling width, so n matches cost n log n.
Redaction counts bytes instead, whose pieces are cut without walking to them.

Cases: a null text counts as empty and has no spans; ties don't matter, as equal
candidates have equal p-values and count once; repeated rows get equal spans; an
empty table sets no level and gives no rows; other columns pass through `redact`.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import once, running
from .storage import documents, free_name, keep

# The shapes that the contract states.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Matches of AKIA[A-Z0-9]+ with 20 characters and more, and of [0-9a-f]+ with 24 and more: both take all of a run, so the lengths can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Symbols of each encoding, and the classes they fall into.
ALPHABETS = {"dec": "0123456789", "hex": "0123456789abcdef", "b32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "b64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
CLASSES = ("A-Z", "a-z", "0-9", "+/")

#: Least length of each band.
LENGTHS = (20, 24, 32, 48, 64)
LEVELS = (0.0001, 0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4)
ALPHA = 0.05


PLACES = "array<struct<start:int,end:int,match:string>>"


def places(text: Column, pattern: str, quick: Column | None = None, size=F.length) -> Column:
    """Array of (start, end, match) of all matches; `size` measures them."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def walk(q: Column) -> Column:
        ends = running(F.zip_with(q["h"], F.slice(q["g"], F.lit(1), F.size(q["h"])), lambda h, g: size(g) + size(h)), lambda a, b: a + b)
        return F.zip_with(q["h"], ends, lambda h, e: F.struct((e - size(h)).alias("start"), e.alias("end"), h.alias("match")))

    walked = once(F.struct(hits.alias("h"), F.split(text, pattern, -1).alias("g")), walk)
    return F.when(quick if quick is not None else text.rlike(pattern), walked).otherwise(F.array().cast(PLACES))


def base_spans(text: Column, size=F.length) -> Column:
    """Spans of the known shapes, by start and then kind."""

    def of(kind: int, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    long_value = F.filter(places(text, ASSIGN, size=size), lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2)) >= 6)
    return F.array_sort(F.concat(of(0, long_value), of(1, places(text, ACCESS, F.instr(text, "AKIA") > 0, size)), of(2, places(text, HEX, size=size))))


def tail(z: Column) -> Column:
    """Upper tail of the normal distribution, to three digits or so."""
    return once(z, lambda z: 1 / (1 + F.exp(F.least(F.lit(300.0), 1.5976 * z + 0.07056 * z * z * z))))


def tests(token: Column) -> Column:
    """p of the battery for a string of base-64 characters; an end of = signs is left out.

    Lambdas are interpreted and nothing in them is shared by itself, so whatever is used several times is computed `once`.
    """
    body = F.translate(F.regexp_replace(token, "=+$", ""), "-_", "+/")
    add = lambda a, x: a + x

    def battery(symbols: Column, alphabet: str) -> Column:
        k = len(alphabet)

        def p_of(chi: Column, df: int) -> Column:
            return tail((F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5) if df else F.lit(1.0)

        share = {c: sum(bool(re.match(f"[{c}]", x)) for x in alphabet) / k for c in CLASSES}

        def of_chars(q: Column) -> Column:
            chars, n = q["chars"], q["n"]
            squares = F.aggregate(F.transform(F.array_distinct(chars), lambda c: F.pow(n - F.length(F.replace(symbols, c, F.lit(""))), F.lit(2))), F.lit(0.0), add)
            p_chi = p_of(k / n * squares - n, k - 1)
            held = [F.pow(n - F.length(F.regexp_replace(symbols, f"[{c}]", "")), F.lit(2)) / share[c] for c in CLASSES if share[c]]
            p_class = p_of(reduce(lambda a, b: a + b, held) / n - n, len(held) - 1)
            codes = F.transform(chars, lambda c: F.instr(F.lit(alphabet), c) - 1)
            return F.least(F.lit(1.0), 4 * F.least(p_chi, p_class, once(codes, lambda codes: F.least(*of_codes(codes, n)))))

        def of_codes(codes: Column, n: Column) -> tuple[Column, Column]:
            follows = lambda f, zero: F.aggregate(F.zip_with(F.slice(codes, 1, n - 1), F.slice(codes, F.lit(2), n - 1), f), zero, add)

            def p_of_runs(both: Column) -> Column:
                runs = 1 + follows(lambda a, b: ((2 * a >= k) != (2 * b >= k)).cast("int"), F.lit(0))
                var = both * (both - n) / (n * n * (n - 1))
                usual = once(var, lambda var: F.when(var <= 0, F.lit(1.0)).otherwise(2 * tail(F.abs(runs - both / n - 1) / F.sqrt(var))))
                return F.when(both == 0, F.pow(F.lit(2.0), 1 - n)).otherwise(usual)

            up = F.aggregate(F.transform(codes, lambda c: (2 * c >= k).cast("int")), F.lit(0), add)
            p_runs = once(once(up, lambda up: (2 * up * (n - up)).cast("double")), p_of_runs)
            mid = (k - 1) / 2
            serial = follows(lambda a, b: (a - mid) * (b - mid), F.lit(0.0)) / (F.sqrt(n - 1) * ((k * k - 1) / 12))
            return p_runs, 2 * tail(F.abs(serial))

        return once(F.struct(F.split(symbols, "(?<=.)(?=.)").alias("chars"), F.length(symbols).alias("n")), of_chars)

    return once(
        body,
        lambda body: F.when(body.rlike("^[0-9]+$"), battery(body, ALPHABETS["dec"]))
        .when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), once(F.lower(body), lambda low: battery(low, ALPHABETS["hex"])))
        .when(body.rlike("^[A-Z2-7]+$"), battery(body, ALPHABETS["b32"]))
        .otherwise(battery(body, ALPHABETS["b64"])),
    )


def candidates(text: Column, base: Column, size=F.length) -> Column:
    """Array of (start, end, n, p, key) of the candidates that no span of a known shape touches."""

    def untouched(found: Column) -> Column:
        # in the order of where spans begin and candidates end, a candidate is touched if a span before it reaches beyond its start
        none = F.lit(None).cast("struct<start:int,end:int,match:string>")
        spans = F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("span"), b["end"].alias("reach"), none.alias("c")))
        own = F.transform(found, lambda c: F.struct(c["end"].alias("at"), F.lit(0).alias("span"), F.lit(0).alias("reach"), c.alias("c")))

        def pick(line: Column) -> Column:
            reach = running(F.transform(line, lambda x: x["reach"]), lambda a, b: F.greatest(a, b))
            free = F.filter(F.zip_with(line, reach, lambda x, r: F.struct(x["c"].alias("c"), (x["span"] == 0) & (r <= x["c"]["start"]))), lambda q: q["col2"])
            return F.transform(free, lambda q: q["c"])

        return once(F.array_sort(F.concat(spans, own)), pick)

    free = once(places(text, CANDIDATE, size=size), lambda found: F.when((F.size(found) == 0) | (F.size(base) == 0), found).otherwise(untouched(found)))
    return F.transform(free, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.length(c["match"]).alias("n"), tests(c["match"]).alias("p"), F.xxhash64(c["match"]).alias("key")))


def band_of(n: Column) -> Column:
    return reduce(lambda a, b: a + b, [(n >= k).cast("int") for k in LENGTHS])


def levels(found: DataFrame) -> dict[int, float]:
    """The level of each band, from a frame with the column `found` of `candidates`. The driver gets a count for each band and level."""
    each = found.select(F.explode("found").alias("c")).select("c.key", band_of(F.col("c.n")).alias("band"), F.col("c.p").alias("p")).dropDuplicates(["key", "band"])
    above = [F.count_if(F.col("p") > t).alias(f"t{k}") for k, t in enumerate((*LEVELS, 0.5))]
    out = {}
    for row in each.groupBy("band").agg(*above).collect():
        even = row[f"t{len(LEVELS)}"] / 0.5
        for k, t in enumerate(LEVELS):
            over = row[f"t{k}"]
            if over and max(0.0, over - even * (1 - t)) <= ALPHA * over:
                out[row["band"]] = t
                break
    return out


def random_spans(found: Column, level: dict[int, float]) -> Column:
    passes = lambda c: reduce(lambda a, b: a | b, [(band_of(c["n"]) == k) & (c["p"] > t) for k, t in sorted(level.items())], F.lit(False))
    return F.transform(F.filter(found, passes), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))


def scan(docs: DataFrame, text: str = "text", base: str = "base", found: str = "found", size=F.length) -> DataFrame:
    """`docs` with the arrays `base` (spans of known shapes) and `found` (candidates); both names must be free."""
    whole = F.coalesce(docs[text], F.lit(""))
    return docs.withColumn(base, base_spans(whole, size)).withColumn(found, candidates(whole, F.col(base), size))


def joined(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", length: str | None = "n_chars") -> DataFrame:
    """`docs` with every span of its texts replaced by `mark`, overlapping ones together; the column `length`, if there is one, follows."""
    b, f, s, t = (free_name(docs.columns, x) for x in ("base", "found", "spans", "redacted"))
    wide = scan(docs, text, b, f, F.octet_length)
    # a filter on their number would compute the candidates of each text a second time
    level = levels(keep(wide.select(F.col(f).alias("found")), "candidates"))
    spans = F.array_sort(F.concat(F.col(b), random_spans(F.col(f), level)))
    whole = docs[text]
    raw = whole.cast("binary")
    piece = lambda start, size: F.substring(raw, start + 1, size).cast("string")

    def cut(reach: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(reach, i - 1)).otherwise(0)
            return F.when(x["start"] >= before, F.concat(piece(before, x["start"] - before), F.lit(mark))).otherwise("")

        last = F.element_at(reach, -1)
        return F.concat(F.array_join(F.transform(F.col(s), one), ""), piece(last, F.octet_length(whole) - last))

    done = once(running(F.transform(F.col(s), lambda x: x["end"]), lambda a, b: F.greatest(a, b)), cut)
    out = wide.withColumn(s, spans).withColumn(t, F.when(F.size(F.col(s)) > 0, done))
    cols = {c: docs[c] for c in docs.columns}
    cols[text] = F.coalesce(F.col(t), whole).alias(text)
    if length in cols and length != text:
        cols[length] = F.coalesce(F.length(F.col(t)).cast(docs.schema[length].dataType), docs[length]).alias(length)
    return out.select(*cols.values())


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the spans of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    narrow = keep(scan(docs).select("doc_id", "base", "found"), "secrets")
    spans = F.array_sort(F.concat("base", random_spans(F.col("found"), levels(narrow))))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return narrow.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(spans).alias("spans"))
