"""Formatting conversations of typed content parts, in column expressions alone.

A turn holds parts of the types text, image, audio and document. A visitor takes
them in order: text is escaped, any other part becomes a numbered placeholder,
its reference goes to the attachments and its expanded token count is its units
times the rate of its type. A turn is written as

    <|turn|>role<|text|>body<|end|>

Inside roles and texts a backslash goes between the first character of a control
string and the rest, after any backslashes that are there already; taking one out
again gives the text back. Control strings of other common templates are escaped
too, so a text can't end a turn in them either. The output is one string and its loss
mask, as places in the string: bodies of assistant turns, nothing else. Places count
bytes of UTF-8, so that a piece is cut out without walking to it.

Turns of a conversation are joined into one string, which is the result itself.
Cases: a null text or role is empty; a part with an unknown or null type is text;
null units count as 1; turns come by number, nulls last, ties by role and text;
repeated rows are turns of their own; a null conv_id is a conversation; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import once, running

# What escaping looks for, as first character and rest.
HEADS = r"[<\[]"
RESTS = r"(?=\||/?s>|/?INST\]|</?SYS>|<?/?SYS>>|start_of_turn>|end_of_turn>)"
#: Tokens of one unit: an image tile, a second of sound, a page.
RATES = {"image": 256, "audio": 25, "document": 1024}

PARTS = "array<struct<type:string,text:string,ref:string,units:int>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"({HEADS})(\\*){RESTS}", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"({HEADS})\\(\\*){RESTS}", "$1$2")


def visit(parts: Column, rates: dict[str, int]) -> Column:
    """(body, attachments: array of (kind, ref, tokens)) of a turn's parts. Placeholders are numbered within the turn."""

    def count(p: Column) -> Column:
        return reduce(lambda a, k: a.when(p["type"] == k, F.coalesce(p["units"], F.lit(1)) * rates[k]), rates, F.when(F.lit(False), F.lit(0)))

    known = lambda p: F.coalesce(p["type"].isin(*rates), F.lit(False))
    kept = F.transform(F.filter(parts, known), lambda p: F.struct(p["type"].alias("kind"), p["ref"].alias("ref"), count(p).cast("long").alias("tokens")))
    # texts that follow one another are escaped as one: a control string may begin in the first and end in the second
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"), F.lit("").alias("open"))

    def step(a: Column, p: Column) -> Column:
        mark = F.concat(F.lit("<|"), p["type"], F.lit(":"), a["n"].cast("string"), F.lit("|>"))
        out = F.when(known(p), F.concat(a["out"], F.array(escape(a["open"]), mark))).otherwise(a["out"])
        text = F.when(known(p), F.lit("")).otherwise(F.concat(a["open"], F.coalesce(p["text"], F.lit(""))))
        return F.struct((a["n"] + known(p).cast("int")).alias("n"), out.alias("out"), text.alias("open"))

    return F.struct(F.aggregate(parts, start, step, lambda a: F.concat(F.array_join(a["out"], ""), escape(a["open"]))).alias("body"), kept.alias("attachments"))


def format_turns(turns: DataFrame, rates: dict[str, int] | None = None) -> DataFrame:
    """turns: conv_id, turn, role, parts. Returns a row for each conversation: conv_id, formatted, loss (array of (start, end): the bytes of formatted under the mask), attachments (in order, with the turn's number), expanded_tokens (of the attachments)."""
    rates = RATES if rates is None else rates
    seen = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), visit(F.coalesce(F.col("parts"), F.array().cast(PARTS)), rates).alias("v"))
    line = F.struct(F.col("turn").isNull().alias("last"), F.col("turn").alias("turn"), F.col("role").alias("role"), F.col("v.body").alias("body"), F.col("v.attachments").alias("attachments"))
    whole = seen.groupBy("conv_id").agg(F.array_sort(F.collect_list(line)).alias("turns"))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                part(F.concat(F.lit("<|turn|>"), escape(t["role"]), F.lit("<|text|>")), F.lit(False)),
                part(t["body"], t["role"] == "assistant"),
                part(F.lit("<|end|>"), F.lit(False)),
            ),
        )
    )
    files = F.flatten(F.transform("turns", lambda t: F.transform(t["attachments"], lambda a: F.struct(t["turn"].alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    out = whole.select("conv_id", segments.alias("segments"), files.alias("attachments"))
    ends = once(F.transform("segments", lambda s: F.octet_length(s["text"])), lambda n: running(n, lambda a, b: a + b))
    spans = F.zip_with("segments", ends, lambda s, e: F.struct((e - F.octet_length(s["text"])).alias("start"), e.alias("end"), s["loss"].alias("loss")))
    loss = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return out.select("conv_id", F.array_join("segments.text", "").alias("formatted"), loss.alias("loss"), "attachments", F.aggregate("attachments.tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("expanded_tokens"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) from a formatted string. Placeholders of other parts stay in the text."""
    turns = F.slice(F.split(formatted, r"<\|turn\|>", -1), F.lit(2), F.size(F.split(formatted, r"<\|turn\|>", -1)))
    body = lambda t: F.regexp_replace(t, r"<\|end\|>\z", "")
    cut = F.transform(turns, lambda t: F.split(body(t), r"<\|text\|>", 2))
    return F.transform(cut, lambda c: F.struct(unescape(c[0]).alias("role"), unescape(c[1]).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, one after another, as they were before they were escaped."""
    raw = formatted.cast("binary")
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(raw, s["start"] + 1, s["end"] - s["start"]).cast("string"))), "")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: each conversation, read back from its formatted string and its loss mask."""
    own = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    null = F.lit(None)
    parts = F.array(F.struct(F.lit("text").alias("type"), F.col("text"), null.cast("string").alias("ref"), null.cast("int").alias("units")))
    done = format_turns(rows.select("conv_id", "turn", "role", parts.alias("parts"))).withColumn("read", read_turns(F.col("formatted")))
    told = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    done = done.withColumn("kept", read_loss(F.col("formatted"), F.col("loss")))
    return done.select("conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("kept").cast("long").alias("loss_chars"), F.sha2("kept", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
escaped AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>|<?/?SYS>>|start_of_turn>|end_of_turn>)', '\1\\\2\3', 'g')) AS chars,
         length(regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>|<?/?SYS>>|start_of_turn>|end_of_turn>)', '\1\\\2\3', 'g')) AS role_chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars + role_chars + length('<|turn|><|text|><|end|>'))::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
