"""Judging URLs by host and path rules.

A rule (host, path, verdict) fits its host and all subdomains of it, if the URL's
path starts with the rule's. Each URL is expanded into pairs of a host suffix and
a path prefix: suffixes of as many labels and prefixes of as many characters as
some rule has, so nothing that can match is left out and a long host or path
costs no more than the rules' shapes. Pairs meet rules on the first eight hex
digits of a SHA-256, the whole digests confirm, and of several rules the one of
most characters wins (a longer host if they are even, then block before allow).

URLs are counted and made distinct before they are expanded. Rules are broadcast
while they are few; more of them are dealt out by prefix digest and salt, copied once
for each salt. Those URLs that a rule fits go back to the rows: broadcast while they
take few bytes; beyond that, very common URLs (by their counts, fitted or not) stay
where they are, and rows without a host and a path, which no rule can fit, aren't
joined at all.

Cases: a null URL or one without :// has an empty host and path and gets the
default; new columns whose names the table has already get underscores in front; rules with null parts are ignored; the same rule twice counts once, and
block wins over allow; repeated rows get equal verdicts; an empty table gives no
rows, and no rules leave the default everywhere; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import HOT, free_name, keep

#: Rules that may be broadcast, and shares of a URL's pairs beyond that.
FEW, SALTS = 100_000, 16
DIGITS = 8
#: Bytes of URLs with their rules that may be broadcast.
FEW_BYTES = 16 << 20


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def pair(host: Column, path: Column) -> Column:
    """The expression that is hashed: a host never holds a slash, so the two parts can't run into one another."""
    return F.concat(host, F.lit("/"), path)


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Pairs for all host suffixes of `labels` labels and path prefixes of `lengths` characters."""
    parts = F.split(host, r"\.", -1)
    n = F.size(parts)
    suffixes = F.filter(F.transform(F.array(*[F.lit(k) for k in labels]), lambda k: F.when(k <= n, F.array_join(F.slice(parts, F.greatest(n - k + 1, F.lit(1)), k), "."))), lambda s: s.isNotNull())
    prefixes = F.filter(F.transform(F.array(*[F.lit(k) for k in lengths]), lambda k: F.when(k <= F.length(path), F.substring(path, F.lit(1), k))), lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: pair(s, p))))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule (host and path of the one that decides, or null) and verdict, each with underscores in front if `pages` has a column of that name."""
    host, path, rule, verdict = (free_name(pages.columns, x) for x in ("host", "path", "rule", "verdict"))
    clean = rules.where("host is not null and path is not null and verdict is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    shape = clean.agg(F.collect_set(F.size(F.split("host", r"\.", -1))), F.collect_set(F.length("path")), F.count("*")).first()
    labels, lengths, n = sorted(shape[0]), sorted(shape[1]), shape[2]
    parsed = pages.select(*[pages[c] for c in pages.columns], host_of(pages[url]).alias(host), path_of(pages[url]).alias(path))
    none = F.lit(None).cast("string")
    if not n:
        return parsed.withColumn(rule, none).withColumn(verdict, F.lit(default))
    digest = lambda c: F.sha2(c, 256)
    table = clean.select(F.concat("host", "path").alias("rule"), F.col("host").alias("r_host"), F.col("verdict").alias("r_verdict"), digest(pair(F.col("host"), F.col("path"))).alias("r_digest")).withColumn("short", F.substring("r_digest", 1, DIGITS))
    each = keep(parsed.select(F.col(host).alias("host"), F.col(path).alias("path")).where("host <> '' or path <> ''").groupBy("host", "path").agg(F.count("*").alias("n")), "urls")
    spread = each.select("host", "path", "n", F.explode(expressions(F.col("host"), F.col("path"), labels, lengths)).alias("e")).select("host", "path", "n", digest(F.col("e")).alias("digest"))
    spread = spread.withColumn("short", F.substring("digest", 1, DIGITS))
    if n <= FEW:
        met = spread.join(F.broadcast(table), "short")
    else:
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = spread.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")).join(salted, ["short", "salt"])
    rank = F.struct(F.length("rule"), F.length("r_host"), F.col("r_verdict"), F.col("rule"))
    best = met.where("digest = r_digest").groupBy("host", "path").agg(F.max_by(F.struct("rule", "r_verdict"), rank).alias("best"))
    best = keep(best.select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), "best"), "judged")
    held = best.agg(F.sum(F.octet_length("b_host") + F.octet_length("b_path") + F.octet_length("best.rule") + 64)).first()[0] or 0

    def told(rows: DataFrame, known: DataFrame) -> DataFrame:
        out = rows.join(known, (F.col(host) == F.col("b_host")) & (F.col(path) == F.col("b_path")), "left")
        return out.select(*parsed.columns, F.col("best.rule").alias(rule), F.coalesce("best.r_verdict", F.lit(default)).alias(verdict))

    if held <= FEW_BYTES:
        return told(parsed, F.broadcast(best))
    total = each.agg(F.sum("n")).first()[0] or 0
    hot = each.where(F.col("n") > max(1000, total // HOT)).select(F.col("host").alias("h_host"), F.col("path").alias("h_path"))
    seen = (F.col("h_host") == F.col("b_host")) & (F.col("h_path") == F.col("b_path"))
    common = hot.join(best, seen, "left").select(F.col("h_host").alias("b_host"), F.col("h_path").alias("b_path"), "best")
    there = (F.col(host) == F.col("h_host")) & (F.col(path) == F.col("h_path"))
    full, bare = parsed.where((F.col(host) != "") | (F.col(path) != "")), parsed.where((F.col(host) == "") & (F.col(path) == ""))
    out = told(full.join(F.broadcast(hot), there, "left_semi"), F.broadcast(common)).unionByName(told(full.join(F.broadcast(hot), there, "left_anti"), best))
    return out.unionByName(bare.withColumn(rule, none).withColumn(verdict, F.lit(default)))


def drop_blocked(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Rows of `pages` whose URL isn't blocked, with their columns."""
    inner, held = free_name(pages.columns, "own"), pages.columns
    wide = pages.select(F.struct(*[pages[c] for c in held]).alias(inner), pages[url].alias("url" if inner != "url" else "_url"))
    return judge(wide, rules, "url").where("verdict <> 'block'").select(*[F.col(inner)[c].alias(c) for c in held])


#: The rules that the contract states.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the verdict on every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string")).select("page_id", "host", "path", "rule", "verdict")


SQL = """
WITH parsed AS (
  SELECT page_id,
         CASE WHEN contains(coalesce(url, ''), '://') THEN translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(coalesce(url, ''), '://') THEN regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules(r_host, r_path, r_verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT host, path, max_by(r_host || r_path, length(r_host || r_path)) AS rule, max_by(r_verdict, length(r_host || r_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parsed), rules
  WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  GROUP BY host, path)
SELECT page_id, parsed.host, parsed.path, rule, coalesce(verdict, 'allow') AS verdict
FROM parsed LEFT JOIN fits ON parsed.host = fits.host AND parsed.path = fits.path
"""
