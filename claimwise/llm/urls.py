"""URL filters: host and path rules, and for other URLs a logistic regression
on hashed character n-grams of host and path.

Scoring is built from Spark SQL functions only; the model is a small table of
weights in the plan. It is fitted on the driver from a small labelled URL table
(``labelled``: at most MAX_LABELLED rows), whatever the size of the pages.

A null url, or one without ``://``, has an empty host and path: no rule fits,
and the model sees no n-grams. Repeated rows are judged alike; other columns are
ignored; an empty table gives an empty result."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimwise.session import materialize

BUCKETS = 8191
GRAMS = (3, 4)
MAX_LABELLED = 10_000
INLINE_RULES = 500  # beyond this many, rules are a table joined on the host's suffixes
THRESHOLD = 0.8  # block at this probability or more
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Words of a small labelled table; each makes a few URLs.
BAD_WORDS = [
    "spam", "spam-farm", "link-farm", "cheap", "cheap-pills", "pills", "pharma-discount", "viagra", "cialis", "casino",
    "online-casino", "poker", "betting", "slots", "jackpot", "lottery-win", "payday-loan", "fast-cash", "free-money",
    "xxx", "porn", "adult-cams", "sex-chat", "escort", "warez", "crack-keygen", "torrent-pirate", "fake-watches",
    "replica-bags", "clickbait", "malware", "phishing", "miracle-diet", "weight-loss-trick", "buy-followers", "seo-links", "ads", "banner-ads", "ad-tracker",
    "adult", "adult-video", "bets", "free-gifts", "win-prizes", "hot-deals",
]
GOOD_WORDS = [
    "news", "daily-news", "library", "museum", "university", "school", "science", "research", "journal", "docs", "wiki",
    "history", "weather", "recipes", "cooking", "garden", "travel", "health-guide", "hospital", "city-council", "parliament",
    "music", "theatre", "football", "chess", "birds", "astronomy", "physics", "mathematics", "open-source", "tutorial",
    "forum", "photo-club", "books", "poetry", "engineering", "gallery", "cinema", "nature", "economy", "politics", "law-review",
    "teaching", "language", "philosophy",
]
GOOD_PATHS = ["/en/12", "/de/345.html", "/fr/6/", "/es/78", "/about", "/archive/2019/04"]
BAD_PATHS = ["/en/34", "/de/9.html", "/buy-now", "/win", "/order-cheap", "/es/2/"]
SITES = [("{w}.example.com", "http"), ("www.{w}.example.org", "https"), ("blog.{w}.example.net", "https")]


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 to block)."""
    out = []
    for words, paths, label in ((GOOD_WORDS, GOOD_PATHS, 0), (BAD_WORDS, BAD_PATHS, 1)):
        for i, w in enumerate(words):
            for j, (site, scheme) in enumerate(SITES):
                out.append((f"{scheme}://{site.format(w=w)}{paths[(i + 2 * j) % len(paths)]}", label))
    return out


@dataclass(frozen=True)
class UrlModel:
    bias: float
    weights: tuple[float, ...]  # by bucket; of the mean over a URL's n-grams


def split_url(url: str) -> tuple[str, str]:
    """Host and path as the Spark expressions give them."""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([len(rest), *(rest.find(c) for c in "/?#" if c in rest)])
    tail = rest[cut:]
    end = min([len(tail), *(tail.find(c) for c in "?#" if c in tail)])
    return rest[:cut].translate(str.maketrans(UPPER, LOWER)), tail[:end]


def buckets(text: str) -> list[int]:
    out = []
    for n in GRAMS:
        for i in range(len(text) - n + 1):
            code = 0
            for c in text[i : i + n]:
                code = (code * 31 + ord(c)) % BUCKETS
            out.append((code * 7 + n) % BUCKETS)
    return out


def fit(labelled: list[tuple[str, int]], steps: int = 300, rate: float = 4.0, decay: float = 1e-4) -> UrlModel:
    """Logistic regression on mean n-gram counts by gradient descent."""
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"at most {MAX_LABELLED} labelled URLs")
    rows = []
    for url, label in labelled:
        found = buckets("".join(split_url(url)))
        part = {}
        for b in found:
            part[b] = part.get(b, 0.0) + 1 / len(found)
        rows.append((part, label))
    w, bias = [0.0] * BUCKETS, 0.0
    for _ in range(steps if rows else 0):
        for part, label in rows:
            z = bias + sum(w[b] * x for b, x in part.items())
            g = label - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            for b, x in part.items():
                w[b] += rate * (g * x - decay * w[b])
            bias += 0.01 * rate * g
    return UrlModel(round(bias, 6), tuple(round(x, 6) for x in w))


_fitted: list[UrlModel] = []


def default_model() -> UrlModel:
    if not _fitted:
        _fitted.append(fit(labelled_urls()))
    return _fitted[0]


def host(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    found = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.when(F.instr(url, "://") > 0, found).otherwise(F.lit(""))


def path(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def logit(text: Column, model: UrlModel) -> Column:
    """The model's log-odds of ``text`` (host and path)."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)
    weights = F.split(F.lit(",".join(map(repr, model.weights))), ",").cast("array<double>")

    def gram(codes: Column, i: Column, n: int) -> Column:
        code = F.lit(0)
        for j in range(n):
            code = (code * 31 + codes[i + j]) % BUCKETS
        return F.get(weights, (code * 7 + n) % BUCKETS)

    def add(codes: Column, n: int):
        return lambda acc, i: acc + gram(codes, i, n)

    def total(codes: Column) -> Column:
        sums = F.lit(0.0)
        for n in GRAMS:
            places = F.when(F.size(codes) >= n, F.sequence(F.lit(0), F.size(codes) - n)).otherwise(F.array().cast("array<int>"))
            sums = sums + F.aggregate(places, F.lit(0.0), add(codes, n))
        count = sum((F.greatest(F.lit(0), F.size(codes) - n + 1) for n in GRAMS), F.lit(0))
        return F.lit(model.bias) + F.when(count > 0, sums / count).otherwise(F.lit(0.0))

    # a one-element transform names the codes once instead of repeating them in the plan
    return F.transform(F.array(codes), total)[0]


def _inline(rules: list[tuple[str, str, str]], host: Column, path: Column) -> Column:
    fits = []
    for verdict, r_host, r_path in rules:
        on = ((host == r_host) | F.endswith(host, F.lit("." + r_host))) & F.startswith(path, F.lit(r_path))
        fits.append(F.when(on, F.struct(F.lit(len(r_host + r_path)).alias("n"), F.lit(r_host + r_path).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")


def _joined(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    table = pages.sparkSession.createDataFrame([(h, p, h + p, v) for v, h, p in rules], "suffix string, prefix string, rule string, verdict string")
    rows = materialize(pages.withColumn("_row", F.monotonically_increasing_id()))
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    met = rows.select("_row", "path", F.explode(suffixes).alias("suffix")).join(table, "suffix").where(F.startswith("path", "prefix"))
    best = met.groupBy("_row").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
    return rows.join(best, "_row", "left").drop("_row")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], model: UrlModel | None = None, key: str = "page_id",
               url: str = "url", threshold: float = THRESHOLD) -> DataFrame:
    """key, host, path, rule (null if none fits) and verdict of each row.
    ``rules``: (``allow`` or ``block``, host, path); a rule fits its host and all
    subdomains where the path starts with its own; the longest wins (of equal
    rules, ``block``). Without a rule the model blocks from ``threshold`` on."""
    model = model or default_model()
    rows = pages.select(key, host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    if len(rules) <= INLINE_RULES:
        rows = rows.withColumn("best", _inline(rules, F.col("host"), F.col("path")))
    else:
        rows = _joined(rows, rules)
    by_model = F.when(logit(F.concat("host", "path"), model) >= math.log(threshold / (1 - threshold)), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), by_model).alias("verdict"))


def judge_sql(rules: list[tuple[str, str, str]], model: UrlModel | None = None, threshold: float = THRESHOLD) -> str:
    """The same over ``pages`` in DuckDB SQL."""
    model = model or default_model()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({quote(v)}, {quote(h)}, {quote(p)})" for v, h, p in rules)

    def sums(n: int) -> str:
        code = "0"
        for j in range(n):
            code = f"(({code}) * 31 + c[i + {j}]) % {BUCKETS}"
        return f"coalesce(list_sum(list_transform(range(1, len(c) - {n} + 2), lambda i: w[(({code}) * 7 + {n}) % {BUCKETS} + 1])), 0)"

    count = " + ".join(f"greatest(0, len(c) - {n} + 1)" for n in GRAMS)
    return f"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
    row_number() OVER () AS row_id
  FROM pages),
model AS (SELECT {json.dumps(list(model.weights))}::DOUBLE[] AS w),
scored AS (
  SELECT p.*, {model.bias} + CASE WHEN {count} > 0 THEN ({" + ".join(map(sums, GRAMS))}) / ({count}) ELSE 0 END AS z
  FROM (SELECT *, list_transform(list_filter(string_split(host || path, ''), lambda x: x <> ''), lambda x: ascii(x)) AS c FROM parts) p, model),
rules(verdict, r_host, r_path) AS (VALUES {table}),
best AS (
  SELECT row_id, max({{'n': length(r_host || r_path), 'rule': r_host || r_path, 'verdict': r.verdict}}) AS b
  FROM parts JOIN rules r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  GROUP BY row_id)
SELECT page_id, host, path, b.rule AS rule,
  coalesce(b.verdict, CASE WHEN z >= {math.log(threshold / (1 - threshold))!r} THEN 'block' ELSE 'allow' END) AS verdict
FROM scored LEFT JOIN best USING (row_id)"""
