"""URL filters: pattern rules found by their rarest literal token.

Each rule is a regular expression over host and path with the literal tokens that any fitting URL holds
whole. A rule is filed under the one of its tokens that fewest URLs hold; a URL's tokens fetch candidate rules
by an equi-join, and only those run their expressions. Rules without a token are candidates for each URL.

A null URL, or one without "://", has an empty host and path, and fits no rule. Equal rows are judged alike;
an empty table gives no row. Columns besides the id and the URL are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9]+"

#: Words that block a host of which they are a part, by subject; a parameter of the queries.
UNWANTED = """
ad ads adserver adservice banner click clicks popup track tracker tracking
adult erotic escort hentai nude porn porno sex sexy xxx
bet bets betting bingo casino gamble gambling jackpot lottery poker roulette slots
botnet exploit hack hacked keygen malware phish phishing trojan virus warez crack cracked
cialis drugs pharma pharmacy pill pills steroids viagra
credit debt forex loan loans payday replica
bulk farm linkfarm scam spam spammer
""".split()


@dataclass(frozen=True)
class Rule:
    """name: what is reported. pattern: over host + path. tokens: whole tokens of any host + path that fits. rank: the greatest that fits decides."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int
    listed: bool = True


def host_path(verdict: str, rule: str) -> Rule:
    """A rule for a host, its subdomains and the paths that start alike, such as example.com/en/7."""
    host, _, rest = rule.partition("/")
    path = "/" + rest
    host = host.lower()
    whole = path[: max(path.rfind(c) for c in "/._-") + 1] if re.search(r"[A-Za-z0-9]$", path) else path
    tokens = tuple(dict.fromkeys(re.findall(TOKEN, host) + [t for t in re.findall(r"[A-Za-z0-9]+", whole) if re.fullmatch(TOKEN, t)]))
    return Rule(rule, verdict, r"^([^/]*\.)?" + re.escape(host) + re.escape(path), tokens, len(rule))


def named_host(word: str) -> Rule:
    """Blocks hosts of which a hyphenated or dotted part is `word`; it gives way to any listed rule."""
    return Rule(f"host:{word}", "block", rf"^([^/]*[.\-])?{re.escape(word)}[.\-]", (word,), 0, listed=False)


def parts(url: str = "url") -> dict:
    """Columns host and path."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return {"host": F.translate(host, upper, lower), "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)}


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", key: str = "page_id") -> DataFrame:
    """key, host, path, rule (the listed rule that fits and ranks highest, else null), verdict (its, else block where a rule that isn't listed fits, else allow)."""
    spark = pages.sparkSession
    # Arrow and Python take no part; the row number keeps equal rows apart
    p = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url")).withColumns(parts("_url")).groupBy("_key", "host", "path").agg(F.count("*").alias("_rows"))
    tokens = F.array_distinct(F.regexp_extract_all(F.concat("host", F.lit(" "), "path"), F.lit(f"({TOKEN})"), 1))
    asked = sorted({t for r in rules for t in r.tokens})
    spread = p.where("host <> ''").select("_key", "host", "path", F.explode(tokens).alias("token")).where(F.col("token").isin(asked))
    held = {r["token"]: r["n"] for r in spread.groupBy("token").agg(F.count("*").alias("n")).collect()}  # one row a token of the rules
    filed = [(min(r.tokens, key=lambda t: (held.get(t, 0), t)) if r.tokens else None, r) for r in rules]
    schema = "token string, name string, verdict string, pattern string, rank int, listed boolean"
    index = spark.createDataFrame([(t, r.name, r.verdict, r.pattern, r.rank, r.listed) for t, r in filed if t is not None], schema)
    candidates = spread.join(index, "token").select("_key", "host", "path", "name", "verdict", "pattern", "rank", "listed")
    for _, r in [x for x in filed if x[0] is None]:
        candidates = candidates.unionByName(p.select("_key", "host", "path", *(F.lit(getattr(r, c)).alias(c) for c in ("name", "verdict", "pattern", "rank", "listed"))))
    fits = candidates.where(F.expr("rlike(concat(host, path), pattern)"))
    best = fits.groupBy("_key", "host", "path").agg(F.max(F.struct("listed", "rank", "name", "verdict")).alias("best"))
    best = best.select(F.col("_key").alias("_k"), F.col("host").alias("_h"), F.col("path").alias("_p"), "best")
    same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p"))
    out = p.join(best, same, "left").select(F.col("_key").alias(key), "host", "path", F.when(F.col("best.listed"), F.col("best.name")).alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))).alias("_n"))
    return out.drop("_n")
