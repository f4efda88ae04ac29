"""URL filter: host/path rules found through their rarest literal token.

Each rule is indexed by one of the literal tokens that every url it fits must
hold, the one that is rarest among the urls. The tokens of a url fetch the
rules indexed by them, and only those rules' regular expressions run. Rules
without such a token (none in plain host rules) run on every url. DataFrame
operations only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.llm.common import lower_ascii, written

#: Rules of the query: (verdict, host, path).
DEFAULT_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
                 ("block", "net", "/es/"), ("block", "net", "/fr/"))
_TOKENS = r"[A-Za-z0-9]+"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; path: then up to ``?``, ``#`` or the end. Null or no ``://``:
    both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return (lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def rules_frame(spark: SparkSession, rules=DEFAULT_RULES) -> DataFrame:
    """Rules as rows: rule, verdict, host, path, regex, tokens.

    ``*`` in a path stands for any run of signs. The regex is for host + path;
    the tokens are those that stand whole in every url that fits.
    """
    rows = []
    for verdict, host, path in rules:
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        literal = [re.sub(r"([^A-Za-z0-9/])", r"\\\1", part) for part in path.split("*")]
        regex = r"(?s)^(?:[^/]*\.)?" + re.sub(r"([^A-Za-z0-9])", r"\\\1", host) + "(?=/|$)" + ".*".join(literal)
        text = host + path
        # whole in every url: no wildcard beside it, and not the open end of a path
        tokens = [m.group() for m in re.finditer(_TOKENS, text)
                  if text[m.end():m.end() + 1] != "*" and text[m.start() - 1:m.start()] != "*"
                  and (m.end() < len(text) or not path)]
        rows.append((host + path, verdict, host, path, regex, sorted(set(tokens))))
    return spark.createDataFrame(rows, "rule string, verdict string, host string, path string, regex string, "
                                       "tokens array<string>")


def _url_tokens(address: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(address, "[^A-Za-z0-9]+"), ""))


def index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules with ``token``: the rarest of their tokens among ``urls`` (address);
    the empty string where a rule has none."""
    wanted = rules.select(F.explode("tokens").alias("wanted")).distinct()
    seen = urls.select(F.explode(_url_tokens(F.col("address"))).alias("t"))
    n = seen.join(wanted, F.col("t") == F.col("wanted")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    each = rules.select("rule", "verdict", "host", "path", "regex", F.explode_outer("tokens").alias("token"))
    each = each.join(n, F.col("token") == F.col("t"), "left")
    best = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token").alias("token")))
    return (each.groupBy("rule", "verdict", "host", "path", "regex").agg(best.alias("b"))
            .select("rule", "verdict", "host", "path", "regex", F.coalesce("b.token", F.lit("")).alias("token")))


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url: str = "url",
               default: str = "allow", broadcast_rules: int = 200_000) -> DataFrame:
    """Per row: id, host, path, rule (null if none fits), verdict.

    A rule fits its host and all subdomains where the path starts with the
    rule's path; the longest rule (host and path) wins, then the longest host,
    then block before allow. Where none fits the verdict is ``default``. Null
    and malformed urls have empty host and path. Null ids and repeated rows
    pass through, other columns are not read, an empty table gives an empty
    result. Up to ``broadcast_rules`` rules are broadcast; more are joined by
    their token with a shuffle.
    """
    d = pages.select(F.col(id_col).alias("_id"), F.col(url).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    d = d.select("_id", host.alias("host"), path.alias("path"))
    urls = (d.select(F.concat("host", "path").alias("address")).distinct())
    idx = written(index(urls, rules), "url-rules")
    few = idx.count() <= broadcast_rules
    # every url also has the empty token, which fetches the rules without one
    tokens = F.array_append(_url_tokens(F.col("address")), F.lit(""))
    found = (urls.select("address", F.explode(tokens).alias("t"))
             .join(F.broadcast(idx) if few else idx, F.col("t") == F.col("token"))
             .where("address rlike regex").select("address", "rule", "verdict", "host"))
    order = F.struct(F.length("rule"), F.length("host"), (F.col("verdict") == "block").cast("int"), F.col("rule"))
    best = found.groupBy("address").agg(F.max_by(F.struct("rule", "verdict"), order).alias("b"))
    best = best.select(F.col("address").alias("_address"), "b.rule", F.col("b.verdict").alias("_verdict"))
    out = d.join(best, F.concat("host", "path") == F.col("_address"), "left")
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule",
                      F.coalesce("_verdict", F.lit(default)).alias("verdict"))
