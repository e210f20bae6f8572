"""URL filter (operator 1): pattern rules indexed by their rarest literal token.

A rule is a host suffix with a path prefix. It becomes one regular expression and a
few literal tokens (host labels, whole path segments). How often each of those tokens
occurs is counted over all given URLs, and the rule is filed under its rarest one.
A URL's own tokens then fetch the few rules worth trying, and only those run their
expression. DataFrame functions only.

Defined cases: a null URL or one without ``://`` has empty host and path and fits no
rule; the rule with the longest text wins, then the longer host, then ``block`` before ``allow``;
every given row gives one row, repeated ones too; no rows give no rows; other columns
of the input are ignored unless listed in ``keep``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wagerlens.llm.common import BROADCAST_ROWS, table

#: Rules of the registered query. Fixed values.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Every URL has this token; rules without a literal token are filed under it.
_ANY = "*"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @classmethod
    def of(cls, verdict: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(verdict, host.lower(), slash + path)

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        """On host followed by path; a host never holds a slash."""
        return rf"(?s)^(?:[^/]*\.)?{_literal(self.host)}{_literal(self.path)}" if self.path else rf"(?s)^(?:[^/]*\.)?{_literal(self.host)}(?:/|$)"

    @property
    def tokens(self) -> list[str]:
        """Literals that every fitting URL has as whole tokens; the last path segment may be a mere prefix."""
        labels = [f"h:{x}" for x in self.host.split(".") if x]
        return sorted({_ANY, *labels, *(f"p:{x}" for x in self.path.split("/")[:-1] if x)})


def _literal(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_/-])", r"\\\1", text)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    part = lambda n: F.coalesce(F.regexp_extract(url, _URL, n), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct host labels and path segments, and the token that all URLs have."""
    named = lambda text, by, kind: F.transform(F.filter(F.split(text, by), lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    return F.array_distinct(F.concat(F.array(F.lit(_ANY)), named(host, r"\.", "h:"), named(path, "/", "p:")))


def rule_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """One row for each rule and token, as literals of the plan."""
    rows = [
        F.struct(
            F.lit(n).alias("rule_no"), F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("rule_verdict"),
            F.lit(len(rule.host)).alias("host_length"), F.lit(rule.pattern).alias("pattern"), F.lit(token).alias("token"),
        )
        for n, rule in enumerate(rules)
        for token in rule.tokens
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def rarest_tokens(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule once, filed under the token that occurs least in ``urls(tokens)``."""
    wanted = rules.select("token").distinct()
    counts = (
        urls.select(F.explode("tokens").alias("token"))
        .join(F.broadcast(wanted), "token", "left_semi")
        .groupBy("token").count()
    )
    order = Window.partitionBy("rule_no").orderBy(F.coalesce("count", F.lit(0)), (F.col("token") == _ANY), "token")
    return (
        rules.join(F.broadcast(counts), "token", "left")
        .withColumn("place", F.row_number().over(order))
        .filter("place = 1").drop("place", "count")
    )


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], url_column: str = "url", keep: Sequence[str] = ("page_id",), default: str = "allow"
) -> DataFrame:
    """``keep``, host, path, rule (or null), verdict: one row for each given row.

    A URL that no rule fits gets ``default``. The rules are broadcast: there are at most
    ``BROADCAST_ROWS`` rows of (rule, token), which is checked.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(f"`{url_column}`").cast("string"))
    kept = [F.col(f"`{c}`").alias(f"_kept_{i}") for i, c in enumerate(keep)]
    urls = pages.select(*kept, host.alias("host"), path.alias("path")).withColumn("tokens", url_tokens(F.col("host"), F.col("path")))
    if not rules:
        judged = urls.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    else:
        if sum(len(rule.tokens) for rule in rules) > BROADCAST_ROWS:
            raise ValueError(f"more than {BROADCAST_ROWS} rows of rules and tokens")
        index = rarest_tokens(urls.select("tokens"), rule_frame(spark, rules))
        # One key for each row, so that no host or URL is a hot group; map-side sums leave about one row for each.
        tried = urls.withColumn("row", F.monotonically_increasing_id()).withColumn("token", F.explode("tokens")).drop("tokens")
        fits = F.expr("concat(host, path) rlike pattern")
        best = F.max(F.when(fits, F.struct(F.length("rule"), "host_length", F.col("rule_verdict") == "block", "rule", "rule_verdict")))
        same = [F.first(f"_kept_{i}").alias(f"_kept_{i}") for i in range(len(keep))]
        judged = (
            tried.join(F.broadcast(index), "token", "left")
            .groupBy("row").agg(*same, F.first("host").alias("host"), F.first("path").alias("path"), best.alias("best"))
            .withColumn("rule", F.col("best.rule"))
            .withColumn("verdict", F.coalesce(F.col("best.rule_verdict"), F.lit(default)))
        )
    return judged.select(*(F.col(f"_kept_{i}").alias(c) for i, c in enumerate(keep)), "host", "path", "rule", "verdict")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the fixed rules."""
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, [Rule.of(*rule) for rule in RULES])


ORACLE_SQL = r"""
WITH parts AS (
  SELECT row_number() OVER () AS row_no, page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(verdict, host, path) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fit AS (
  SELECT p.row_no, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
         arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM parts p JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.row_no)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fit f USING (row_no)
"""
