"""URL filters: host-suffix and path-prefix expressions joined to rules by digest.

Every url is expanded into (host suffix, path prefix) expressions, the expressions are
equi-joined to the rules on the first hex digits of their SHA-256, and a match counts once the
whole digests and the rule's full path agree. Native DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh

#: Hex digits of the digest that the join is on; collisions are removed by the full digest.
PREFIX_DIGITS = 8


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``.

    ``rules(rule_host, rule_path, action)``. A rule fits its host and all subdomains when the
    url's path starts with the rule's path. The longest rule string wins; between equally long
    ones the longer host, then ``block``. Without a fitting rule the verdict is ``default``.

    Null urls and urls without ``://`` have empty host and path and get the default; rules with
    a null host, path or action are ignored; repeated pages each keep their row; an empty table gives an
    empty result; columns of ``pages`` named like the new ones are replaced.
    """
    out_names = ("host", "path", "rule", "verdict")
    pages = pages.drop(*[c for c in pages.columns if c.lower() in out_names and c != url_col])
    rules = (
        rules.select(
            ascii_lower(F.col("rule_host")).alias("r_host"), F.col("rule_path").alias("r_path"), F.col("action").alias("r_action")
        )
        .dropna()
        .withColumn("r_key", F.regexp_extract("r_path", r"^(?s)(.*/|)", 1))
        .withColumn("r_digest", _digest(F.col("r_host"), F.col("r_key")))
        .withColumn("r_short", F.substring("r_digest", 1, PREFIX_DIGITS))
    )
    # Expressions with more labels or slashes than any rule cannot match, so long urls stay short.
    most = rules.agg(F.max(_labels(F.col("r_host"))), F.max(_slashes(F.col("r_key")))).first()
    labels, slashes = int(most[0] or 0), int(most[1] or 0)

    hosts = F.split("host", r"\.")
    n = F.size(hosts)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(n, F.lit(max(labels, 1)))),
        lambda k: F.array_join(F.slice(hosts, n - k + 1, k), "."),
    )
    parts = F.split("path", "/")
    depth = F.least(_slashes(F.col("path")), F.lit(slashes))
    prefixes = F.concat(
        F.array(F.lit("")),
        F.when(
            depth > 0,
            F.transform(F.sequence(F.lit(1), depth), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/"))),
        ).otherwise(F.array().cast("array<string>")),
    )
    urls = pages.select(F.col(url_col).alias("u")).where("u is not null").distinct()
    urls = urls.withColumn("host", url_host(F.col("u"))).withColumn("path", url_path(F.col("u")))
    expressions = (
        urls.withColumn("suffix", F.explode(suffixes))
        .withColumn("prefix", F.explode(prefixes))
        .withColumn("digest", _digest(F.col("suffix"), F.col("prefix")))
        .select("u", "path", "digest", F.substring("digest", 1, PREFIX_DIGITS).alias("short"))
    )
    # The join is on the short prefix alone. Whole digests are equally long, so one that starts with the other equals it;
    # written as an equality, the optimiser would make the whole digest a second join key.
    confirmed = F.startswith("digest", "r_digest") & F.startswith("path", "r_path")
    matched = expressions.join(rules, F.col("short") == F.col("r_short")).where(confirmed)
    rule = F.concat("r_host", "r_path")
    best = matched.groupBy("u").agg(
        F.max(
            F.struct(F.length(rule).alias("len"), F.length("r_host").alias("host_len"), (F.col("r_action") == "block").alias("blocks"), rule.alias("rule"), F.col("r_action").alias("action"))
        ).alias("best")
    )
    key = fresh(pages, "url_key")
    best = best.select(F.col("u").alias(key), F.col("best.rule").alias("rule"), F.col("best.action").alias("verdict"))
    return (
        pages.join(best, pages[url_col] == best[key], "left")
        .drop(key)
        .withColumn("host", url_host(F.col(url_col)))
        .withColumn("path", url_path(F.col(url_col)))
        .withColumn("verdict", F.coalesce("verdict", F.lit(default)))
        .select(*pages.columns, *out_names)
    )
