"""URL filters by a sorted sweep over reversed-host keys (DataFrame functions only).

A rule names a host and the beginning of a path; it fits its host and all subdomains.  Written with its labels reversed,
a host and its subdomains are one interval of sorted keys: ``org.example.`` up to, not including,
``org.example/``.  Such intervals are nested or apart, as are those of path beginnings.  So a sweep over the
sorted union of rules and URLs needs one stack: the rules whose interval is still open.  Here the stack that each rule
opens (itself and the rules around it) is a column, a URL takes the stack of the last rule before it, and pops
those that have ended, which are those that are not a beginning of its key.

Two sweeps follow each other: over hosts, which leaves the rule hosts around a URL's host, and, within each of those, over
paths.  Sweeps run over distinct URLs, in groups that are salted by a hash of the URL, each with its own copy of the
group's rules; so a host, domain or rule that a third of all URLs share is swept by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels in reverse, a dot after each, so that the key of a host begins those of its subdomains."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _nested(rules: DataFrame, group: list[str], key: str, item: str) -> DataFrame:
    """(group, key, stack): the items of the rules whose key begins this one's, the shortest first, its own last.

    Every beginning of a key is looked up among the keys, so rules of any number are matched by an equi-join.
    """
    mine = rules.select(*group, key, F.explode(F.sequence(F.lit(0), F.length(key))).alias("n")) \
        .withColumn("__outer", F.expr(f"substring({key}, 1, n)")).select(*group, key, "__outer")
    outer = rules.select(*group, F.col(key).alias("__outer"), F.col(item).alias("__item"))
    return (mine.join(outer, [*group, "__outer"]).groupBy(*group, key)
            .agg(F.sort_array(F.collect_list(F.struct(F.length("__outer").alias("n"), F.col("__outer").alias("key"),
                                                      F.col("__item").alias("item")))).alias("stack")))


def _sweep(points: DataFrame, opened: DataFrame, group: list[str], key: str, salts: int, point_hash: str) -> DataFrame:
    """``points`` with ``stack``: what of ``opened`` is open at their key.  ``group`` must not be null in ``opened``."""
    copies = opened.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))) \
        .select(*group, F.col(key).alias("__key"), "__salt", F.lit(0).alias("__turn"), F.col("stack").alias("__open"))
    asked = points.withColumn("__salt", F.pmod(F.xxhash64(point_hash), F.lit(salts))).withColumn("__key", F.col(key)) \
        .withColumn("__turn", F.lit(1))
    order = Window.partitionBy(*group, "__salt").orderBy("__key", "__turn").rowsBetween(Window.unboundedPreceding, 0)
    return (asked.unionByName(copies, allowMissingColumns=True)
            .withColumn("__last", F.last("__open", ignorenulls=True).over(order)).where("__turn = 1")
            .withColumn("stack", F.filter("__last", lambda rule: F.col("__key").startswith(rule["key"])))
            .drop("__salt", "__key", "__turn", "__open", "__last"))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``rules``: host, path, verdict (strings).  A rule fits its host and all subdomains if the URL's path begins with the
    rule's.  The longest host and path together win, of equal ones the longer host.  Of rules with the same host
    and path the smaller verdict holds ("allow" before "block").  A rule with a null or empty host, or a null
    path, is ignored.  A URL that no rule fits has a null rule and the verdict ``otherwise``.  A null URL, or one without
    ``://``, has an empty host and path.  All rows of ``pages`` return, in any number; a column that has the
    name of a new one gives way.
    """
    salts = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rules = (rules.where("host != '' and path is not null")
             .select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
             .groupBy("host", "path").agg(F.min("verdict").alias("verdict")))
    top = F.substring_index("host_key", ".", 1).alias("top")
    rule_hosts = rules.select("host", host_key(F.col("host")).alias("host_key")).distinct().select("*", top)

    urls = pages.select(F.coalesce(F.col(url_col), F.lit("")).alias("url")).distinct()
    urls = urls.select("url", path_of(F.col("url")).alias("path"), host_key(host_of(F.col("url"))).alias("host_key")).select("*", top)
    around = _sweep(urls, _nested(rule_hosts, ["top"], "host_key", "host"), ["top"], "host_key", salts, "url")
    held = around.select("url", "path", F.explode("stack.item").alias("host"))
    fits = (_sweep(held, _nested(rules, ["host"], "path", "verdict"), ["host"], "path", salts, "url")
            .where(F.size("stack") > 0).withColumn("inner", F.element_at("stack", -1)))
    rank = F.struct((F.length("host") + F.col("inner.n")).alias("n"), F.length("host").alias("m"),
                    F.concat("host", "inner.key").alias("rule"), F.col("inner.item").alias("verdict"))
    best = fits.groupBy(F.col("url").alias("__url")).agg(F.max(rank).alias("__best"))

    own = [F.col(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    url = F.coalesce(F.col(url_col), F.lit(""))
    return (pages.select(*own, url.alias("__own")).join(best, F.col("__own") == F.col("__url"), "left")
            .select(*own, host_of(F.col("__own")).alias("host"), path_of(F.col("__own")).alias("path"),
                    F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(otherwise)).alias("verdict")))
