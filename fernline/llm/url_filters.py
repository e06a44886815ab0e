"""URL filters: host-suffix and path-prefix expressions, hash-prefix join, digest confirmation, precedence.

Every URL is expanded into the expressions (host suffix, path prefix) that a rule of the given
shapes could have; the expressions meet the rules in an equi-join on a short prefix of their
SHA-256 digests; only pairs whose full digests agree count. Of a URL's rules the longest
(host and path together) wins, at equal length the one with the longer host, then a block.

Defined cases: a null URL, or one without ``://``, has an empty host and path and gets the default
verdict; rows may repeat, each is judged; URLs of any length are taken whole; an empty rule table gives every row the default; columns
of the input with the names of the results are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, durable, finished, small

#: Hex digits of the digest that the join compares before full digests are confirmed.
PREFIX_HEX = 8
#: Up to so many rules (counted) are broadcast; beyond it the join shuffles, with SALTS copies of each rule.
BROADCAST_RULES = 100_000
SALTS = 32
#: Up to so many judged places (counted) are broadcast back to the rows; more are joined by a shuffle.
BROADCAST_PLACES = 200_000
#: Up to so many shapes (labels of the host, length of the path) the expansion follows the rules'
#: shapes; beyond it every suffix and prefix is expanded, which finds the same rules.
MAX_SHAPES = 4096

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, _URL, 1), UPPER, UPPER.lower()), F.regexp_extract(url, _URL, 2)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    known = (
        rules.select(F.translate("host", UPPER, UPPER.lower()).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict"))
        .where(F.length("r_host") > 0)
        .distinct()
        .withColumn("digest", _digest(F.col("r_host"), F.col("r_path")))
        .withColumn("hash", F.substring("digest", 1, PREFIX_HEX))
    )
    shapes = [(r[0], r[1]) for r in known.select(F.size(F.split("r_host", r"\.")), F.length("r_path")).distinct().limit(MAX_SHAPES + 1).collect()]
    labels = F.split("host", r"\.")
    if len(shapes) > MAX_SHAPES:
        wanted = F.flatten(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.struct(k.alias("labels"), n.alias("chars")))))
    elif shapes:
        wanted = F.filter(F.array(*[F.struct(F.lit(k).alias("labels"), F.lit(n).alias("chars")) for k, n in sorted(shapes)]), lambda s: (s["labels"] <= F.size(labels)) & (s["chars"] <= F.length("path")))
    else:
        wanted = F.expr("cast(array() as array<struct<labels:int,chars:int>>)")

    def expression(s: Column) -> Column:
        return F.struct(F.array_join(F.slice(labels, -s["labels"], s["labels"]), ".").alias("host"), F.substring(F.col("path"), F.lit(1), s["chars"]).alias("path"))

    # A verdict depends on host and path alone, so repeated URLs are folded before the expansion.
    places = urls.select("host", "path").where(F.length("host") > 0).distinct()
    spread = (
        places.select("host", "path", F.explode(F.transform(wanted, expression)).alias("e"))
        .withColumn("u_digest", _digest(F.col("e.host"), F.col("e.path")))
        .withColumn("hash", F.substring("u_digest", 1, PREFIX_HEX))
        .drop("e")
    )
    keys = ["hash"]
    if known.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        known = small(known, BROADCAST_RULES)
    else:
        # A common host's expression may hold a third of all rows: deal it over SALTS copies of the rule.
        spread = spread.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)))
        known = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        keys = ["hash", "salt"]
    met = spread.join(known, keys).where(F.col("u_digest") == F.col("digest"))
    rank = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), (F.col("r_verdict") == "block").cast("int"))
    best = durable(met.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), rank).alias("best")))
    # URLs without a host, of which there may be any number, meet no rule and need no join.
    judged = urls.where(F.length("host") > 0).join(small(best, BROADCAST_PLACES), ["host", "path"], "left")
    nowhere = urls.where(F.length("host") == 0).withColumn("best", F.lit(None).cast(best.schema["best"].dataType))
    return judged.unionByName(nowhere).select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Return id, host, path, rule and verdict for each row of ``pages``.

    ``rules`` has host, path and verdict (``allow`` or ``block``); rows with a null or empty host are no rules.
    """
    return finished(pages.sparkSession, lambda: _judge_urls(pages, rules, id_col, url_col, default))
