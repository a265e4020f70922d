"""URL filters by a temporal list join, in DataFrame functions only.

A list is a log of dated entries ``(kind, pattern, action, dated)``: from its date on, a pattern is
blocked, allowed, or removed. Each entry becomes a validity interval that ends at the pattern's next
entry, and an as-of join evaluates every capture against the entries active at its fetch time. Patterns
are hosts, domains (that also match their subdomains), host and one or more leading path segments, and words
of the URL after its scheme, query and fragment included. Both sides are compared in lower case, and hosts
without user, port, final dot or leading ``www.``.

Intervals of one pattern don't overlap. They are laid out by month, and captures join on (kind, pattern,
month), so a host with a third of all captures, or a pattern with very many entries, is spread over its
months; intervals of a bounded count are broadcast. Captures are joined by a row key, not by their URLs.

Of the active entries that match a capture the most specific decides (longest path, host, longest domain, word);
of equally specific ones an allowing entry wins.

Cases: a null or hostless URL, or a null fetch time, matches nothing and is kept; entries with a null
date, kind or pattern are skipped; of entries of one pattern and date, removal wins over allowing, that
over blocking; an entry is active from its own instant on, and up to but not at the next one's; repeated
captures each get a row; an empty list keeps everything.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W

from exprmat.llm.common import BROADCAST_ROWS, pin, small_side

#: Specificity by kind; among domains the longer pattern is the more specific.
RANK = {"path": 4_000, "host": 3_000, "domain": 1_000, "word": 0}
FOREVER = "9999-12-31 00:00:00"


def _host(authority: Column) -> Column:
    """Lower-case host without user, port, final dot or leading ``www.``."""
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))
    return F.regexp_replace(F.regexp_replace(host, r"\.$", ""), r"^www\.", "")


def url_host(url: Column) -> Column:
    """Host of a URL as lists have it; null if the URL has none."""
    host = _host(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    return F.when(host != "", host)


def url_path(url: Column) -> Column:
    """Lower-case path without its first and last slashes; empty if there is none or its first segment is empty."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#][^?#]*)", 1)
    return F.lower(F.regexp_replace(path, r"/+$", ""))


def list_pattern(kind: Column, pattern: Column) -> Column:
    """The pattern of a list entry in the form of :func:`url_keys`."""
    path = F.lower(F.regexp_replace(F.regexp_extract(pattern, r"^[^/]*(/.*)$", 1), r"/+$", ""))
    host = _host(F.regexp_extract(pattern, r"^([^/]*)", 1))
    return (F.when(kind.isin("host", "domain"), _host(pattern)).when(kind == "path", F.concat(host, path))
            .otherwise(F.lower(pattern)))


def url_keys(url: Column) -> Column:
    """The ``(kind, pattern)`` keys that a list entry for this URL may have."""
    host, path = url_host(url), url_path(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)

    def key(kind: str, pattern: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"))

    # every suffix of two labels or more, the host itself included
    domains = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: key(
        "domain", F.array_join(F.slice(labels, i, n - i + 1), "."))))
    none = F.array().cast("array<struct<kind:string,pattern:string>>")
    segments = F.split(path, "/")
    # every prefix of the path's segments
    paths = F.when(path != "", F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: key(
        "path", F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")))))
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*((?s:.*))$", 1)
    words = F.array_distinct(F.array_remove(F.split(F.lower(F.concat(host, rest)), r"[^a-z0-9]+"), ""))
    parts = [
        F.array(key("host", host)),
        F.coalesce(domains, none),
        F.coalesce(paths, none),
        F.transform(words, lambda w: key("word", w)),
    ]
    return F.when(host.isNotNull(), F.concat(*parts)).otherwise(none)


def intervals(entries: DataFrame) -> DataFrame:
    """``kind, pattern, action, begins, ends`` of the blocking and allowing entries."""
    order = F.when(F.col("action") == "remove", 0).when(F.col("action") == "allow", 1).otherwise(2)
    dated = (entries.where("kind is not null and pattern is not null and dated is not null")
             .select(F.lower("kind").alias("kind"), list_pattern(F.lower("kind"), F.col("pattern")).alias("pattern"), "dated", F.lower("action").alias("action"))
             .groupBy("kind", "pattern", "dated").agg(F.min_by("action", order).alias("action")))
    each = W.partitionBy("kind", "pattern").orderBy("dated")
    return (dated.withColumn("ends", F.coalesce(F.lead("dated").over(each), F.lit(FOREVER).cast("timestamp")))
            .where(F.col("action").isin("block", "allow"))
            .select("kind", "pattern", "action", F.col("dated").alias("begins"), "ends"))


def _month(t: Column) -> Column:
    return F.year(t) * 12 + F.month(t)


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched_at") -> DataFrame:
    """Per capture: ``page_id, url, host, fetched_at, kept, verdict, kind, pattern, n_active``."""
    rows = captures.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(at_col).cast("timestamp").alias("fetched_at"))
    asked = rows.where("url is not null and fetched_at is not null").select("url", "fetched_at").distinct()
    keys = asked.select("url", "fetched_at", _month(F.col("fetched_at")).alias("month"), F.explode(url_keys(F.col("url"))).alias("k")).select(
        F.xxhash64("url").alias("u"), F.xxhash64(F.reverse("url")).alias("v"), "fetched_at", "month", "k.kind", "k.pattern")
    span = pin(intervals(entries), "url-intervals")
    # months that a capture can have bound the layout of intervals that never end
    last = asked.agg(F.max(_month(F.col("fetched_at")))).first()[0] or 0
    laid = (span.where(_month(F.col("begins")) <= last)
            .withColumn("month", F.explode(F.sequence(_month(F.col("begins")), F.least(_month(F.col("ends")), F.lit(last))))))
    laid = pin(laid, "url-months")
    rank = (F.element_at(F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv)), F.col("kind")) + F.length("pattern"))
    active = (keys.join(small_side(laid, laid.count(), BROADCAST_ROWS), ["kind", "pattern", "month"])
              .where((F.col("fetched_at") >= F.col("begins")) & (F.col("fetched_at") < F.col("ends"))))
    best = F.max(F.struct(rank.alias("rank"), (F.col("action") == "allow").alias("allow"), "kind", "pattern"))
    # a row per capture and active entry, combined map-side
    decided = pin(active.groupBy("u", "v", "fetched_at").agg(best.alias("best"), F.count("*").alias("n_active"))
                  .select("u", "v", F.col("fetched_at").alias("t"), "best", "n_active"), "url-decided")
    out = rows.withColumn("hu", F.xxhash64("url")).withColumn("hv", F.xxhash64(F.reverse("url")))
    on = (F.col("hu") == F.col("u")) & (F.col("hv") == F.col("v")) & (F.col("fetched_at") == F.col("t"))
    out = out.join(small_side(decided, decided.count(), BROADCAST_ROWS // 10), on, "left")
    verdict = F.when(F.col("best").isNull(), "unlisted").when(F.col("best.allow"), "allowed").otherwise("blocked")
    return out.select("page_id", "url", url_host(F.col("url")).alias("host"), "fetched_at", (verdict != "blocked").alias("kept"),
                      verdict.alias("verdict"), F.col("best.kind").alias("kind"), F.col("best.pattern").alias("pattern"),
                      F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"))
