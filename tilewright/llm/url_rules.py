"""URL filter lists as a sort-merge range join, in DataFrame operations only.

A rule (host, path) fits its host and all subdomains where the url's path
starts with the rule's. With labels reversed and closed by a dot
(``com.example.``), a host fits a rule host exactly if its key starts with the
rule's key. Paths are compared by prefixes of the lengths that occur in rules,
so with the key ``length | path prefix | reversed host`` each rule is one
interval of keys, and intervals are nested or disjoint.

Distinct keys are range-partitioned. Within a partition the intervals' ends
and starts and the keys are sorted together and swept: the number of open
intervals is the height of a stack, and the rule on top of a key is the last
one that was opened at the key's height. A rule whose interval reaches over
several partitions is opened in each of them. Of the rules found for the
different path lengths, the longest (host and path together, then the longer
host) wins.

Hot hosts do not matter to the sweep, since keys are distinct; the join back to
the urls is by host and path prefix, left to adaptive splitting.

A null url, and one without ``://``, has an empty host and path and no rule.
Rules with a null host or path are void; rules of equal host and path count as
one, blocking if any of them blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.shared import written

KEYS_PER_RANGE = 200_000
DEFAULT_VERDICT = "allow"


def split_url(urls: DataFrame) -> DataFrame:
    """Adds ``host`` and ``path``."""
    rest = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return urls.withColumn("_rest", F.expr(f"coalesce({rest}, '')")).withColumns({
        "host": F.expr(f"translate(regexp_extract(_rest, '^[^/?#]*', 0), '{upper}', '{lower}')"),
        "path": F.expr("regexp_extract(_rest, '^[^/?#]*([^?#]*)', 1)"),
    }).drop("_rest")


def _key(length: str, prefix: str, host: str) -> str:
    # A letter that sorts like a number of any size: digits are led by their count.
    return f"concat(chr(96 + length(CAST({length} AS STRING))), {length}, {prefix}, '.', array_join(reverse(split({host}, '[.]')), '.'), '.')"


def _intervals(rules: DataFrame) -> DataFrame:
    """``lo, hi, host, path, verdict``: keys k with lo <= k < hi fit the rule."""
    one = rules.filter("host IS NOT NULL AND path IS NOT NULL").groupBy("host", "path").agg(
        F.expr("CASE WHEN bool_or(verdict = 'block') THEN 'block' ELSE min(verdict) END AS verdict")
    )
    keyed = one.withColumn("lo", F.expr(_key("length(path)", "path", "host")))
    # The dot at the end gives way to the next character, the slash.
    return keyed.withColumn("hi", F.expr("concat(substr(lo, 1, length(lo) - 1), '/')"))


def _swept(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """``key, rule, verdict, host_chars, chars`` of the innermost rule of each distinct key that has one."""
    n = keys.count()
    ranges = max(1, -(-n // KEYS_PER_RANGE))
    placed = written(
        keys.repartitionByRange(ranges, "key").withColumn("part", F.expr("spark_partition_id()")), "url-ranges"
    )
    # First and last key of each range; as many rows as ranges.
    edges = placed.groupBy("part").agg(F.expr("min(key) AS lowest"), F.expr("max(key) AS highest"))
    edges = edges.agg(F.expr("array_sort(collect_list(struct(lowest, highest, part))) AS edges"))
    reach = rules.withColumn("edges", edges.scalar()).selectExpr(
        "lo", "hi", "host", "path", "verdict",
        "explode(filter(edges, e -> e.highest >= lo AND e.lowest < hi)) AS e",
    ).selectExpr(
        "e.part AS part", "lo", "hi", "struct(concat(host, path) AS rule, verdict, length(host) AS host_chars, length(concat(host, path)) AS chars) AS r",
    )
    events = (
        reach.selectExpr("part", "lo AS key", "1 AS kind", "1 AS step", "r")
        .unionByName(reach.selectExpr("part", "hi AS key", "0 AS kind", "-1 AS step", "r"))
        .unionByName(placed.selectExpr("part", "key", "2 AS kind", "0 AS step", "NULL AS r"))
    )
    # Ends come before starts, and starts before keys, at the same place.
    height = events.withColumn("height", F.expr("sum(step) OVER (PARTITION BY part ORDER BY key, kind ROWS UNBOUNDED PRECEDING)"))
    top = height.withColumn("top", F.expr(
        "last(CASE WHEN kind = 1 THEN r END, true) OVER (PARTITION BY part, height ORDER BY key, kind ROWS UNBOUNDED PRECEDING)"
    ))
    return top.filter("kind = 2 AND height > 0").selectExpr("key", "top.*")


def judged_urls(urls: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """``urls`` with ``host, path, rule, verdict``; ``rules`` has host, path and verdict.

    ``urls`` needs a column ``url``; columns that have one of the four names are
    replaced, all others stay. Without rules every url gets the default. Rule
    tables are lists a person keeps: their distinct path lengths are collected.
    """
    rules = written(_intervals(rules), "url-rules")
    lengths = sorted(r[0] for r in rules.selectExpr("length(path) AS n").distinct().collect())
    longest = max(lengths, default=0)
    # All columns ride along in one, so that no name can clash.
    whole = urls.select(F.struct(*[F.col(f"`{c}`") for c in urls.columns]).alias("_row"), "url")
    named = split_url(whole).withColumn("prefix", F.expr(f"substr(path, 1, {longest})"))
    listed = ", ".join(map(str, lengths))
    sites = named.filter("host <> ''").select("host", "prefix").distinct()
    probes = sites.withColumn("n", F.expr(f"explode(filter(CAST(array({listed}) AS ARRAY<INT>), n -> n <= length(prefix)))"))
    probes = written(probes.selectExpr("host", "prefix", _key("n", "substr(prefix, 1, n)", "host") + " AS key"), "url-sites")
    found = _swept(probes.select("key").distinct(), rules)
    best = probes.join(found, "key").groupBy("host", "prefix").agg(
        F.expr("max_by(struct(rule, verdict), struct(chars, host_chars, verdict, rule)) AS best")
    )
    best = best.withColumnsRenamed({"host": "_host", "prefix": "_prefix"})
    out = named.join(best, (named["host"] == best["_host"]) & (named["prefix"] == best["_prefix"]), "left")
    own = [F.col("_row")[c].alias(c) for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    return out.select(*own, "host", "path", F.expr("best.rule AS rule"), F.expr(f"coalesce(best.verdict, '{default}') AS verdict"))
