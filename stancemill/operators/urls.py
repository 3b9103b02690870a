"""Public suffixes and domains of hosts by a table of rules, with wildcards and exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancemill.functions import text as T

IPV4 = r"^\d{1,3}(\.\d{1,3}){3}$"


def host_suffixes(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, suffix, domain) of each different host of hosts (host).

    rules (rule) are as in public lists: "com", "co.uk", "*.ck" (any one label below ck) and "!www.ck" (no suffix, though a
    wildcard has it). An exception goes before the longest rule. A host of which no rule holds has an empty suffix
    and its last label as its domain; an address is its own domain; a host that is a suffix has an empty domain. Each
    host's ends are looked up by a join, whatever the number of rules.
    """
    h = hosts.select(F.rtrim(F.col("host"), F.lit(".")).alias("name"), "host").filter("host is not null").distinct()
    labels = F.split("name", r"\.")
    h = h.withColumn("labels", labels).withColumn("n", F.size("labels"))
    ends = h.filter(~F.col("name").rlike(IPV4)).select("host", "n", "labels", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    end = F.array_join(F.slice("labels", F.col("i"), F.col("n")), ".")
    below = F.array_join(F.slice("labels", F.col("i") + 1, F.col("n")), ".")
    # A rule and how many labels the suffix has where it holds; an exception's has one less than its own.
    looked = F.array(
        F.struct(end.alias("rule"), F.lit(False).alias("exception"), (F.col("n") - F.col("i") + 1).alias("size")),
        F.struct(F.concat(F.lit("*."), below).alias("rule"), F.lit(False).alias("exception"), (F.col("n") - F.col("i") + 1).alias("size")),
        F.struct(F.concat(F.lit("!"), end).alias("rule"), F.lit(True).alias("exception"), (F.col("n") - F.col("i")).alias("size")),
    )
    known = rules.select(F.lower(F.trim("rule")).alias("_rule")).distinct()
    best = ends.select("host", F.inline(looked)).join(known, F.col("rule") == F.col("_rule")).groupBy("host").agg(F.max(F.struct("exception", "size")).alias("best")).select(F.col("host").alias("_host"), F.col("best.size").alias("size"))
    size = F.coalesce("size", F.lit(0))
    named = F.when(F.col("name").rlike(IPV4), F.col("name")).otherwise(F.coalesce(F.try_element_at("labels", F.when(size < F.col("n"), -size - 1)), F.lit("")))
    return h.join(best, F.col("host") == F.col("_host"), "left").select("host", F.array_join(F.slice("labels", F.col("n") - size + 1, size), ".").alias("suffix"), named.alias("domain"))


def with_suffixes(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with _tld and _domain of their url's host by host_suffixes; nulls where there is no host."""
    p = pages.withColumn("_h", T.host(F.col(url_col)))
    found = host_suffixes(p.select(F.col("_h").alias("host")), rules)
    return p.join(found, F.col("_h") == F.col("host"), "left").withColumnsRenamed({"suffix": "_tld", "domain": "_domain"}).drop("_h", "host")
