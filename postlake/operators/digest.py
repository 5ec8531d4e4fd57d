"""The low-priority digest, running budgets and numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.links import suffixes
from ..limits import LIMITS, Limits
from ..sources.tables import settled


def low_digest(items: DataFrame, by: str, limits: Limits = LIMITS) -> DataFrame:
    """For each ``by``: the first items by id, grouped by category, largest first; totals count all items.

    ``items`` has id, category, headline and from_domain.
    """
    total = items.groupBy(by).agg(F.count("*").alias("total"))
    first = Window.partitionBy(by).orderBy("id")
    shown = items.withColumn("place", F.row_number().over(first)).where(F.col("place") <= limits.digest_items)
    line = F.concat(F.lit("• "), F.coalesce(F.nullif("headline", F.lit("")), F.lit("(no subject)")), F.lit(" ("), F.coalesce(F.nullif("from_domain", F.lit("")), F.lit("unknown")), F.lit(")"))
    category = F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("other"))
    groups = shown.withColumn("category", category).groupBy(by, "category").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    order = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "category"))
    return groups.withColumn("rank", order).join(total, by).withColumn("rest", F.greatest(F.col("total") - limits.digest_items, F.lit(0)))


def daily_bucket(ts: Column, hour: int = 18) -> Column:
    """The day whose digest, sent at ``hour``, an arrival belongs to."""
    return F.date_trunc("day", ts.cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hour))).cast("date")


def sums_before(rows: DataFrame, by: str, order: list[str], measure: Column, name: str = "before", parts: int | None = None) -> DataFrame:
    """``rows`` with the sum of ``measure`` over the earlier rows of their group, however large a group is.

    Rows are dealt by range of group and order and written once. Each range sums its own part of a group; what lies
    before it comes from the sums of the ranges before, of which only the groups that a border cuts need any: fewer than there are borders.
    ``parts`` is the number of ranges, that of shuffles unless given.
    """
    ranged = rows.withColumn("_m", measure).repartitionByRange(*([parts] if parts else []), by, *order)
    dealt = settled(ranged.withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy(F.col(by).alias("_by"), "_part").agg(F.sum("_m").alias("_sum"))
    cut = sums.groupBy("_by").agg(F.array_sort(F.collect_list(F.struct("_part", "_sum"))).alias("_runs")).where(F.size("_runs") > 1)
    earlier = lambda r: F.aggregate(F.filter("_runs", lambda x: x["_part"] < r["_part"]), F.lit(0).cast("long"), lambda total, x: total + F.coalesce(x["_sum"], F.lit(0)))
    offsets = cut.select("_by", F.explode(F.transform("_runs", lambda r: F.struct(r["_part"].alias("_of"), earlier(r).alias("_offset")))).alias("o")).select("_by", "o.*")
    own = Window.partitionBy("_part", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn(name, F.coalesce(F.sum("_m").over(own), F.lit(0)))
    out = local.join(F.broadcast(offsets), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_of")), "left")  # two rows a border at most
    return out.withColumn(name, F.col(name) + F.coalesce("_offset", F.lit(0))).select(*rows.columns, name)


def running_budget(rows: DataFrame, by: str, order: list[str], text: str, budget: int) -> DataFrame:
    """Texts in order, cut where the budget of their group ends."""
    left = F.greatest(F.lit(budget) - F.col("_before"), F.lit(0))
    out = sums_before(rows, by, order, F.length(text), "_before").withColumn("left", left).drop("_before").withColumn("cut", F.length(text) > F.col("left"))
    return out.withColumn("kept", F.when(F.col("cut"), F.rtrim(F.left(F.col(text), F.col("left").cast("int")))).otherwise(F.col(text)))


def number_links(links: DataFrame, by: str, order: list[str], limits: Limits = LIMITS) -> DataFrame:
    """Links numbered within their mail; only the first count singly and fewer are listed."""
    numbered = sums_before(links, by, order, F.lit(1), "_before").withColumn("link_no", (F.col("_before") + 1).cast("int")).drop("_before")
    return numbered.withColumn("capped", F.col("link_no") > limits.links).withColumn("listed", F.col("link_no") <= limits.links_listed)


def footnotes(numbered: DataFrame, by: str, limits: Limits = LIMITS) -> DataFrame:
    """The listed links of each mail as far as the footnote has room."""
    entry = F.concat(F.lit("#"), F.col("link_no").cast("string"), F.lit(": "), F.col("defanged"))
    upto = Window.partitionBy(by).orderBy("link_no").rowsBetween(Window.unboundedPreceding, 0)
    fit = numbered.where("listed").withColumn("entry", entry).withColumn("used", F.sum(F.length("entry") + 1).over(upto))
    return fit.groupBy(by).agg(
        F.count_if(F.col("used") <= limits.footnote_chars).alias("shown"),
        F.count_if(F.col("used") > limits.footnote_chars).alias("suppressed"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("used") <= limits.footnote_chars, F.struct("link_no", "entry")))), lambda x: x["entry"]), "\n").alias("lines"),
    )


def commands(updates: DataFrame, chat: str) -> DataFrame:
    """The commands of one chat: first word, lower case, without the bot's name."""
    word = F.regexp_replace(F.lower(F.split(F.trim("text"), r"\s+")[0]), r"@.*$", "")
    return updates.where(F.col("chat_id") == chat).withColumn("command", word).where(F.col("command").isin("/digest", "/status"))


def suffix_lookup(rows: DataFrame, host: str, directory: DataFrame, small: int = 100_000) -> DataFrame:
    """Each row with the provider of its host's longest known parent domain.

    Hosts are looked up once each. ``directory(domain, provider)`` is broadcast only if it has at most ``small`` rows.
    """
    known = F.broadcast(directory) if directory.limit(small + 1).count() <= small else directory
    hosts = rows.select(F.col(host).alias("looked_up")).distinct()
    spread = hosts.select("looked_up", F.posexplode(suffixes(F.col("looked_up"))).alias("depth", "domain"))
    best = spread.join(known, "domain").groupBy("looked_up").agg(F.min_by("provider", "depth").alias("provider"), F.min_by("domain", "depth").alias("matched"))
    return rows.join(best, F.col(host) == F.col("looked_up"), "left").drop("looked_up")
