"""Request log summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import urls


def newest(df: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` requests, by a top-n without a full sort."""
    return df.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean and greatest duration, and errors of each group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg("duration_ms"), 0).cast("int").alias("mean_ms"), F.max("duration_ms").alias("max_ms"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def by_transport(df: DataFrame) -> DataFrame:
    return summary(df.withColumn("transport", F.when(F.col("used_proxy"), "proxy").otherwise("direct")), ["provider", "request_kind", "transport"])


def by_host(df: DataFrame) -> DataFrame:
    rows = df.withColumn("host", urls.host_key(F.col("url")))
    return rows.groupBy("host", "provider").agg(F.count(F.lit(1)).alias("n"), F.count_if("used_proxy").alias("proxied"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.max("created_at").alias("last_seen"))


def by_error(df: DataFrame, width: int = 180) -> DataFrame:
    return df.where("error is not null").groupBy("provider", "request_kind", F.substring("error", 1, width).alias("error")).agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last_seen"))


def by_proxy(df: DataFrame) -> DataFrame:
    label = F.coalesce(F.concat(F.lit("proxy-"), F.col("proxy_id").cast("string")), F.lit("unknown-proxy"))
    return summary(df.where("used_proxy").withColumn("proxy", label), ["proxy", "provider"])


def by_signal(df: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return df.where(F.col("request_kind").isin(*kinds)).groupBy("request_kind", "provider").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last_seen"))
