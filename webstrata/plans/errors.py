"""Audit of failed responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as N

MEDIA = r"\.(m4r|pdf|jpe?g|png|gif|webp|svg|bmp|tiff?|mp3|mp4|mov|ogg|webm)([?#]|$)|/(multimedia|images|downloads)/"


def percent(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part * 100.0, whole), 6)


def share_of_total(n: str = "n") -> Column:
    """Percent of the column's total; only for frames already reduced to a few groups."""
    return percent(F.col(n), F.sum(n).over(W.partitionBy()))


def status_summary(resources: DataFrame) -> DataFrame:
    """Per site, and for all together (NULL site): pages, failures, 404 rate and grade."""
    seen = resources.where(F.col("status") >= 100).select("site", "type", "status")
    counts = seen.rollup("site").agg(
        F.count_if(F.col("type") == "html").alias("pages"),
        F.count_if(F.col("status").between(400, 499)).alias("client_errors"),
        F.count_if(F.col("status") >= 500).alias("server_errors"),
        F.count_if(F.col("status") == 404).alias("not_found"))
    rate = percent(F.col("not_found"), F.col("pages"))
    grade = (F.when(rate < 0.5, "A").when(rate < 1, "B").when(rate < 2, "C")
             .when(rate <= 3, "D").when(rate > 3, "F"))
    return counts.select("*", rate.alias("rate"), grade.alias("grade"))


def errors_on_off_site(resources: DataFrame, domain: str) -> DataFrame:
    """404s on pages whose URL contains the domain, and all others."""
    return (resources.where(F.col("status") == 404)
            .groupBy(F.lower("url").contains(domain.lower()).alias("on_site"))
            .agg(F.count("*").alias("n"), F.countDistinct("site").alias("sites")))


def error_pattern(url: Column) -> Column:
    low = F.lower(url)
    return (F.when(low.rlike(r"[?&;](search_)?page=|/p/|[?&;]offset="), "pagination")
            .when(low.rlike(r"/(api|wp-json|rest|oembed)/"), "api")
            .when(low.rlike(MEDIA), "media")
            .when(low.startswith("http://"), "insecure")
            .otherwise("other"))


def error_patterns(resources: DataFrame) -> DataFrame:
    """Failure class of each 404, its share, and whether it dominates."""
    counts = (resources.where(F.col("status") == 404)
              .groupBy(error_pattern(F.col("url")).alias("pattern")).agg(F.count("*").alias("n")))
    return (counts.withColumn("share", share_of_total())
            .withColumn("dominant", F.col("share") >= 50))


def host_relation(host: Column, domain: str) -> Column:
    """Place of a host relative to the audited domain."""
    domain = domain.lower()
    return (F.when(F.lower(host).isin(domain, f"www.{domain}"), "main")
            .when(F.lower(host).endswith(f".{domain}"), "subdomain").otherwise("external"))


def domain_breakdown(resources: DataFrame, domain: str) -> DataFrame:
    by_host = resources.groupBy(N.host(F.col("url")).alias("host")).agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == 404).alias("not_found"),
        F.count_if(F.col("url").startswith("http://")).alias("insecure"))
    return by_host.withColumn("relation", host_relation(F.col("host"), domain))
