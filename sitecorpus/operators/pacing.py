"""How requests to a host are spaced out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitecorpus.checkpoints import cut
from sitecorpus.functions import urls
from sitecorpus.operators.running import WIDTH, running_sum


def request_gap(delay: float, crawl_delay: Column, respect: bool = True) -> Column:
    """Seconds between two requests to a host, without jitter."""
    return F.greatest(F.lit(delay), F.coalesce(crawl_delay, F.lit(0.0))) if respect else F.lit(delay)


def back_off(status: Column, delay: float, max_delay: float) -> Column:
    """Extra seconds after a server error."""
    return F.when(status.between(500, 599), F.lit(min(2 * delay, max_delay))).otherwise(F.lit(0.0))


def fetch_schedule(
    requests: DataFrame,
    policies: DataFrame,
    delay: float = 1.0,
    respect: bool = True,
    max_delay: float | None = None,
    width: int = WIDTH,
) -> DataFrame:
    """Add ``netloc`` and ``start``, the earliest second each request can start.

    ``requests`` holds ``seq, url`` and, if ``max_delay`` is given, the
    ``status`` whose back-off delays the requests after it.  Each host has its
    own clock; the first request waits only its site's crawl delay.
    """
    paced = urls.with_url_parts(requests, "url", "u_")
    paced = paced.withColumn("site", urls.site_key(F.col("u_scheme"), F.col("u_netloc")))
    paced = paced.join(policies.select("site", "crawl_delay"), "site", "left")
    wait = F.coalesce("crawl_delay", F.lit(0.0)) if respect else F.lit(0.0)
    extra = back_off(F.col("status"), delay, max_delay) if max_delay is not None else F.lit(0.0)
    paced = cut(
        paced.select(
            "seq",
            "url",
            F.col("u_netloc").alias("netloc"),
            request_gap(delay, F.col("crawl_delay"), respect).alias("gap"),
            wait.alias("wait"),
            extra.alias("extra"),
        ),
        "paced",
    )
    # The first request of a host starts after its wait, all others a gap after the one before.
    first = paced.groupBy("netloc").agg(F.min_by(F.col("wait") - F.col("gap"), "seq").alias("shift"))
    # Whole microseconds, so that the order of addition cannot show.
    micros = F.round((F.col("gap") + F.col("extra")) * 1_000_000).cast("long")
    summed = running_sum(paced, ["netloc"], "seq", micros, "upto", width)
    return summed.join(first, "netloc").select(
        "netloc", "seq", "url", (F.col("upto") / 1_000_000 - F.col("extra") + F.col("shift")).alias("start")
    )


def finish_times(schedule: DataFrame) -> DataFrame:
    """Requests and the last start per host; hosts run side by side."""
    return schedule.groupBy("netloc").agg(F.count("*").alias("requests"), F.max("start").alias("finish"))
