"""Which pages a site's robots.txt lets an agent fetch."""

from __future__ import annotations

from functools import lru_cache
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgrain.functions import urls


@lru_cache(maxsize=1000)
def _rules(text: str) -> RobotFileParser:
    p = RobotFileParser()
    p.parse(text.splitlines())
    return p


def permitted(pages: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """pages with `allowed`. robots: host, robots (the file's text); a host without a file allows everything.

    Hosts are joined, so the files may be as many as the hosts; a file is parsed once a task.
    """

    @F.pandas_udf(T.BooleanType())
    def ask(text: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([t is None or u is None or _rules(t).can_fetch(agent, u) for t, u in zip(text, url, strict=True)])

    j = pages.withColumn("_host", urls.host(F.col("url"))).join(robots.select(F.col("host").alias("_host"), "robots"), "_host", "left")
    return j.withColumn("allowed", ask("robots", "url")).drop("_host", "robots")


def outcomes(pages: DataFrame, known_hashes: DataFrame, excluded: list[str]) -> DataFrame:
    """pages with `outcome`: skipped (not allowed), unchanged (its content is known), excluded (below a prefix) or ingested.

    pages: url, html, allowed; known_hashes: content_hash.
    """
    known = known_hashes.select("content_hash").distinct().withColumn("_known", F.lit(True))
    p = pages.withColumn("content_hash", F.sha2(F.coalesce("html", F.lit("")), 256)).join(known, "content_hash", "left")
    what = F.when(~F.col("allowed"), "skipped").when(F.col("_known"), "unchanged").when(urls.under_prefix(F.col("url"), excluded), "excluded").otherwise("ingested")
    return p.withColumn("outcome", what).drop("_known")
