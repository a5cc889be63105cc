"""A library of texts by id that fetches what it lacks, once (SRC-13, SNK-12, MDL-8)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.storage import saved

from . import files, pacing, shared

#: fetch(id) gives a text, or null or an exception where it has none.
Fetch = Callable[[str], str | None]


def held(spark: SparkSession, path: str) -> DataFrame:
    """SRC-13: arxiv and text of all that the library holds; nothing where it isn't there yet."""
    try:
        return files.library(spark, path)
    except AnalysisException:
        return spark.createDataFrame([], "arxiv string, text string")


def read_through(ids: DataFrame, path: str, fetches: list[tuple[str, Fetch]], pace: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Texts (arxiv, text) of ids (arxiv), and what became of each miss (arxiv, origin, error).

    An id that the library lacks is fetched once: each fetch (a page's text, then a PDF's) is tried until one has a text,
    which is written as a file of its own, whole or not at all; a failed one leaves none.  Requests start at most every
    pace seconds, all tasks together.
    """
    spark = ids.sparkSession
    wanted = ids.select("arxiv").where("arxiv IS NOT NULL").distinct()
    misses = wanted.join(held(spark, path).select("arxiv"), "arxiv", "left_anti")
    plan = pacing.Plan.now(pace)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turns = plan.turns()
        for pdf in batches:
            out = []
            for key in pdf["arxiv"]:
                origin, error = None, "no text"
                at = f"{path.rstrip('/')}/arxiv-{quote(key, safe='')}.txt"
                if shared.read(at) is not None:  # an earlier attempt of this task
                    origin, error = "library", None
                for name, fetch in fetches if origin is None else []:
                    next(turns)
                    try:
                        text = fetch(key)
                    except Exception as e:  # noqa: BLE001  an outage is a row, and the next fetch is tried
                        error = f"{name}: {type(e).__name__}"
                        continue
                    if text:
                        shared.write(at, text.encode())
                        origin, error = name, None
                        break
                out.append((key, origin, error))
            yield pd.DataFrame(out, columns=["arxiv", "origin", "error"])

    dealt = misses.repartition(plan.lanes(spark), "arxiv").sortWithinPartitions("arxiv").mapInPandas(run, "arxiv string, origin string, error string")
    fetched = saved(dealt)  # asked for once
    return held(spark, path).join(wanted, "arxiv", "left_semi"), fetched
