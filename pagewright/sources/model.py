"""Model calls behind one interface; tests and reruns use recorded answers joined by key."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ModelClient(Protocol):
    def __call__(self, prompt: str, image: bytes | None) -> str: ...


def ask(requests: DataFrame, client: Callable[[], ModelClient], attempts: int = 3, pause: float = 5.0, accept: Callable[[str, str], bool] | None = None) -> DataFrame:
    """(key, answer, error) of requests (key, prompt, image, source); ``client`` makes one per task.

    An answer that ``accept(answer, source)`` turns down is asked for again; the last one counts. A failure is a
    row with an error, never a failed task, so a retried task asks only for its own rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                answer = error = None
                for k in range(attempts):
                    try:
                        answer, error = call(r.prompt, r.image), None
                        if accept is None or accept(answer, r.source):
                            break
                    except Exception as e:  # noqa: BLE001 - whatever a client raises is that row's error
                        error = f"{type(e).__name__}: {e}"
                        time.sleep(pause * k)
                rows.append((r.key, answer, error))
            yield pd.DataFrame(rows, columns=["key", "answer", "error"])

    return requests.select("key", "prompt", "image", "source").mapInPandas(run, "key string, answer string, error string")


def recorded(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """(key, answer, error) from recorded answers (key, answer)."""
    found = requests.select("key").join(answers.select("key", "answer"), "key", "left")
    return found.withColumn("error", F.when(F.col("answer").isNull(), F.lit("no recorded answer")))


def votes(judged: DataFrame, least_share: float = 0.8) -> DataFrame:
    """(key, n, wins, accepted) of votes (key, new_wins, valid), whose order of presentation alternated: at least two and all
    but one must be valid, and four fifths of these for the new table."""
    n = F.count_if("valid")
    return judged.groupBy("key").agg(n.alias("n"), F.count_if(F.col("valid") & F.col("new_wins")).alias("wins"), F.count("*").alias("asked")).select(
        "key", "n", "wins", ((F.col("n") >= F.greatest(F.lit(2), F.col("asked") - 1)) & (F.col("wins") >= F.col("n") * least_share)).alias("accepted")
    )
