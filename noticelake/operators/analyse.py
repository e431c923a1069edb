"""Pluggable record analyser: the caller's function runs over the work list, failures stay data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "id bigint, content_hash string, reply string, finished boolean, outcome string, message string"


class AnalyserError(Exception):
    """Typed failure of the analyser. ``outcome``: no_request, http_<status>, overload or json_error."""

    def __init__(self, outcome: str, message: str = ""):
        super().__init__(message)
        self.outcome = outcome


def analyse(work: DataFrame, analyser: Callable[[dict], tuple[str, bool]] | None) -> DataFrame:
    """One result row per work row: the reply and whether it is finished, or outcome and message.

    ``work``: id, content_hash, prompt (labels.prompt_text). ``analyser`` gets the row as a dict. None means
    no analyser is available and everything is deferred. A failing row never affects another one.
    """
    narrow = work.select("id", "content_hash", "prompt")
    if analyser is None:
        none = F.lit(None).cast("string")
        return narrow.select(
            "id", "content_hash", none.alias("reply"), F.lit(False).alias("finished"), F.lit("deferred").alias("outcome"), none.alias("message")
        )

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for row in part.to_dict("records"):
                reply, finished, outcome, message = None, False, "success", None
                try:
                    reply, finished = analyser(row)
                except AnalyserError as err:
                    outcome, message = err.outcome, str(err)
                except Exception as err:  # noqa: BLE001 - the analyser is foreign code
                    outcome, message = "failed", f"{type(err).__name__}: {err}"
                rows.append((row["id"], row["content_hash"], reply, finished, outcome, message))
            yield pd.DataFrame(rows, columns=["id", "content_hash", "reply", "finished", "outcome", "message"])

    return narrow.mapInPandas(run, RESULT)
