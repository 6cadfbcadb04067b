"""Extractors that ask a service: one call a request, or a batch that is answered later."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgforge.functions.values import tokens_of_usage
from kgforge.session import ship

from .extractors import RESPONSE

#: Status codes after which another try may help; other client errors reject the request for good.
TRANSIENT = (408, 409, 429, *range(500, 600))


def status_class(status: Column) -> Column:
    """Error class of an answer's status: null if it is fine."""
    return F.when((status >= 200) & (status < 300), F.lit(None).cast("string")).when(status.isin(408, 409, 429) | (status >= 500), "transient").when((status >= 400) & (status < 500), "config").otherwise("internal")


def exception_class(e: Exception) -> str:
    status = getattr(e, "status", None)
    if isinstance(e, TimeoutError):
        return "timeout"
    if isinstance(e, ConnectionError) or status in TRANSIENT:
        return "transient"
    return "config" if isinstance(status, int) and 400 <= status < 500 else "internal"


class Remote:
    """call(prompt) -> dict of content and token counts, made by make() once a task; so many calls of a task are under way at a time.

    A transient error is tried again, after a pause that doubles; what stays is reported by its class and never raised, so a failing
    request doesn't take the others with it.
    """

    def __init__(self, make: Callable[[], Callable[[str], dict]], tasks: int = 8, at_once: int = 8, tries: int = 3, pause: float = 1.0) -> None:
        self.make, self.tasks, self.at_once, self.tries, self.pause = make, tasks, at_once, tries, pause

    def __call__(self, requests: DataFrame) -> DataFrame:
        ship(requests.sparkSession)
        make, at_once, tries, pause = self.make, self.at_once, self.tries, self.pause
        names = [c.split()[0] for c in RESPONSE.split(", ")]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            call = make()

            def ask(job: str, prompt: str) -> dict:
                for k in range(tries):
                    try:
                        return {"job_id": job, **call(prompt)}
                    except Exception as e:  # noqa: BLE001
                        kind = exception_class(e)
                        if kind not in ("transient", "timeout") or k + 1 == tries:
                            return {"job_id": job, "error_class": kind}
                        time.sleep(pause * 2**k)
                return {"job_id": job, "error_class": "internal"}

            with ThreadPoolExecutor(at_once) as pool:
                for batch in batches:
                    yield pd.DataFrame(list(pool.map(ask, batch["job_id"], batch["prompt"]))).reindex(columns=names)

        return requests.select("job_id", "prompt").repartition(self.tasks).mapInPandas(run, RESPONSE)


def write_batch(requests: DataFrame, path: str) -> None:
    """The requests as JSON lines, for a service that answers a file of them."""
    requests.select(F.to_json(F.struct("job_id", F.struct("prompt").alias("body"))).alias("value")).write.mode("overwrite").text(path)


LINE = "job_id string, status int, body struct<content:string,refused:boolean,truncated:boolean,usage:struct<input:string,cached:string,cache_write:string,output:string,reasoning:string>>, error string"


def responses_of_lines(lines: DataFrame) -> DataFrame:
    """Responses from a batch's result lines (value): a refused or cut answer keeps its usage; what can't be read is internal."""
    x = lines.select(F.from_json("value", LINE).alias("x")).where("x.job_id IS NOT NULL").select("x.*")
    bad = status_class(F.col("status"))
    kind = F.when(F.col("status").isNull(), "internal").when(bad.isNotNull(), bad).when(F.col("body.truncated"), "truncated").when(F.col("body.refused") | F.col("body.content").isNull(), "response")
    parts = tokens_of_usage(*[F.col(f"body.usage.{k}") for k in ("input", "cached", "cache_write", "output", "reasoning")])
    return x.select("job_id", F.when(kind.isNull(), F.col("body.content")).alias("content"), kind.alias("error_class"), *[p.alias(f"{n}_tokens") for p, n in zip(parts, ("input", "cached", "cache_write", "output", "reasoning"), strict=True)])


class Service(Protocol):
    """Answers files of requests. An OSError says that it can't be reached."""

    def submit(self, path: str) -> str:
        """Takes the requests below a path; returns the service's name of the batch."""

    def status(self, name: str) -> str:
        """SUBMITTED, IN_PROGRESS, COMPLETED, FAILED or CANCELLED."""

    def results(self, name: str) -> str | None:
        """Where the result lines are, if there are any."""

    def cancel(self, name: str) -> None: ...


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    return responses_of_lines(spark.read.text(path))


def whole_input(own: Column, cached: Column, written: Column) -> Column:
    """The input of a provider that counts cache reads and writes apart."""
    return own + F.coalesce(cached, F.lit(0)) + F.coalesce(written, F.lit(0))


def until_done(run: Callable[[], bool], failures: int = 3, wait: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> int:
    """Calls run until it says that nothing is left; gives up after so many failures in a row. Returns the number of calls."""
    calls = failed = 0
    while True:
        calls += 1
        try:
            if run():
                return calls
            failed = 0
        except OSError:
            failed += 1
            if failed >= failures:
                raise
        sleep(wait)
