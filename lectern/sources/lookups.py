"""Lookups in web services as a plan: each distinct key that a cache table does not know is asked for once, by rate-limited tasks with retries and a budget.

What a service answers is kept, also that it knows nothing; a failed request is unknown and is asked again in the next run. The cache is a Parquet
table in a shared folder to which every run appends what it learnt."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.session import staged
from lectern.sources.adapters import Budget, Retry

CACHE = "key string, answer string, at timestamp"
ANSWERS = "key string, ok boolean, answer string"
#: What an organisation's answer holds, in the form of a registry for operators.registry.
ORGANISATION = "struct<org_id:string,display_name:string,names:array<string>,types:array<string>,fundref:string>"
Call = Callable[[str], tuple[int, object]]


def http_json(template: str, timeout: float = 10.0, headers: dict[str, str] | None = None) -> Call:
    """Asks the address that the template makes of a key ({key}) for JSON: status and answer; status 0 where no answer came."""

    def call(key: str) -> tuple[int, object]:
        request = urllib.request.Request(template.format(key=urllib.parse.quote(key)), headers=headers or {})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as response:
                return 200, json.loads(response.read())
        except urllib.error.HTTPError as e:
            return e.code, None
        except (OSError, ValueError):
            return 0, None

    return call


@dataclass(frozen=True)
class Client:
    """How keys are asked for: call(key) gives status and answer; chosen(answer) what is kept of it (null: the service knows nothing).

    per_second holds for all tasks together. After a failure that is not the request's own fault (4xx) a task asks nothing for pause seconds; keys that come
    up then stay unknown. The retry's budget of waiting is one for all keys of a task."""

    call: Call
    chosen: Callable[[object], object | None] = lambda answer: answer
    retry: Retry = field(default_factory=Retry)
    per_second: float = 5.0
    tasks: int = 1
    pause: float = 60.0
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic

    def answers(self, keys: DataFrame) -> DataFrame:
        """key, ok, answer (JSON, null if there is none) of distinct keys (key)."""
        gap, client = self.tasks / self.per_second, self

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            budget, free, open_from = Budget(client.retry.budget), client.clock(), client.clock()

            def once(key: str) -> tuple[int, object]:
                nonlocal free
                client.sleep(max(0.0, free - client.clock()))
                free = client.clock() + gap
                return client.call(key)

            for batch in batches:
                rows = []
                for key in batch["key"]:
                    if client.clock() < open_from:
                        rows.append((key, False, None))
                        continue
                    status, answer = client.retry.run(lambda key=key: once(key), budget, client.sleep)
                    if status != 200 and not 400 <= status < 500:
                        open_from = client.clock() + client.pause
                    kept = client.chosen(answer) if status == 200 else None
                    rows.append((key, status == 200, None if kept is None else json.dumps(kept, ensure_ascii=False)))
                yield pd.DataFrame(rows, columns=["key", "ok", "answer"])

        return keys.select("key").repartition(self.tasks, "key").mapInPandas(run, ANSWERS)


@dataclass(frozen=True)
class Cache:
    """A table of answers by key in a folder that driver and executors share; the latest answer of a key counts."""

    folder: str

    def read(self, spark: SparkSession) -> DataFrame:
        """key, answer; a null answer says that nothing is known."""
        try:
            rows = spark.read.schema(CACHE).parquet(self.folder)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = spark.createDataFrame([], CACHE)
        # max_by of a struct: a null answer is as good as any.
        return rows.groupBy("key").agg(F.max_by(F.struct("answer"), "at").alias("a")).select("key", "a.answer")

    def add(self, rows: DataFrame) -> None:
        """Keeps answers (key, answer), in place of older ones of their keys."""
        rows.select("key", "answer", F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(self.folder)


def looked_up(df: DataFrame, name: str, client: Client, cache: Cache) -> DataFrame:
    """df with answer (JSON) for the key of its column `name`: of the cache, else of the service, which is asked for each other key once. Null and blank names are
    not asked for; they, and what is unknown, have a null answer."""
    keyed = df.withColumn("_key", text.query_key(name))
    known = cache.read(df.sparkSession)
    new = keyed.select(F.col("_key").alias("key")).where("key != ''").distinct().join(known, "key", "left_anti")
    got = staged(client.answers(new))
    good = got.where("ok").select("key", "answer")
    every = staged(known.join(keyed.select(F.col("_key").alias("key")).distinct(), "key", "left_semi").unionByName(good))
    if good.limit(1).count():
        cache.add(good)
    return keyed.join(every.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")


def organisations(client: Client, cache: Cache) -> Callable[[DataFrame], DataFrame]:
    """A step from names (name) to a registry of the organisations that the service takes them for; the client's chosen() gives the fields of ORGANISATION.

    Where a name has no answer it is asked for once more without the country at its end."""

    def step(names: DataFrame) -> DataFrame:
        first = looked_up(names.select("name").distinct(), "name", client, cache)
        short = first.where("answer is null").select(text.without_country("name").alias("name")).where("name is not null").distinct()
        both = first.unionByName(looked_up(short, "name", client, cache)).where("answer is not null")
        found = both.select(F.from_json("answer", ORGANISATION).alias("o")).where("o.org_id is not null and o.display_name is not null").select("o.*")
        return staged(found.dropDuplicates(["org_id"]))

    return step
