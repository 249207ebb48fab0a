"""Calls of a service from tasks: several at a time, tried again with growing waits, each answer kept so that none is paid for twice."""

from __future__ import annotations

import hashlib
import json
import random
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets that requests are dealt to; answers of a bucket lie in one folder, which its task reads before it asks.
BUCKETS = 64
#: Answers that are written together.
SAVED_AT_ONCE = 64
ANSWERS = pa.schema([("key", pa.string()), ("reply", pa.string()), ("attempts", pa.int32())])


class Fatal(Exception):
    """An error that ends the task: asking again in it is no use. What had been answered is kept."""


@dataclass(frozen=True)
class Limits:
    """Calls in flight in a task, attempts at a request, and the first wait between them in seconds, doubled each time up to ``longest``."""

    in_flight: int = 8
    attempts: int = 4
    pause: float = 0.5
    longest: float = 30.0
    sleep: Callable[[float], None] = field(default=time.sleep)


def request_key(request: dict) -> str:
    """The hash of a request: equal for mappings of the same entries in any order."""
    return hashlib.sha256(json.dumps(request, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def attempt(call: Callable[[dict], object], request: dict, limits: Limits, key: str = "") -> tuple[object, int, Exception | None]:
    """The answer, the attempts it took and, if none succeeded, the last error; waits are spread by the key, the same each time."""
    spread = random.Random(key)
    for n in range(1, limits.attempts + 1):
        try:
            return call(request), n, None
        except Fatal:
            raise
        except Exception as failed:
            error = failed
        if n < limits.attempts:
            limits.sleep(min(limits.longest, limits.pause * 2 ** (n - 1)) * (0.5 + spread.random() / 2))
    return None, limits.attempts, error


def patient(call: Callable[[dict], dict], limits: Limits) -> Callable[[dict], dict]:
    """``call`` tried as often as ``limits`` says; the last error is raised."""

    def ask(request: dict) -> dict:
        reply, _, error = attempt(call, request, limits, str(len(str(request))))
        if error is not None:
            raise error
        return reply

    return ask


def in_order(jobs: Iterable, work: Callable, limits: Limits) -> Iterator:
    """What ``work`` makes of each job, in the order of the jobs, with so many under way at a time; an error ends it once those under way are done."""
    with ThreadPoolExecutor(limits.in_flight) as pool:
        waiting: list = []
        for job in jobs:
            waiting.append(pool.submit(work, job))
            if len(waiting) >= limits.in_flight:
                yield waiting.pop(0).result()
        for job in waiting:
            yield job.result()


def as_done(jobs: Iterable, work: Callable, limits: Limits) -> Iterator:
    """What ``work`` makes of the jobs as it is done; an error is raised when all those under way have been given."""
    error: BaseException | None = None
    with ThreadPoolExecutor(limits.in_flight) as pool:
        left, going = iter(jobs), set()
        while True:
            while error is None and len(going) < limits.in_flight and (job := next(left, None)) is not None:
                going.add(pool.submit(work, job))
            if not going:
                break
            done, going = wait(going, return_when=FIRST_COMPLETED)
            for one in done:
                if one.exception() is not None:
                    error = error or one.exception()
                else:
                    yield one.result()
    if error is not None:
        raise error


class Kept:
    """The answers of a bucket in a shared folder: files that are written whole and never changed."""

    def __init__(self, folder: str, bucket: int) -> None:
        self.store, root = fs.FileSystem.from_uri(folder)
        self.at = f"{root.rstrip('/')}/bucket={bucket}"
        self.held: list[tuple[str, str, int]] = []

    def known(self) -> dict[str, tuple[str, int]]:
        found = {}
        for info in self.store.get_file_info(fs.FileSelector(self.at, allow_not_found=True)):
            if info.base_name.endswith(".parquet") and not info.base_name.startswith((".", "_")):
                rows = pq.read_table(info.path, filesystem=self.store, schema=ANSWERS).to_pydict()
                found.update(zip(rows["key"], zip(rows["reply"], rows["attempts"])))
        return found

    def add(self, key: str, reply: str, attempts: int) -> None:
        self.held.append((key, reply, attempts))
        if len(self.held) >= SAVED_AT_ONCE:
            self.save()

    def save(self) -> None:
        if self.held:
            name = uuid.uuid4().hex
            self.store.create_dir(self.at, recursive=True)
            rows = pa.Table.from_pydict(dict(zip(ANSWERS.names, map(list, zip(*self.held)))), schema=ANSWERS)
            pq.write_table(rows, f"{self.at}/_{name}.part", filesystem=self.store)
            self.store.move(f"{self.at}/_{name}.part", f"{self.at}/{name}.parquet")
            self.held = []


def answered(rows: DataFrame, load: Callable[[], Callable[[dict], object]], request: Callable[[dict], dict], folder: str, *, limits: Limits | None = None) -> DataFrame:
    """Adds ``reply``, a service's answer to each row as JSON text, ``attempts`` and ``error``.

    ``request`` makes a row's request (a mapping of JSON values), ``load`` the function that answers one, once in a task;
    it is called from several threads. Equal requests are asked once, and so are those that an earlier run, or an earlier
    attempt of a task, has got an answer to: answers lie in ``folder``, which driver and executors share and pyarrow can
    open, by the hash of the request. They are written as they come, SAVED_AT_ONCE together, and what is answered when a
    task fails is written before it ends; only a lost machine may have some asked again. A request that fails
    ``limits.attempts`` times has no reply but the error, and is asked again by the next run. The columns reply, attempts
    and error must not be there; an empty table asks nothing.
    """
    limits = limits or Limits()
    if clash := {"reply", "attempts", "error", "request_key"} & {c.lower() for c in rows.columns}:
        raise ValueError(f"columns would be hidden: {sorted(clash)}")

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [request(r) for r in batch.to_dict("records")]
            yield batch.assign(request_key=list(map(request_key, made)), request=[json.dumps(r, ensure_ascii=False) for r in made])

    asked = rows.mapInPandas(keyed, StructType([*rows.schema.fields]).add("request_key", "string").add("request", "string"))
    distinct = asked.groupBy("request_key").agg(F.first("request").alias("request"))
    dealt = distinct.withColumn("bucket", F.pmod(F.xxhash64("request_key"), F.lit(BUCKETS)).cast("int"))

    def ask(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
        kept = Kept(folder, int(key[0]))
        known, call = kept.known(), None
        out = [(k, *known[k], None) for k in held["request_key"] if k in known]
        todo = [(k, r) for k, r in zip(held["request_key"], held["request"]) if k not in known]
        if todo:
            call = load()
            work = lambda job: (job[0], *attempt(call, json.loads(job[1]), limits, job[0]))
            try:
                for k, reply, n, error in as_done(todo, work, limits):
                    text = None if error else json.dumps(reply, ensure_ascii=False)
                    if not error:
                        kept.add(k, text, n)
                    out.append((k, text, n, f"{type(error).__name__}: {error}" if error else None))
            finally:
                kept.save()
        return pd.DataFrame(out, columns=["request_key", "reply", "attempts", "error"])

    answers = dealt.groupBy("bucket").applyInPandas(ask, "request_key string, reply string, attempts int, error string")
    # The request itself is asked for once more by a rerun of this plan, but then its answer is kept.
    return asked.drop("request").join(answers, "request_key").drop("request_key")
