"""Calls to the annotator as a queue whose answers are kept as they come.

A row is a call, named by document, round and place. Calls are dealt to lanes by a hash of their
name; a task works one or more lanes off and writes every answer to a file of the journal the
moment it has it. A task that runs again, in the same job or in a later run, first
reads what its lanes have and asks the rest, so a call that was answered is never asked
again, whatever became of the task. Answers are folded back into documents afterwards.

The journal lies in a folder that all executors reach, as files of JSON lines: one per
lane and attempt, plus one whenever an attempt has written ``roll`` answers (stores that show a file only once it is closed want a small number).
A line cut off by a crash is no answer.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registrum.sources.annotator import BACKOFF_SECONDS, MAX_ATTEMPTS, Provider, ask

SCHEMA = "call string, answer string"


class Pacer:
    """Lets callers through at most so many times a second."""

    def __init__(self, rate: float | None):
        self.gap, self.due, self.lock = (1 / rate if rate else 0.0), 0.0, threading.Lock()

    def wait(self) -> None:
        if not self.gap:
            return
        with self.lock:
            now = time.monotonic()
            at = max(now, self.due)
            self.due = at + self.gap
        time.sleep(at - now)


class Lane:
    """The journal of one lane: what is answered, and where new answers go."""

    def __init__(self, folder: str, lane: int, roll: int):
        self.store, base = fs.FileSystem.from_uri(folder.replace("file:/", "/", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)
        self.folder, self.roll, self.lock, self.out, self.written = f"{base}/lane={lane}", roll, threading.Lock(), None, 0
        self.done: set[str] = set()
        for info in self.store.get_file_info(fs.FileSelector(self.folder, allow_not_found=True)):
            with self.store.open_input_stream(info.path) as f:
                for line in f.read().split(b"\n"):
                    try:
                        self.done.add(json.loads(line)["call"])
                    except ValueError:  # the end of a file whose writer was stopped
                        continue

    def put(self, call: str, answer: str | None) -> None:
        with self.lock:
            if self.out is None:
                self.store.create_dir(self.folder, recursive=True)
                self.out = self.store.open_output_stream(f"{self.folder}/{uuid.uuid4().hex}.jsonl")
            self.out.write(json.dumps({"call": call, "answer": answer}).encode() + b"\n")
            self.out.flush()
            self.done.add(call)
            self.written += 1
            if self.written % self.roll == 0:
                self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


@dataclass(frozen=True)
class Queue:
    """An annotator for :func:`labelling.annotate`: at most ``lanes * threads`` calls are open at a time, at most ``rate`` begin in a second.

    ``key`` names the documents' column of names. Answers that never came are kept as null, like those of the plain annotator.
    """

    folder: str
    factory: Callable[[], Provider]
    key: str = "doc_id"
    lanes: int = 8
    threads: int = 1
    rate: float | None = None
    attempts: int = MAX_ATTEMPTS
    backoff: float = BACKOFF_SECONDS
    roll: int = 1000

    def named(self, number: Column, place: Column) -> Column:
        return F.concat_ws("|", F.col(self.key).cast("string"), number.cast("string"), place.cast("string"))

    def work_off(self, calls: DataFrame) -> int:
        """Ask what the journal lacks of ``calls`` (call, prompt); returns how many were asked."""
        queue = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lanes: dict[int, Lane] = {}
            pacer, local, asked = Pacer(queue.rate / queue.lanes if queue.rate else None), threading.local(), 0

            def one(lane: Lane, call: str, prompt: str) -> None:
                if not hasattr(local, "provider"):
                    local.provider = queue.factory()
                pacer.wait()
                lane.put(call, ask(local.provider, prompt, queue.attempts, queue.backoff))

            open_calls: set[Future] = set()
            try:
                with ThreadPoolExecutor(queue.threads) as pool:
                    try:
                        for batch in batches:
                            for number, call, prompt in zip(*[batch.column(c).to_pylist() for c in ("lane", "call", "prompt")], strict=True):
                                if number not in lanes:
                                    lanes[number] = Lane(queue.folder, number, queue.roll)
                                if call in lanes[number].done:
                                    continue
                                while len(open_calls) >= queue.threads:
                                    ended, open_calls = wait(open_calls, return_when=FIRST_COMPLETED)
                                    for f in ended:
                                        f.result()  # a fatal error ends the task
                                open_calls.add(pool.submit(one, lanes[number], call, prompt))
                                asked += 1
                        for f in open_calls:
                            f.result()
                    except BaseException:
                        pool.shutdown(cancel_futures=True)
                        raise
            finally:
                for lane in lanes.values():
                    lane.close()
            yield pa.RecordBatch.from_arrays([pa.array([asked], pa.int64())], ["asked"])

        dealt = calls.select(F.pmod(F.xxhash64("call"), F.lit(self.lanes)).cast("int").alias("lane"), "call", "prompt")
        return dealt.repartition(self.lanes, "lane").mapInArrow(run, "asked long").agg(F.sum("asked")).first()[0] or 0

    def read(self, df: DataFrame) -> DataFrame:
        """(call, answer) of the journal, each call once."""
        rows = df.sparkSession.read.schema(SCHEMA).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(self.folder)
        return rows.where("call IS NOT NULL").dropDuplicates(["call"])

    def answers(self, df: DataFrame, calls: str, output: str, number: int) -> DataFrame:
        """``df`` with the answers to its array ``calls`` in the array ``output``; round ``number`` of the run."""
        numbered = F.posexplode(F.transform(calls, lambda c: c["prompt"])).alias("at", "prompt")
        rows = df.select(self.key, numbered)
        self.work_off(rows.select(self.named(F.lit(number), F.col("at")).alias("call"), "prompt"))
        kept = self.read(df).withColumn("_parts", F.split("call", r"\|"))
        # The name of a document may hold the separator itself; round and place are the last two parts.
        place = F.element_at("_parts", -1).cast("int")
        kept = kept.where(F.element_at("_parts", -2) == str(number)).select(
            F.array_join(F.slice("_parts", 1, F.size("_parts") - 2), "|").alias("_name"), place.alias("at"), "answer")
        folded = kept.groupBy("_name").agg(F.map_from_entries(F.collect_list(F.struct("at", "answer"))).alias("_found"))
        joined = df.join(folded, F.col(self.key).cast("string") == F.col("_name"), "left")
        none = F.create_map().cast("map<int,string>")
        got = F.transform(F.sequence(F.lit(0), F.size(calls) - 1), lambda i: F.element_at(F.coalesce("_found", none), i))
        return joined.withColumn(output, F.when(F.size(calls) > 0, got).otherwise(F.array().cast("array<string>"))).drop("_name", "_found")
