"""Adapters to recognisers and decoders that run outside Spark: protocols, a line-based worker, checks of what it says.

A worker lives as long as its partition. Whatever goes wrong with a frame becomes a failure row, never a lost row.
"""

from __future__ import annotations

import json
import math
import os
import select
import subprocess
import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame

from ..runtime import ship_package

RESPONSE_BYTES = 16 << 20
RESULT = "source_id bigint, frame bigint, response string, failure string"


class Recogniser(Protocol):
    """One request at a time; close ends what it started."""

    def request(self, message: dict) -> dict: ...

    def close(self) -> None: ...


class WorkerFailed(RuntimeError):
    """The worker cannot be used any more; code says why."""

    def __init__(self, code: str) -> None:
        super().__init__(code)
        self.code = code


class LineWorker:
    """A child process that answers each JSON line with one. A request has one deadline for writing and reading; after
    a failure only this child is ended, and the worker stays failed."""

    def __init__(self, command: list[str], timeout: float = 60.0) -> None:
        if not (isinstance(timeout, (int, float)) and math.isfinite(timeout) and timeout > 0):
            raise ValueError("timeout must be positive and finite")
        self.process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        os.set_blocking(self.process.stdin.fileno(), False)
        self.timeout, self.failed, self.rest = timeout, "", b""

    def fail(self, code: str) -> WorkerFailed:
        self.failed = self.failed or code
        self.close()
        return WorkerFailed(code)

    def _left(self, end: float) -> float:
        left = end - time.monotonic()
        if left <= 0:
            raise self.fail("timeout")
        return left

    def request(self, message: dict) -> dict:
        if self.failed:
            raise WorkerFailed(self.failed)
        end, data = time.monotonic() + self.timeout, json.dumps(message).encode() + b"\n"
        try:
            while data:
                if select.select([], [self.process.stdin], [], self._left(end))[1]:
                    data = data[os.write(self.process.stdin.fileno(), data) :]
            while b"\n" not in self.rest:
                if select.select([self.process.stdout], [], [], self._left(end))[0]:
                    part = os.read(self.process.stdout.fileno(), 1 << 16)
                    if not part:
                        raise self.fail("worker_ended")
                    self.rest += part
                    if len(self.rest) > RESPONSE_BYTES:
                        raise self.fail("response_too_large")
            line, _, self.rest = self.rest.partition(b"\n")
            return json.loads(line)
        except (OSError, ValueError) as error:
            if isinstance(error, WorkerFailed):
                raise
            raise self.fail("worker_failed") from error

    def close(self) -> None:
        if self.process.poll() is None:
            self.process.kill()
        self.process.wait()
        for pipe in (self.process.stdin, self.process.stdout):
            pipe.close()


def _numbers(value: Any, least: float, strict: bool) -> bool:
    """A rectangle: four finite numbers, its sides above (or at) least."""
    if not isinstance(value, list) or len(value) != 4 or not all(type(v) in (int, float) and math.isfinite(v) for v in value):
        return False
    return all(v > least if strict else v >= least for v in value[2:])


def _glyph(value: Any) -> bool:
    return isinstance(value, dict) and type(value.get("start")) is int and type(value.get("end")) is int and _numbers(value.get("box"), 0, False)


def _observation(value: Any) -> bool:
    if not isinstance(value, dict) or not isinstance(value.get("text"), str) or not _numbers(value.get("box"), 0, True):
        return False
    confidence, chars = value.get("confidence", 0.0), value.get("chars", [])
    return type(confidence) in (int, float) and math.isfinite(confidence) and isinstance(chars, list) and all(map(_glyph, chars))


def valid_response(value: Any) -> bool:
    """Whether an answer has observations of the right form; further keys are allowed, codes are optional."""
    if not isinstance(value, dict) or not isinstance(value.get("observations"), list) or not all(map(_observation, value["observations"])):
        return False
    extra = [value[k] for k in ("codes", "barcodes") if k in value]
    return all(isinstance(x, list) and all(isinstance(c, dict) and _numbers(c.get("box"), 0, True) for c in x) for x in extra)


def recognise(frames: DataFrame, make: Callable[[], Recogniser]) -> DataFrame:
    """source_id, frame, response (JSON) or failure, for frames with a column request (JSON). One worker a partition.

    A malformed answer fails its frame; a failed worker fails the rest of its partition, frame by frame.
    """
    ship_package(frames.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker, dead = None, ""
        try:
            for pdf in batches:
                out = []
                for source, frame, request in pdf[["source_id", "frame", "request"]].itertuples(index=False):
                    answer, failure = None, dead
                    if not dead:
                        try:
                            worker = worker or make()
                            answer = worker.request(json.loads(request))
                            failure = "" if valid_response(answer) else "invalid_response"
                        except WorkerFailed as error:
                            failure = dead = error.code
                    out.append((source, frame, None if failure else json.dumps(answer), failure or None))
                yield pd.DataFrame(out, columns=["source_id", "frame", "response", "failure"])
        finally:
            if worker is not None:
                worker.close()

    return frames.mapInPandas(run, RESULT)
