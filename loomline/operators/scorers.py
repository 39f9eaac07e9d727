"""Scorers that may fail, hang or die: each task runs one in a child process and goes on without it."""

from __future__ import annotations

import multiprocessing
import os
import time
from collections.abc import Callable, Iterable, Iterator
from multiprocessing.connection import Connection, wait

import pandas as pd

Scorer = Callable[[str, str], float | None]
Verdict = tuple[str, float | None, str | None]
CHILDREN = 16  # processes of a task, all but one of them with a slow call
PATIENCE = 0.02  # seconds after which a call is slow


def answer(link: Connection, other: Connection, scorer: Scorer) -> None:
    """The child's loop: a pair in, a verdict out, until the parent is gone."""
    other.close()
    while True:
        try:
            pair = link.recv()
        except EOFError:
            os._exit(0)
        try:
            score = scorer(*pair)
            verdict: Verdict = ("success", float(score), None) if score is not None else ("empty", None, "no result")
        except BaseException as problem:  # whatever a scorer raises is a result
            verdict = ("error", None, f"{type(problem).__name__}: {problem}")
        link.send(verdict)


def waited(pid: int) -> float:
    """Seconds that a process was ready to run but had no core; 0 where the system doesn't tell."""
    try:
        with open(f"/proc/{pid}/schedstat") as stat:
            return int(stat.read().split()[1]) / 1e9
    except (OSError, IndexError, ValueError):
        return 0.0


class Child:
    """A scorer in a process of its own, started when it is first asked, and again after it was killed or died."""

    def __init__(self, scorer: Scorer):
        self.scorer, self.process, self.link = scorer, None, None

    def start(self) -> None:
        context = multiprocessing.get_context("fork")
        self.link, theirs = context.Pipe()
        self.process = context.Process(target=answer, args=(theirs, self.link, self.scorer), daemon=True)
        self.process.start()
        theirs.close()

    def stop(self) -> int | None:
        """Ends the process, whatever it is doing, and gives its exit code."""
        if self.process is None:
            return None
        self.process.kill()
        self.process.join()
        code, self.process = self.process.exitcode, None
        self.link.close()
        return code

    def died(self) -> Verdict:
        self.process.join()
        return "crashed", None, f"exit code {self.stop()}"

    def ask(self, a: str, b: str) -> Verdict | None:
        """Hands a pair over; a verdict only if the process is already dead."""
        if self.process is None:
            self.start()
        self.began, self.idle = time.monotonic(), waited(self.process.pid)
        try:
            self.link.send((a, b))
        except (EOFError, ConnectionError):
            return self.died()

    def verdict(self, patience: float | None, seconds: float | None) -> Verdict | None:
        """The answer if it comes within a time; none yet while the pair has time left. Time without a core doesn't count against a pair."""
        try:
            if self.link.poll(patience):
                return self.link.recv()
        except (EOFError, ConnectionError):
            return self.died()
        if seconds is not None and time.monotonic() - self.began - (waited(self.process.pid) - self.idle) >= seconds:
            self.stop()
            return "timeout", None, f"over {seconds} s"


def ask_all(pairs: Iterable[tuple[str, str]], children: list[Child], seconds: float | None) -> list[Verdict]:
    """The verdicts of pairs in order. Pairs are asked one after another; one that takes longer than `PATIENCE` is left to its process while other processes take the next ones, until all are taken."""
    out: list[Verdict | None] = []
    free, slow = list(children), []

    def settle(patience: float) -> None:
        if slow and patience:
            wait([child.link for _, child in slow], patience)
        for place, child in list(slow):
            if (found := child.verdict(0, seconds)) is not None:
                out[place] = found
                slow.remove((place, child))
                free.append(child)

    for a, b in pairs:
        settle(0)
        while not free:
            settle(PATIENCE)
        child, place = free.pop(), len(out)
        found = child.ask(a, b)
        if found is None:
            found = child.verdict(PATIENCE if seconds is None else min(PATIENCE, seconds), seconds)
        out.append(found)
        if found is None:
            slow.append((place, child))
        else:
            free.append(child)
    while slow:
        settle(PATIENCE)
    return out


def score_pairs(scorer: Scorer, seconds: float | None = None, children: int = CHILDREN) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function for mapInPandas that gives each row of (a, b) a status, a score and a message.

    An exception, an empty result, a call over the time limit (native code included) and the death of the scorer's process are statuses, and the
    next pair gets a new process where one is needed. A null text is passed on as None. Up to `children` slow calls of a task wait side by side.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = [Child(scorer) for _ in range(children)]
        try:
            for batch in batches:
                out = ask_all(zip(batch["a"], batch["b"], strict=True), pool, seconds)
                status, score, message = zip(*out) if out else ((), (), ())
                yield batch.drop(columns=["a", "b"]).assign(status=list(status), score=pd.array(score, dtype="Float64"), message=list(message))
        finally:
            for child in pool:
                child.stop()

    return run
