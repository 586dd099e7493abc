"""A small runner of dependent steps: independent steps at the same time, retries with growing pauses, gates without retry; and a lease
that keeps two runs apart."""

from __future__ import annotations

import contextlib
import json
import re
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass

from souk.sources.files import Files

DONE, FAILED, SKIPPED = "done", "failed", "skipped"


@dataclass(frozen=True)
class Step:
    """run gives a summary. A step with retries=0 is a gate: what it raises is final."""

    name: str
    run: Callable[[], dict]
    after: tuple[str, ...] = ()
    retries: int = 2


@dataclass(frozen=True)
class Outcome:
    name: str
    state: str
    summary: dict | None = None
    error: str | None = None
    tries: int = 0


def _attempt(step: Step, pause: float, most: float, sleep: Callable[[float], None]) -> Outcome:
    for n in range(step.retries + 1):
        try:
            return Outcome(step.name, DONE, step.run(), None, n + 1)
        except Exception as e:  # noqa: BLE001  any error of a step is its outcome
            error = f"{type(e).__name__}: {e}"
        if n < step.retries:
            sleep(min(most, pause * 2**n))
    return Outcome(step.name, FAILED, None, error, step.retries + 1)


def run(steps: Sequence[Step], pause: float = 60.0, most: float = 900.0, at_once: int = 4, sleep: Callable[[float], None] = time.sleep) -> dict[str, Outcome]:
    """The outcome of every step, in the order they ended. What comes after a step that failed is skipped."""
    waiting = {s.name: s for s in steps}
    unknown = {a for s in steps for a in s.after} - set(waiting)
    if unknown or len(waiting) < len(steps):
        raise ValueError(f"unknown or repeated steps: {sorted(unknown)}")
    ended: dict[str, Outcome] = {}
    running: set[Future] = set()
    with ThreadPoolExecutor(at_once) as pool:
        while waiting or running:
            for name, step in list(waiting.items()):
                states = [ended[a].state for a in step.after if a in ended]
                if FAILED in states or SKIPPED in states:
                    ended[name] = Outcome(name, SKIPPED)
                elif len(states) == len(step.after):
                    running.add(pool.submit(_attempt, step, pause, most, sleep))
                else:
                    continue
                del waiting[name]
                break
            else:
                if not running:
                    raise ValueError(f"steps wait for each other: {sorted(waiting)}")
                done, running = wait(running, return_when=FIRST_COMPLETED)
                ended |= {f.result().name: f.result() for f in done}
    return ended


def wait_for(ready: Callable[[], bool], every: float = 60.0, timeout: float = 7200.0, sleep: Callable[[float], None] = time.sleep) -> None:
    """Returns when ready holds; raises TimeoutError after the timeout."""
    for _ in range(max(1, int(timeout // every))):
        if ready():
            return
        sleep(every)
    raise TimeoutError(f"not ready after {timeout:g} s")


class Held(RuntimeError):
    """Another run holds the lease."""


@contextlib.contextmanager
def lease(files: Files, folder: str, holder: str, seconds: float = 86_400.0, clock: Callable[[], float] = time.time) -> Iterator[int]:
    """Holds a folder for one run; another is refused until this one ends or its time is over, as it is where a run died.

    Leases are numbered, and a number is taken by creating its file, which only one run can do; the number is given, as writers may
    want to check that it is still the last. Releasing adds a file beside it. Numbers before the last two are cleared away.
    """
    numbered = sorted(n for n in files.names(folder) if re.fullmatch(r"\d{9}\.json", n))
    last = int(numbered[-1][:9]) if numbered else 0
    if last and f"{last:09d}.released" not in files.names(folder):
        told = json.loads(files.read(f"{folder}/{last:09d}.json"))
        if clock() < told["until"]:
            raise Held(f"{folder} is held by {told['holder']}")
    try:
        files.create(f"{folder}/{last + 1:09d}.json", json.dumps({"holder": holder, "until": clock() + seconds}))
    except FileExistsError as e:
        raise Held(f"{folder} was taken at the same time") from e
    for n in numbered[:-1]:
        files.delete(f"{folder}/{n}")
        files.delete(f"{folder}/{n[:9]}.released")
    try:
        yield last + 1
    finally:
        files.create(f"{folder}/{last + 1:09d}.released", holder)
