"""Work that may hang or crash, in a child process of the task: the child is given a time and replaced when it fails."""

from __future__ import annotations

import multiprocessing
import os
from collections.abc import Callable
from multiprocessing.connection import Connection
from typing import Any


class Failed(RuntimeError):
    """The work raised, took too long or ended its process; the message begins with what happened."""


def _serve(work: Callable[..., Any], mine: Connection, other: Connection) -> None:
    other.close()  # the child would keep its own pipe open otherwise, and never see the parent end
    try:
        while True:
            args = mine.recv()
            try:
                mine.send((True, work(*args)))
            except MemoryError:
                mine.send((False, "MemoryError: "))
            except Exception as e:  # noqa: BLE001 - any error of a file is that file's alone
                mine.send((False, f"{type(e).__name__}: {str(e)[:500]}"))
    finally:
        os._exit(0)  # nothing that the task had buffered may be written twice


class Watched:
    """``work`` in a child that is forked on first use and again after it failed."""

    def __init__(self, work: Callable[..., Any], seconds: float):
        self.work, self.seconds, self.child, self.pipe = work, seconds, None, None

    def __call__(self, *args: Any) -> Any:
        if self.child is None:
            self.pipe, theirs = multiprocessing.Pipe()
            self.child = multiprocessing.get_context("fork").Process(target=_serve, args=(self.work, theirs, self.pipe), daemon=True)
            self.child.start()
            theirs.close()
        try:
            self.pipe.send(args)
            if not self.pipe.poll(self.seconds):
                self.close()
                raise Failed(f"TimeoutError: not done in {self.seconds:g} s")
            good, found = self.pipe.recv()
        except (EOFError, OSError) as e:
            code = self.close()
            raise Failed(f"Crashed: the process ended with {code}") from e
        if not good:
            raise Failed(found)
        return found

    def close(self) -> int | None:
        if self.child is None:
            return None
        self.pipe.close()
        self.child.join(0.2)
        if self.child.is_alive():
            self.child.kill()
            self.child.join()
        code, self.child = self.child.exitcode, None
        return code
