"""A rate that holds over all tasks, retried and speculative ones included: slots of time are claimed once, in a shared folder.

Slot n is the n-th share of 1 / rate seconds since the epoch; a file of that name is made by whoever claims it, and making
a file that exists fails, so no two calls get one slot. Claims go on from the present, so a task that comes back does not
catch up on what it missed. Files of slots long past are removed by those who pass by.
"""

from __future__ import annotations

import contextlib
import os
import time

#: Seconds after which a slot's file may go; a clock may differ by so much between machines.
STALE = 120.0


class Slots:
    """rate: calls a second over all that share the folder, which must be mounted where they run."""

    def __init__(self, folder: str, rate: float):
        if not 0 < rate <= 1_000:
            raise ValueError("a rate must be above 0 and at most 1,000 a second")
        self._folder, self._rate, self._swept = folder, rate, 0.0
        os.makedirs(folder, exist_ok=True)

    def claim(self) -> float:
        """The time of the first free slot from now on, which is the caller's."""
        self._sweep()
        n = int(time.time() * self._rate) + 1
        while True:
            try:
                os.close(os.open(f"{self._folder}/{n}", os.O_CREAT | os.O_EXCL | os.O_WRONLY))
                return n / self._rate
            except FileExistsError:
                n += 1

    def wait(self) -> float:
        """Claim a slot and sleep until its time."""
        at = self.claim()
        time.sleep(max(0.0, at - time.time()))
        return at

    def _sweep(self) -> None:
        if time.time() - self._swept < STALE / 4:
            return
        self._swept = time.time()
        for name in os.listdir(self._folder):
            if name.isdigit() and int(name) / self._rate < time.time() - STALE:
                with contextlib.suppress(FileNotFoundError):
                    os.unlink(f"{self._folder}/{name}")
