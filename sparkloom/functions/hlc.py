"""Hybrid logical clocks: ``%012x-%04x-device``; as text they sort by time, counter, device."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 0xFFFF
DRIFT_ALARM_MS = 60_000
READABLE = re.compile("([0-9a-fA-F]{1,12})-([0-9a-fA-F]{1,4})-.")


def written(ms: Column, counter: Column, device: Column) -> Column:
    return F.concat_ws("-", F.lpad(F.lower(F.hex(ms)), 12, "0"), F.lpad(F.lower(F.hex(counter)), 4, "0"), device)


def parsed(clock: Column) -> Column:
    """struct(ms, counter, device) of the first three parts; null where they are not there."""
    p = F.split(clock, "-")
    good = clock.rlike("^[0-9a-fA-F]{1,12}-[0-9a-fA-F]{1,4}-.")
    return F.when(good, F.struct(F.conv(F.get(p, 0), 16, 10).cast("bigint").alias("ms"), F.conv(F.get(p, 1), 16, 10).cast("int").alias("counter"), F.get(p, 2).alias("device")))


def stretch(clock: Column) -> Column:
    """The stretch of time a clock lies in, some four and a half hours; it sorts as clocks do."""
    return F.substring(clock, 1, 6)


def drifts(ms: Column, seen_ms: Column) -> Column:
    return F.abs(ms - seen_ms) > DRIFT_ALARM_MS


def number(ms: Column, counter: Column) -> Column:
    """A clock as one number: a counter that overflows goes on to the next millisecond."""
    return ms * F.lit(MOST + 1) + counter


def of_number(n: Column, device: Column) -> Column:
    return written(F.shiftright(n, 16), n.bitwiseAND(F.lit(MOST)), device)


@dataclass
class Clock:
    """A device's clock; ``tick`` for its own events, ``absorb`` for those of others."""

    device: str
    ms: int = 0
    counter: int = 0
    drift: int = 0

    def __str__(self) -> str:
        return f"{self.ms:012x}-{self.counter:04x}-{self.device}"

    def _set(self, ms: int, counter: int) -> str:
        self.ms, self.counter = (ms, counter) if counter <= MOST else (ms + 1, 0)
        return str(self)

    def tick(self, now: int) -> str:
        return self._set(now, 0) if now > self.ms else self._set(self.ms, self.counter + 1)

    def absorb(self, other: str, now: int) -> str:
        """The clock after an event of another device; what can't be read leaves it as it is."""
        if not (found := READABLE.match(other)):
            return str(self)
        ms, counter = (int(x, 16) for x in found.groups())
        self.drift = max(self.drift, ms - now)
        top = max(self.ms, ms, now)
        same = [c for m, c in ((self.ms, self.counter), (ms, counter)) if m == top]
        return self._set(top, max(same) + 1 if same else 0)
