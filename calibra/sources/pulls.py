"""What long pulls need: request pacing, statuses worth another try, and a stored place to go on from."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from pathlib import Path

from calibra.sources.readers import TooManyRequests


class RequestFailed(Exception):
    """The server refuses the request; asking again won't help."""


def checked(status: int, body):
    """``body``; TooManyRequests for 429 and server errors, which are worth another try, RequestFailed for other errors."""
    if status == 429 or status >= 500:
        raise TooManyRequests(str(status))
    if status >= 400:
        raise RequestFailed(str(status))
    return body


class Paced:
    """A function that's called ``per_second`` times a second at most, evenly."""

    def __init__(self, call: Callable, per_second: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.call, self.gap, self.clock, self.sleep = call, 1.0 / per_second, clock, sleep
        self.next = -float("inf")

    def __call__(self, *args):
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap
        return self.call(*args)


def resumed(pages: Callable[[object], Iterator[tuple[list, object]]], state: str, start) -> Iterator[list]:
    """Rows of ``pages(place)``, page by page, from the place stored in ``state``, or ``start``.

    A page's following place is stored when the next page is asked for, that is when the taker is done with it: after a
    break, the page in hand comes again. The file goes when all pages are through.
    """
    path = Path(state)
    place = json.loads(path.read_text()) if path.exists() else start
    for rows, following in pages(place):
        yield rows
        part = path.with_name(path.name + ".part")
        part.write_text(json.dumps(following))
        os.replace(part, path)
    path.unlink(missing_ok=True)
