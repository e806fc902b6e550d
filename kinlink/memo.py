"""Remembered results of functions that go to Python workers.

The caches of the standard library are pickled by name, which needs this package on the worker's
path; these go by value, without what they remember.
"""

from __future__ import annotations

from collections.abc import Callable


class memo:
    """Remembers a function's results by its arguments; starts afresh after ``MOST``."""

    MOST = 100_000

    def __init__(self, f: Callable):
        self.f, self.known = f, {}
        self.__doc__ = f.__doc__

    def __call__(self, *args):
        if args not in self.known:
            if len(self.known) >= self.MOST:
                self.known.clear()
            self.known[args] = self.f(*args)
        return self.known[args]

    def __reduce__(self):
        return memo, (self.f,)
