"""Results that are kept for the next call with the same arguments."""

from __future__ import annotations

from collections.abc import Callable


class Memo:
    """A function of hashable arguments and its last results, ``size`` of them at most.

    Unlike ``functools.lru_cache`` it can be sent to executors by value; what
    it keeps stays behind.
    """

    def __init__(self, f: Callable, size: int) -> None:
        self.f, self.size, self.kept = f, size, {}

    def __call__(self, *key):
        got = self.kept.get(key)
        if got is None:
            if len(self.kept) >= self.size:
                self.kept.clear()
            got = self.kept[key] = self.f(*key)
        return got

    def __reduce__(self):
        return Memo, (self.f, self.size)


def memo(size: int) -> Callable[[Callable], Memo]:
    """Decorator that makes a :class:`Memo`."""
    return lambda f: Memo(f, size)
