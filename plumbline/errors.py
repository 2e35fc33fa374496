"""Errors of the library."""


class PlumblineError(Exception):
    """Base of the library's errors."""


class InvalidData(PlumblineError, ValueError):
    """A byte format ends early or contradicts itself."""


class NotSorted(PlumblineError, ValueError):
    """Keys that must ascend do not."""
