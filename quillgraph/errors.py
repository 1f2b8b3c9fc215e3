"""The classes of errors that callers tell apart."""


class QuillError(Exception):
    """Base of all errors of this library."""


class Invalid(QuillError):
    """The request itself is wrong (bad predicate, cursor, bound or argument)."""


class Precondition(QuillError):
    """A compare-and-set or existence condition does not hold."""


class Conflict(QuillError):
    """A constraint (unique, reference, ownership) forbids the change."""


class ScanLimit(QuillError):
    """More rows would have to be held at once than one request may hold."""


class TooOld(QuillError):
    """The requested position lies before the retained log."""

    def __init__(self, requested: int, earliest: int):
        super().__init__(f"position {requested} is older than the earliest retained position {earliest}")
        self.requested, self.earliest = requested, earliest
