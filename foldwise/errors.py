"""Errors that checks raise on the driver."""


class TemporalCVError(ValueError):
    """Base of all errors about leaking splits."""


class TemporalLeakageError(TemporalCVError):
    """A training label overlaps a test label."""


class EmbargoViolationError(TemporalCVError):
    """A training row stands in the embargo after a test row."""


class GroupLeakageError(TemporalCVError):
    """A group is on both sides of a split."""
