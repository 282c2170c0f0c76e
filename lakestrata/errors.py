"""Errors. All descend from StrataError, a ValueError."""

from __future__ import annotations


class StrataError(ValueError):
    """Any expected failure of a repository operation."""


class NotARepository(StrataError):
    pass


class ObjectMissing(StrataError):
    pass


class StorageUnavailable(StrataError):
    pass


class PreconditionFailed(StrataError):
    """Stored state is not what the caller expected."""


class OptimisticLock(PreconditionFailed):
    """Another writer moved a branch first."""


class RefConflict(StrataError):
    def __init__(self, branch: str, operation: str, expected: str | None, current: str | None):
        self.branch, self.operation, self.expected, self.current = branch, operation, expected, current
        super().__init__(f"{operation}: branch '{branch}' is at {current}, not at {expected}")


class NonFastForward(StrataError):
    def __init__(self, branch: str, current: str | None, target: str | None):
        self.branch, self.current, self.target = branch, current, target
        super().__init__(f"branch '{branch}' can't be moved from {current} to {target}: not a descendant")


class MergeConflict(StrataError):
    def __init__(self, paths: list[str]):
        self.paths = paths
        more = "" if len(paths) <= 5 else f" and {len(paths) - 5} more"
        super().__init__(f"conflicting paths: {', '.join(paths[:5])}{more}")
