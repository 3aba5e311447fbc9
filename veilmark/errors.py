"""What can go wrong. Data errors are noted and the run goes on; errors of correctness stop it and are caught nowhere in the package."""

from __future__ import annotations


class VeilmarkError(Exception):
    """Any error of this package."""


class ConfigError(VeilmarkError):
    """A configuration that cannot be used."""


class FetchError(VeilmarkError):
    """A document could not be fetched."""


class DeferredError(VeilmarkError):
    """A backend ran out of memory on a batch; its units are left for later."""


class SplitError(VeilmarkError):
    """Something outside of a split was touched, or splits overlap: results would be contaminated."""


class BudgetExceeded(VeilmarkError, RuntimeError):
    """A plan needs more generations than allowed."""


class MatchingError(VeilmarkError, ValueError):
    """There are fewer controls or deals than needed."""
