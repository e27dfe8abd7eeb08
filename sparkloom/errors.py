"""Errors that operators raise."""


class EngineError(ValueError):
    """Base of all errors of this package."""


class TaskError(EngineError):
    """A task is empty, has no features, or a target or weight that it can't have."""


class FitError(EngineError):
    """A model can't be fitted to this task."""


class NotSupported(EngineError):
    """The learner doesn't do this."""
