"""Errors of the engine."""


class TerralithError(Exception):
    """Base of all."""


class ParamError(TerralithError):
    """Parameters that are missing, malformed or don't fit together."""


class CrsError(TerralithError):
    """A coordinate system that isn't known or isn't of the kind needed."""


class CrsMissingError(CrsError):
    """No coordinate system where one is needed."""


class CameraInitError(Exception):
    """A camera without its exterior parameters."""


class TerralithWarning(UserWarning):
    """Something odd that doesn't stop the work."""
