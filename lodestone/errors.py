"""The errors that the engine raises."""


class EngineError(Exception):
    """Root of all errors raised here."""


class UniqueConstraintError(EngineError):
    """Two rows have one key where keys must be unique."""


class TypeMismatchError(EngineError):
    """A value does not fit its column."""
