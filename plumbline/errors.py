"""Exceptions of the engine, one family."""


class PlumblineError(Exception):
    """Root of all errors that the engine raises itself."""


class ValidationError(PlumblineError, ValueError):
    """An argument or a row breaks a rule."""


class ConfigurationError(ValidationError):
    """A configuration value is out of range."""


class StorageError(PlumblineError):
    """A table can't be read or written."""


class IndexError_(PlumblineError):
    """An index is missing or not trained."""


class QuantizationError(PlumblineError):
    """A quantizer is not trained or does not fit the data."""


class ParsingError(PlumblineError, ValueError):
    """A file or literal can't be understood."""


class ProcessingError(PlumblineError):
    """A document can't be chunked or embedded."""
