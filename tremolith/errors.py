"""Errors of configuration and lookup; failures of single rows are columns."""


class TremolithError(Exception):
    """Base of all errors raised by this package."""


class UnknownOperator(TremolithError, KeyError):
    """No operator of that id is in the catalog."""


class UnsupportedFormat(TremolithError, ValueError):
    """No reader knows the file's extension, or its library is missing."""


class SignalReadError(TremolithError):
    """A file's bytes are not what its extension says."""


class SignalTooLong(TremolithError, ValueError):
    """A signal has more samples than an operator accepts."""


class InvalidConfig(TremolithError, ValueError):
    """A configuration value is missing or out of range."""
