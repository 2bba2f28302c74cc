"""Errors raised by the library."""


class LarderError(Exception):
    """Base class."""


class UnknownTableError(LarderError):
    """The table is not in the registry."""


class SchemaError(LarderError):
    """Rows do not fit the registered schema."""


class DataStaleError(LarderError):
    """Data is missing or was written with a different schema."""


class QueryError(LarderError):
    """An ad-hoc query was refused."""
