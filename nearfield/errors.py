"""Errors that callers can tell apart."""


class SearchError(ValueError):
    """Base of the errors below."""


class InvalidArgument(SearchError):
    pass


class DimensionMismatch(SearchError):
    pass


class UnsupportedOperation(SearchError):
    pass


class NotFound(SearchError):
    pass


class NotEmpty(SearchError):
    pass


class UnknownField(SearchError):
    pass
