"""Errors that callers can tell apart."""


class SearchError(Exception):
    """Any error of the engine."""


class IndexAlreadyExists(SearchError):
    pass


class IndexNotFound(SearchError):
    pass


class DocumentAlreadyExists(SearchError):
    pass


class DocumentNotFound(SearchError):
    pass


class InvalidDocument(SearchError):
    pass


class InvalidQuery(SearchError):
    pass


class StorageError(SearchError):
    pass
