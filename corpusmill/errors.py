"""What callers of the library can catch."""


class LoadError(Exception):
    """There is no readable corpus, or no readable dataset."""


class ChunkError(Exception):
    """There is nothing to cut into chunks."""


class IndexingError(Exception):
    """There is no usable index."""
