"""Errors of the library; each condition has a class of its own."""


class WavemillError(Exception):
    """Base of all errors here."""


class BadMagic(WavemillError):
    """A file doesn't begin with the expected magic number."""


class UnsupportedVersion(WavemillError):
    """A manifest or file has another major version."""


class UnknownFlags(WavemillError):
    """Flag bits without a meaning are set."""


class CorruptOverflow(WavemillError):
    """An overflow part is missing or fails validation."""


class OffsetOutOfBounds(WavemillError):
    """An offset or count lies outside its data."""


class RecordNotFound(WavemillError):
    """No record has the id."""


class DatasetMismatch(WavemillError):
    """Tables of different datasets were put together."""


class InvalidTuning(WavemillError):
    """A tuning breaks its rules."""


class EmptyDataset(WavemillError):
    """A dataset holds no records."""


class InvalidCompression(WavemillError):
    """Encoded data can't be decoded."""


class TruncatedVarint(InvalidCompression):
    """A variable-length number ends too early or runs too long."""


class NoPostingIndex(WavemillError):
    """The dataset has no sampled posting index."""


class NoSearchIndex(WavemillError):
    """The dataset has no band index."""


class NoIndex(WavemillError):
    """The dataset has neither index."""


class NoDataStore(WavemillError):
    """The dataset has no fingerprint table."""


class NoSharedFolder(WavemillError):
    """A cluster names no folder that all executors share."""


class ConcurrentChange(WavemillError):
    """Another writer has changed the dataset since it was opened."""
