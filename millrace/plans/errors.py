"""What may go wrong with a corpus, one class for each outcome that a caller tells apart."""

from __future__ import annotations


class CorpusError(Exception):
    """Any failure of a corpus; `code` is what a command ends with. The codes."""

    code = 1


class OtherSpace(CorpusError, ValueError):
    """The settings name another vector space than the index holds."""

    code = 2


class NotBuilt(CorpusError):
    """There is no index yet."""

    code = 3


class NoModel(CorpusError):
    """No embedder is set up for what was asked."""

    code = 4


class Locked(CorpusError):
    """Another writer has changed the index meanwhile."""

    code = 5


class EmptyQuery(CorpusError, ValueError):
    """A query without words."""
