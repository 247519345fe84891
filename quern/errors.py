"""Named failures."""


class QuernError(Exception):
    """Any failure that this library names."""


class ConfigError(QuernError):
    """A setting is unknown, out of range or may not change this way."""


class RecordError(QuernError):
    """A record breaks a rule of its schema."""


class NotFound(QuernError):
    """An id names nothing."""


class ParseError(QuernError):
    """Bytes could not be turned into text."""


class UnsupportedFormat(ParseError):
    """A format that is known and not read."""


class ArchiveRefused(QuernError):
    """An archive breaks a safety rule."""


class LedgerError(QuernError):
    """A change would rewrite history."""


class EvidenceMissing(LedgerError):
    """An assertion without evidence."""


class QuoteNotFound(LedgerError):
    """A quote that its chunk does not hold."""


class EmbeddingMismatch(QuernError):
    """Vectors of another model or width."""


class GoldenError(QuernError):
    """A question set that cannot be used; says every problem at once."""


class BudgetExceeded(QuernError):
    """A run would take more than its budget."""
