"""What can go wrong, by the class of answer a caller gives to it."""


class BasaltError(Exception):
    """Base of all."""


class Invalid(BasaltError):
    """The request itself is wrong."""


class NotFound(BasaltError):
    """A project, dataset, table, job, session or stream doesn't exist (or has expired)."""


class AlreadyExists(BasaltError):
    """The name or offset is taken."""


class Conflict(BasaltError):
    """Another writer was first, or an id is reused for something else."""


class Precondition(BasaltError):
    """State or shape forbids it: a full table under WRITE_EMPTY, another schema, a stream not finalized."""


class OutOfRange(BasaltError):
    """An offset past the end."""


class Unsupported(BasaltError):
    """Understood, and outside of what the engine does."""
