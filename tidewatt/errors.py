"""What can go wrong, and whether a writer may go on afterwards."""


class TidewattError(Exception):
    """Base of all errors; ``poisons`` tells that the writer must be reopened."""

    poisons = False


class InvalidArgument(TidewattError, ValueError):
    """A call argument out of its domain."""


class ModelError(TidewattError, ValueError):
    """A catalogue object or point breaks a rule of the model."""


class ConfigError(TidewattError, ValueError):
    """A limit that cannot be used."""


class LimitError(TidewattError):
    """A batch, a store or a queue would pass its bound."""


class IngressConflict(TidewattError):
    """An ingress identity that contradicts what has been accepted."""


class SourceSequenceConflict(IngressConflict):
    """The (source, sequence) is known with another commit or payload."""


class CommitIdConflict(IngressConflict):
    """The commit id is known with another payload or identity."""


class SequenceNotIncreasing(IngressConflict):
    """The sequence does not come after the last one of its source."""


class NotAccepted(IngressConflict):
    """A flush names a sequence that has not been accepted yet."""


class ReadOnlyError(TidewattError, PermissionError):
    """A write through a read-only handle."""


class LockedError(TidewattError):
    """Another writer holds the store."""


class Overloaded(LimitError):
    """The queue of a bounded writer is full."""


class SourceChanged(TidewattError):
    """A salvage source changed while it was read."""


class StorageFault(TidewattError):
    """Files that are missing, unreadable or not what the manifest says."""

    poisons = True
