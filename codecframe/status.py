"""Status names, as data and as an exception."""

from __future__ import annotations

OK, INVALID_ARG, MEMORY, LIMIT, CORRUPT, UNSUPPORTED, INTERNAL, IO = STATUSES = ("OK", "INVALID_ARG", "MEMORY", "LIMIT", "CORRUPT", "UNSUPPORTED", "INTERNAL", "IO")


class CodecError(Exception):
    """A failure with its status; the text is the detail."""

    def __init__(self, status: str, detail: str = ""):
        super().__init__(detail)
        self.status, self.detail = status, detail
