"""A codec that changes nothing: the smallest method."""

from __future__ import annotations

from codecframe.limits import Limits
from codecframe.options import Options, Schema

SCHEMA = Schema(())


class Identity:
    def __init__(self, options: Options):
        self.limits = Limits.of(SCHEMA.read(options))
        self.reset()

    def reset(self) -> None:
        self.n, self.rest, self.done = 0, b"", True

    def update(self, data: bytes) -> bytes:
        self.n += len(data)
        self.limits.check(self.n, self.n)
        return data

    def finish(self) -> bytes:
        return b""
