"""Caps against decompression bombs; 0 is no cap, and a value equal to a cap passes."""

from __future__ import annotations

from dataclasses import dataclass

from codecframe.status import LIMIT, CodecError


@dataclass
class Limits:
    max_output: int = 512 << 20
    max_ratio: int = 1000
    max_memory: int = 256 << 20

    @classmethod
    def of(cls, opts: dict) -> Limits:
        return cls(opts["limits.max_output_bytes"], opts["limits.max_expansion_ratio"], opts["limits.max_memory_bytes"])

    def check(self, bytes_in: int, bytes_out: int) -> None:
        if self.max_output and bytes_out > self.max_output:
            raise CodecError(LIMIT, f"output of {bytes_out} bytes is over {self.max_output}")
        if self.max_ratio and bytes_in and bytes_out > self.max_ratio * bytes_in:
            raise CodecError(LIMIT, f"{bytes_out} bytes from {bytes_in} is over ratio {self.max_ratio}")

    def check_memory(self, used: int) -> None:
        if self.max_memory and used > self.max_memory:
            raise CodecError(LIMIT, f"working memory of {used} bytes is over {self.max_memory}")

    def room(self, bytes_in: int, bytes_out: int, step: int) -> int:
        """Bytes to ask for next: one more than allowed at most, so that excess shows."""
        caps = [step]
        if self.max_output:
            caps.append(self.max_output - bytes_out + 1)
        return max(1, min(caps))
