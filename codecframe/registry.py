"""Names to codec methods; the first of a name wins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from threading import Lock

from codecframe.kernels import deflate, gzip, identity
from codecframe.options import Options, Schema
from codecframe.status import UNSUPPORTED, CodecError

STEP = 1 << 16


@dataclass(frozen=True)
class Method:
    """Factories of an encoder and a decoder; None is a missing capability."""

    name: str
    encoder: Callable | None
    decoder: Callable | None
    schema: Schema | None = None
    needs: tuple[str, ...] = ()


class Registry:
    def __init__(self) -> None:
        self._methods: dict[str, Method] = {}
        self._lock = Lock()

    def register(self, method: Method) -> None:
        with self._lock:
            self._methods.setdefault(method.name, method)

    def find(self, name: str) -> Method | None:
        return self._methods.get(name)

    def names(self) -> list[str]:
        return sorted(self._methods)

    def schema(self, name: str) -> Schema:
        m = self.find(name)
        if m is None or m.schema is None:
            raise CodecError(UNSUPPORTED, f"no schema of {name}")
        return m.schema

    def create(self, name: str, side: str, options: Options | dict | None = None) -> object:
        """A new encoder or decoder (``side``)."""
        m = self.find(name)
        factory = getattr(m, side, None) if m else None
        if factory is None or any(self.find(n) is None for n in m.needs):
            raise CodecError(UNSUPPORTED, f"no {side} of {name}")
        return factory(options if isinstance(options, Options) else Options(options))


METHODS = (
    Method("deflate", deflate.Encoder, deflate.Decoder, deflate.SCHEMA),
    Method("gzip", gzip.Encoder, gzip.Decoder, gzip.SCHEMA, ("deflate",)),
    Method("identity", identity.Identity, identity.Identity, identity.SCHEMA),
)
DEFAULT = Registry()
for _m in METHODS:
    DEFAULT.register(_m)


def run(name: str, side: str, data: bytes, options: Options | dict | None = None, registry: Registry | None = None, capacity: int | None = None) -> bytes:
    """One-shot encode or decode, fed in steps; a result over ``capacity`` is a limit error."""
    return run_with_rest(name, side, data, options, registry, capacity)[0]


def run_with_rest(name: str, side: str, data: bytes, options: Options | dict | None = None, registry: Registry | None = None, capacity: int | None = None) -> tuple[bytes, int]:
    """``run``, and how many bytes follow the end of the stream."""
    coder, out, n = (registry or DEFAULT).create(name, side, options), [], 0
    for piece in _pieces(coder, data):
        out.append(piece)
        n += len(piece)
        if capacity is not None and n > capacity:
            raise CodecError("LIMIT", f"output is over {capacity} bytes")
    return b"".join(out), len(getattr(coder, "rest", b""))


def measure(name: str, side: str, data: bytes, options: Options | dict | None = None, registry: Registry | None = None) -> tuple[int, int]:
    """``run_with_rest`` with the output's size in its place: each step's output is dropped."""
    coder = (registry or DEFAULT).create(name, side, options)
    return sum(len(piece) for piece in _pieces(coder, data)), len(getattr(coder, "rest", b""))


def _pieces(coder: object, data: bytes) -> Iterator[bytes]:
    """A coder's output for a whole value, fed in steps."""
    view = memoryview(data)
    for at in range(0, len(view), STEP):
        yield coder.update(bytes(view[at : at + STEP]))
    yield coder.finish()


def pump(name: str, side: str, read: Callable, write: Callable, options: Options | dict | None = None, registry: Registry | None = None) -> int:
    """Callback form: read(n) to write(bytes) until read gives nothing; returns bytes written."""
    coder, total = (registry or DEFAULT).create(name, side, options), 0

    def put(data: bytes) -> None:
        nonlocal total
        while data:
            n = write(data)
            n = len(data) if n is None else n
            if n <= 0:
                raise CodecError("IO", "the sink takes no bytes")
            total, data = total + n, data[n:]

    while chunk := read(STEP):
        put(coder.update(chunk))
    put(coder.finish())
    return total
