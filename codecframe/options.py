"""Typed options and the schemas that describe and validate them."""

from __future__ import annotations

from dataclasses import dataclass

from codecframe.status import INVALID_ARG, CodecError

U64 = (1 << 64) - 1
TYPES = {"int64": int, "uint64": int, "bool": bool, "string": str, "bytes": bytes}


@dataclass(frozen=True)
class OptionSpec:
    """One option of a method: type, default, and the range or names allowed."""

    key: str
    type: str
    default: object = None
    low: int | None = None
    high: int | None = None
    names: tuple[str, ...] = ()
    side: str = "both"


#: Core options: accepted by every method. Values fixed by the format's documentation.
CORE = (
    OptionSpec("limits.max_output_bytes", "uint64", 512 << 20, 0, U64, side="decode"),
    OptionSpec("limits.max_memory_bytes", "uint64", 256 << 20, 0, U64),
    OptionSpec("limits.max_window_bytes", "uint64", None, 0, U64, side="decode"),
    OptionSpec("limits.max_expansion_ratio", "uint64", 1000, 0, U64, side="decode"),
    OptionSpec("threads.count", "int64", 1, 0, None),
)


def type_of(value: object) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int64" if value < 0 else "uint64"
    if isinstance(value, (bytes, bytearray)):
        return "bytes"
    if isinstance(value, str):
        return "string"
    raise CodecError(INVALID_ARG, f"option value of type {type(value).__name__}")


class Options:
    """Keys to typed values; freezing makes further changes fail."""

    def __init__(self, values: dict | None = None):
        self._values: dict[str, tuple[str, object]] = {}
        self._frozen = False
        for k, v in (values or {}).items():
            self.set(k, v)

    def set(self, key: str, value: object, type: str | None = None) -> Options:
        if self._frozen:
            raise CodecError(INVALID_ARG, "options are frozen")
        if not key:
            raise CodecError(INVALID_ARG, "option without key")
        kind = type or type_of(value)
        if kind not in TYPES or not isinstance(value, TYPES[kind]) or (kind in ("int64", "uint64") and isinstance(value, bool)):
            raise CodecError(INVALID_ARG, f"{key} is not {kind}")
        if kind == "uint64" and not 0 <= value <= U64:
            raise CodecError(INVALID_ARG, f"{key} is not unsigned")
        self._values[key] = (kind, value)
        return self

    def get(self, key: str, type: str) -> object:
        if key not in self._values:
            raise CodecError(INVALID_ARG, f"{key} is not set")
        kind, value = self._values[key]
        if kind != type and not ({kind, type} == {"int64", "uint64"} and value >= 0):
            raise CodecError(INVALID_ARG, f"{key} is {kind}, not {type}")
        return value

    def value(self, spec: OptionSpec) -> object:
        """The value, or the default where it is not set."""
        return self.get(spec.key, spec.type) if spec.key in self._values else spec.default

    def clone(self) -> Options:
        out = Options()
        out._values, out._frozen = dict(self._values), self._frozen
        return out

    def freeze(self) -> Options:
        self._frozen = True
        return self

    @property
    def frozen(self) -> bool:
        return self._frozen

    def items(self) -> list[tuple[str, str, object]]:
        return [(k, t, v) for k, (t, v) in sorted(self._values.items())]


class Schema:
    """The options of one method, with the core options."""

    def __init__(self, specs: tuple[OptionSpec, ...], unknown: str = "error"):
        self.specs = {s.key: s for s in (*CORE, *specs)}
        self.own, self.unknown = tuple(s.key for s in specs), unknown

    def keys(self) -> list[str]:
        return list(self.specs)

    def spec(self, key: str) -> OptionSpec:
        if key not in self.specs:
            raise CodecError(INVALID_ARG, f"unknown option {key}")
        return self.specs[key]

    def validate_key(self, options: Options, key: str) -> None:
        spec = self.spec(key)
        value = options.get(key, spec.type)
        if (spec.low is not None and value < spec.low) or (spec.high is not None and value > spec.high) or (spec.names and value not in spec.names):
            raise CodecError(INVALID_ARG, f"{key} is out of range")

    def validate(self, options: Options) -> None:
        for key, _, _ in options.items():
            if key in self.specs:
                self.validate_key(options, key)
            elif self.unknown == "error":
                raise CodecError(INVALID_ARG, f"unknown option {key}")

    def parse(self, texts: dict[str, str | None]) -> Options:
        """Options given as texts, checked; bytes are hexadecimal, null leaves the default."""
        out = Options()
        for key, text in texts.items():
            kind = self.spec(key).type
            if text is None:
                continue
            try:
                value = {"bool": {"true": True, "false": False}.__getitem__, "bytes": bytes.fromhex, "string": str}.get(kind, int)(text)
            except (KeyError, ValueError) as e:
                raise CodecError(INVALID_ARG, f"{key} is not {kind}") from e
            out.set(key, value, kind)
        self.validate(out)
        return out

    def read(self, options: Options) -> dict:
        """Values of all keys, checked."""
        self.validate(options)
        return {k: options.value(s) for k, s in self.specs.items()}
