"""Structured Streaming: stateless encoding, and decoding of chunk streams with state."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codecframe import functions as C
from codecframe import registry
from codecframe.options import Options
from codecframe.status import CORRUPT, LIMIT

OUTPUT = "stream_id string, status string, detail string, data binary"
STATE = "seqs array<bigint>, chunks array<binary>, last bigint"


def encode_stream(chunks: DataFrame, method: str = "gzip", options: dict | None = None) -> DataFrame:
    """Each chunk becomes a member of its own, so no state is kept; members concatenate."""
    r = C.encode(F.col("chunk"), method, options)
    return chunks.select("stream_id", "seq", r["data"].alias("chunk"), "eof", r["status"].alias("status"))


#: ``last`` of a stream that has had its result, and of one whose end is not known.
ENDED, OPEN = -2, -1


def _decode(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, method: str, options: Options, most: int, wait: int | None) -> Iterator[pd.DataFrame]:
    seqs, chunks, last = state.get if state.exists else ([], [], OPEN)
    row = lambda *result: pd.DataFrame([(key[0], *result)], columns=["stream_id", "status", "detail", "data"])
    if state.hasTimedOut:
        state.remove()
        if last != ENDED:
            yield row(CORRUPT, f"no chunk for {wait} ms", None)
        return
    if last == ENDED:  # what comes after the result is left out
        if wait:
            state.setTimeoutDuration(wait)
        return
    held, bad = dict(zip(seqs, chunks, strict=True)), ""
    for frame in frames:
        for seq, chunk, eof in zip(frame["seq"], frame["chunk"], frame["eof"], strict=True):
            if seq in held:
                bad = f"chunk {seq} came twice"
            held[int(seq)] = bytes(chunk or b"")
            last = int(seq) if eof else last
    result = None
    if bad:
        result = (CORRUPT, bad, None)
    elif most and sum(map(len, held.values())) > most:
        result = (LIMIT, f"over {most} bytes wait for the end", None)
    elif last >= 0 and len(held) == last + 1 and max(held) == last:
        r = C.result(method, "decoder", b"".join(held[i] for i in range(last + 1)), options)
        result = (r["status"], r["detail"], r["data"])
    elif last >= 0 and max(held) > last:
        result = (CORRUPT, "a chunk follows the last", None)
    state.update((list(held), list(held.values()), last) if result is None else ([], [], ENDED))
    if wait:
        state.setTimeoutDuration(wait)
    if result is not None:
        yield row(*result)


def decode_stream(chunks: DataFrame, method: str = "gzip", options: dict | None = None, most_bytes: int | None = None, wait_ms: int | None = 3_600_000) -> DataFrame:
    """Streaming chunk rows to one row a stream, when it ends or goes wrong.

    Encoded chunks wait in the state, in any order, until all up to the last are there. A
    stream that holds more than ``most_bytes`` (the output limit; 0: no cap) ends with LIMIT, one that gets no
    chunk for ``wait_ms`` with CORRUPT. A stream that has ended is remembered for so long:
    chunks that come after its result are left out. A query that ends when its input does
    (``availableNow``) takes None, as Spark runs timeouts for ever: streams are then
    remembered for as long as the query's state.
    """
    opts = Options(options)
    most = registry.DEFAULT.schema(method).read(opts)["limits.max_output_bytes"] if most_bytes is None else most_bytes
    f = partial(_decode, method=method, options=opts, most=most, wait=wait_ms)
    return chunks.groupBy("stream_id").applyInPandasWithState(f, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if wait_ms else GroupStateTimeout.NoTimeout)
