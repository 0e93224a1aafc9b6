"""Transcript parsing by a hidden Markov model.

States are a role and whether a line opens its turn; observations are the line's speaker
marker, whether a blank line comes before it, and its look (whether it asks, and its length
class), which a state emits independently. Transitions and emissions are counted on
labelled transcripts. A transcript comes in pieces of lines whose borders say nothing about
its turns; Viterbi recovers where turns open and their roles. A conversation is cut into segments of bounded turns: max-plus matrices
of segments give the states at their borders, between which each segment is decoded apart,
so no task needs a whole conversation's lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecframe.llm.rows import column, extended, packed, unpacked
from codecframe.llm.store import Scratch

ROLES = ("user", "assistant", "system")
#: Speaker markers, fixed values.
MARKERS = {
    "user": ("user", "human", "q", "question", "prompter", "you"),
    "assistant": ("assistant", "ai", "bot", "a", "answer", "model"),
    "system": ("system", "instructions"),
}
_marker_role = {m: r for r, ms in MARKERS.items() for m in ms}
_marker = re.compile(r"\s*(?:<\|(\w+)\|>|\[(\w+)\]|#{1,4}\s*(\w+)\s*:?|\*\*(\w+):?\*\*:?|(\w+)\s*:)[ \t]*", re.ASCII)
#: Pieces (in fitting, turns) of a segment, and lines of a piece that ``transcripts`` cuts.
SEGMENT, LINES = 1024, 16
STATES = 2 * len(ROLES)  # 2 * role + (0 opens a turn, 1 goes on)
LOOKS = 2 * 4
SYMBOLS = 4 * 3 * LOOKS
NEVER = -1e30


def split_marker(line: str) -> tuple[int, str]:
    """Role named by the line's marker (3: none) and the line without it."""
    m = _marker.match(line)
    name = next((g for g in m.groups() if g), "").lower() if m else ""
    role = _marker_role.get(name)
    return (3, line) if role is None else (ROLES.index(role), line[m.end() :])


def symbol(line: str, before: int) -> int:
    """Observation; ``before`` is 0 after a line, 1 after a blank line, 2 where that is not known."""
    marker, rest = split_marker(line)
    size = 3 if not line.strip() else 0 if len(rest) < 60 else 1 if len(rest) < 300 else 2
    return ((marker * 3 + before) * 2 + rest.rstrip().endswith("?")) * 4 + size


def observe(text: str, before: int = 2) -> np.ndarray:
    """Observations of a piece's lines; what comes before the piece is not known unless given."""
    out = []
    for line in text.split("\n"):
        out.append(symbol(line, before))
        before = 0 if line.strip() else 1
    return np.array(out, np.int64)


class Model:
    """Log start, transition and emission probabilities from counts, add-half smoothed.

    A state may be followed by itself going on or by a turn's opening; only an opening
    state may come first. Marker, blank line before and look are counted apart, so that a
    marker tells the same wherever it stands; an unknown line before tells nothing.
    """

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        allowed = np.array([[b % 2 == 0 or a // 2 == b // 2 for b in range(STATES)] for a in range(STATES)])
        opening = np.arange(STATES) % 2 == 0
        norm = lambda x, ok: np.where(ok, np.log(np.where(ok, x + 0.5, 1) / np.where(ok, x + 0.5, 0).sum(-1, keepdims=True)), NEVER)
        self.start, self.move = norm(start, opening), norm(move, allowed)
        seen = emit.reshape(STATES, 4, 3, LOOKS)
        marker, before, look = (norm(x, np.ones_like(x, bool)) for x in (seen.sum((2, 3)), seen[:, :, :2].sum((1, 3)), seen.sum((1, 2))))
        before = np.concatenate([before, np.zeros((STATES, 1))], 1)
        self.emit = (marker[:, :, None, None] + before[:, None, :, None] + look[:, None, None, :]).reshape(STATES, SYMBOLS)


def matrix(model: Model, obs: np.ndarray, m: np.ndarray | None) -> np.ndarray:
    """Max-plus product: best score from each entry state (row 0..: before the segment) to each state."""
    for o in obs:
        step = model.move + model.emit[:, o]
        m = step if m is None else (m[:, :, None] + step[None]).max(1)
    return m


def viterbi(model: Model, obs: np.ndarray, entry: int, exit_: int) -> list[int]:
    """Best states between the state before the first line (-1: a start) and the last line's (-1: any)."""
    score = (model.start if entry < 0 else model.move[entry]) + model.emit[:, obs[0]]
    back = np.zeros((len(obs), STATES), np.int8)
    for t in range(1, len(obs)):
        all_ = score[:, None] + model.move
        back[t] = all_.argmax(0)
        score = all_.max(0) + model.emit[:, obs[t]]
    s = int(score.argmax()) if exit_ < 0 else exit_
    out = [s]
    for t in range(len(obs) - 1, 0, -1):
        s = int(back[t][s])
        out.append(s)
    return out[::-1]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows of a key; one bounded segment is held at a time."""
    key, held = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key is not None and row[:keys] != key:
                yield key, held
                held = []
            key = row[:keys]
            held.append(row[keys:])
    if held:
        yield key, held


def _learn_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, SYMBOLS))
    for (_, seg), rows in _groups(batches, 2):
        last, before = None, 2
        for _, text, role in rows:
            obs, before = observe(text, before).tolist(), int(not text.rpartition("\n")[2].strip())
            if role not in ROLES:
                last = None
                continue
            for i, o in enumerate(obs):
                s = 2 * ROLES.index(role) + (i > 0)
                emit[s, o] += 1
                if last is not None:
                    move[last, s] += 1
                elif seg == 0 and i == 0:
                    start[s] += 1
                last = s
    flat = np.concatenate([start, move.ravel(), emit.ravel()])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["at", "n"])


def _matrix_batches(batches: Iterator[pa.RecordBatch], model: object) -> Iterator[pa.RecordBatch]:
    for (conv, seg), rows in _groups(batches, 2):
        obs = np.concatenate([observe(t) for _, t in rows])
        rest = matrix(model.value, obs[1:], None)  # after the first line, None for only one
        first = model.value.move + model.value.emit[:, obs[0]]
        open_ = model.value.start + model.value.emit[:, obs[0]]
        m = first if rest is None else (first[:, :, None] + rest[None]).max(1)
        begin = open_ if rest is None else (open_[:, None] + rest).max(0)
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.string()), pa.array([seg], pa.int64()), pa.array([m.ravel().tolist()]), pa.array([begin.tolist()])], ["conv", "seg", "m", "begin"])


def _border_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States at the borders of each conversation's segments, by backtracking over them."""
    for (conv,), rows in _groups(batches, 1):
        scores = []
        for _, m, begin in rows:
            scores.append(np.array(begin) if not scores else (scores[-1][:, None] + np.array(m).reshape(STATES, STATES)).max(0))
        exits = [int(scores[-1].argmax())]
        for k in range(len(rows) - 1, 0, -1):
            exits.append(int((scores[k - 1] + np.array(rows[k][1]).reshape(STATES, STATES)[:, exits[-1]]).argmax()))
        exits = exits[::-1]
        yield pa.RecordBatch.from_arrays([pa.array([conv] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([-1, *exits[:-1]], pa.int32()), pa.array(exits, pa.int32())], ["conv", "seg", "entry", "exit"])


def _decode_batches(batches: Iterator[pa.RecordBatch], model: object) -> Iterator[pa.RecordBatch]:
    """(conv, seg, entry, exit, text, row), a segment's borders before its pieces, to (row, turns)."""
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("opens", pa.bool_()), ("line", pa.int64()), ("n_lines", pa.int64())]))
    for batch in _segments(batches):
        texts = [t or "" for t in batch.column(4).to_pylist()[1:]]
        obs = [observe(t) for t in texts]
        states = viterbi(model.value, np.concatenate(obs), batch.column(2)[0].as_py(), batch.column(3)[0].as_py())
        at, out = 0, []
        for text, o in zip(texts, obs, strict=True):
            turns: list[dict] = []
            for i, (line, s) in enumerate(zip(text.split("\n"), states[at : at + len(o)], strict=True)):
                opens = s % 2 == 0
                if opens or not turns:
                    turns.append({"role": ROLES[s // 2], "text": [], "opens": opens, "line": i})
                turns[-1]["text"].append(split_marker(line)[1] if opens else line)
            at += len(o)
            out.append([t | {"text": "\n".join(t["text"]).strip("\n"), "n_lines": len(t["text"])} for t in turns])
        yield pa.RecordBatch.from_arrays([batch.column(5).slice(1), pa.array(out, turn)], ["row", "turns"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a segment together; one is held at a time."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        at = 0
        for i in [*(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]:
            if i <= at:
                continue
            if held and keys[at] != key:
                yield pa.concat_batches(held)
                held = []
            key = keys[at]
            held.append(batch.slice(at, i - at))
            at = i
    if held:
        yield pa.concat_batches(held)


def _ordered(df: DataFrame, *cols: str) -> DataFrame:
    return df.repartition("conv", "seg").sortWithinPartitions("conv", "seg", "turn", "text").select("conv", "seg", *cols)


def _pieces(rows: DataFrame, conv: str, turn: str, text: str) -> DataFrame:
    return rows.withColumns(
        {
            "conv": F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")),
            "turn": F.coalesce(F.col(turn).cast("long"), F.lit(0)),
            "text": F.coalesce(F.col(text), F.lit("")),
        }
    ).withColumn("seg", F.floor(F.col("turn") / SEGMENT).cast("long"))


def fit(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", role: str = "role") -> Model:
    """Count the model on transcripts given as labelled turns, one a row, that follow each other
    line by line; other roles and null are passed over."""
    pieces = _pieces(rows.withColumn("role", F.col(role)), conv, turn, text)
    counts = _ordered(pieces, "turn", "text", "role").mapInArrow(_learn_batches, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(STATES + STATES * STATES + STATES * SYMBOLS)
    for r in counts:  # a fixed number of parameters
        flat[r["at"]] = r["n"]
    a, b = STATES, STATES + STATES * STATES
    return Model(flat[:a], flat[a:b].reshape(STATES, STATES), flat[b:].reshape(STATES, SYMBOLS))


def parse(rows: DataFrame, model: Model, conv: str = "conv_id", turn: str = "turn", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``turns`` to the columns ``keep`` of ``rows`` (all if None): the piece's (role,
    text without marker, opens, first line in the piece, lines) in order.

    A row is a piece of a transcript, whole lines of any number of turns, in the order of
    ``turn`` (null: 0; ties by text); a piece that goes on with the turn before has a first
    element that does not open one. Where pieces end is not taken as a sign of a turn.
    Null text is an empty piece; a null conversation is one of its own;
    repeated rows are pieces each; other columns stay, under any name, ``turns`` is
    replaced; an empty table gives an empty result. A segment has the pieces of ``SEGMENT``
    values of ``turn``, and is held by one task.
    """
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(model)  # a fixed number of parameters
    kept = [c for c in (rows.columns if keep is None else keep) if c != "turns"]
    base = rows.select(packed(kept), column(conv).alias("conv"), column(turn).alias("turn"), column(text).alias("text"))
    scratch = Scratch(spark, "chat")
    pieces = scratch.table(_pieces(base, "conv", "turn", "text"), "pieces")  # read twice
    mats = _ordered(pieces, "turn", "text").mapInArrow(partial(_matrix_batches, model=sent), "conv string, seg long, m array<double>, begin array<double>")
    borders = mats.repartition("conv").sortWithinPartitions("conv", "seg").mapInArrow(_border_batches, "conv string, seg long, entry int, exit int")
    borders = scratch.table(borders, "borders").withColumn("piece", F.lit(False))
    # borders come first in their segment, so that no join moves the texts once more
    both = pieces.withColumn("piece", F.lit(True)).unionByName(borders, allowMissingColumns=True).withColumn("tie", F.xxhash64("row"))
    dealt = both.repartition("conv", "seg").sortWithinPartitions("conv", "seg", "piece", "turn", "text", "tie").select("conv", "seg", "entry", "exit", "text", "row")
    turns = "turns array<struct<role:string,text:string,opens:boolean,line:long,n_lines:long>>"
    return dealt.mapInArrow(partial(_decode_batches, model=sent), extended([base.schema["row"]], turns)).select(*unpacked(kept), "turns")


def transcripts(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", role: str = "role") -> DataFrame:
    """Turns joined line by line and cut into pieces of ``LINES`` lines, wherever turns end:
    conversation, ``piece``, ``text`` and ``truth``, for each line twice its role's place in
    ``ROLES`` (-1: another or null), plus one unless the line opens its turn.

    Turns follow in the order of ``turn`` (null: 0; ties by text and role); null text is an
    empty line; a null conversation is one of its own; repeated rows are turns each.
    """
    place = F.coalesce(*[F.when(F.col("role") == r, i) for i, r in enumerate(ROLES)], F.lit(-1))
    turns = _pieces(rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(text).alias("text"), F.col(role).alias("role")), "conv_id", "turn", "text")
    turns = turns.withColumns({"place": place, "lines": F.split("text", "\n", -1)}).withColumn("n", F.size("lines").cast("long"))
    before = lambda *of: Window.partitionBy(*of).rowsBetween(Window.unboundedPreceding, -1)
    sums = turns.groupBy("conv", "seg").agg(F.sum("n").alias("n"))  # a row for many turns
    sums = sums.select("conv", "seg", F.coalesce(F.sum("n").over(before("conv").orderBy("seg")), F.lit(0)).alias("seg_at"))
    turns = turns.withColumn("at", F.coalesce(F.sum("n").over(before("conv", "seg").orderBy("turn", "text", "role")), F.lit(0)))
    turns = turns.join(sums, ["conv", "seg"]).withColumn("at", F.col("at") + F.col("seg_at"))
    cut = turns.withColumn("piece", F.explode(F.expr(f"sequence(at div {LINES}, (at + n - 1) div {LINES})")))
    cut = cut.withColumns({"from": F.expr(f"greatest(at, piece * {LINES})"), "to": F.expr(f"least(at + n, (piece + 1) * {LINES})")})
    opens = F.col("from") == F.col("at")
    length = (F.col("to") - F.col("from")).cast("int")
    truth = F.concat(F.array(F.col("place") * 2 + F.when(opens, 0).otherwise(1)), F.array_repeat(F.col("place") * 2 + 1, length - 1))
    part = F.struct("from", F.array_join(F.slice("lines", (F.col("from") - F.col("at") + 1).cast("int"), length), "\n").alias("text"), truth.alias("truth"))
    parts = cut.groupBy("conv", "piece").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(part)).alias("parts"))  # LINES parts at most
    return parts.select("conv_id", "piece", F.array_join(F.col("parts.text"), "\n").alias("text"), F.flatten(F.col("parts.truth")).alias("truth"))


def render(turns: Column) -> Column:
    """Canonical text of an array of turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n"))), "")


def mark(conv: Column, turn: Column, role: Column, text: Column) -> Column:
    """A turn as transcript text: marker styles by conversation; some turns have no marker."""
    style = F.pmod(F.xxhash64(conv), F.lit(4))
    bare = (F.pmod(F.xxhash64(conv, turn), F.lit(5)) == 0) & (turn > 0)
    name = F.initcap(role)
    user = role == "user"
    human = F.when(user, "Human").when(role == "assistant", "AI").otherwise(name)
    short = F.when(user, "Q").when(role == "assistant", "A").otherwise(name)
    head = F.when(style == 0, F.concat(name, F.lit(": "))).when(style == 1, F.concat(F.lit("### "), human, F.lit(": "))).when(style == 2, F.concat(F.lit("<|"), role, F.lit("|>"))).otherwise(F.concat(short, F.lit(": ")))
    return F.concat(F.when(bare, "").otherwise(F.coalesce(head, F.lit(""))), F.coalesce(text, F.lit("")))
