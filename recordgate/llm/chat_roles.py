"""Chat formatting: roles of transcript lines by a hidden Markov model, then turns in one form.

Lines of a transcript are the observations: the word of a speaker marker at their start, if
there is one, whether they open a row, and a few features of the text.  The role a row is
given is no observation: it is the label that the model is fitted with, on conversations
outside the held-out third, by counting.  States are a role and whether its turn begins on
the line.  Viterbi's best path gives each line its role, lines of one turn are joined, and turns
are rendered alike whatever the transcript's own style was.

A long conversation is cut into segments of so many rows in its order.  A segment is
summed up by a matrix, best score from any state before it to any state at its end, so
a conversation of any length takes three steps: matrices of its segments, the best states
at their borders, and the best path inside each segment between its borders.  Segments
are dealt to tasks by hash; none holds a whole long conversation.  Turns are numbered by
prefix sums over the segments, and the pieces of a turn that crosses borders are joined
before it is rendered, so the result does not depend on where segments end.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import parts_for, staged, text_or_empty

ROLES = ("system", "user", "assistant")
#: A word before a colon or a bracket at the start of a line, with the signs that transcripts put around it.
_MARKER = re.compile(r"\s*(?:[#>*<|\[(-]+\s*)?(\w{1,20})(?:\s*\d+)?\s*[*|]*[:>\])]+[*|]*[ \t]*")
#: Rows of one segment, and lines of one Python group.
SEGMENT = 512
GROUP_ROWS = 20_000
#: Rows of transcripts that fitting reads, about, and marker words that the model tells apart, by how often they occur.
FIT_ROWS, MARKER_WORDS = 400_000, 500
#: States: role * 2 + (1 if the role's turn goes on).
STATES = 2 * len(ROLES)
_NEVER = -1e9
#: Added to every count.
_PRIOR = 0.2
#: Features of a line: ends with a question mark or not, times steps of length.
_LENGTHS = (0, 20, 60, 160, 400)
_SHAPES = 2 * (len(_LENGTHS) + 1)

#: Markers of system, user and assistant in transcripts of different styles.
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("### Instruction: ", "### Human: ", "### AI: "),
    ("<|system|> ", "<|user|> ", "<|assistant|> "),
    ("[sys] ", "[me] ", "[bot] "),
    ("**Context:** ", "**Customer:** ", "**Agent:** "),
    ("S: ", "Q: ", "A: "),
)
#: Of so many rows of a transcript about one has no marker.
WITHOUT_MARKER = 4


def transcripts(messages: DataFrame, styles=STYLES, without_marker: int = WITHOUT_MARKER) -> DataFrame:
    """messages (conv_id, turn, role, text) -> the same columns, texts as in transcripts.

    The style is one for a conversation; about one row in without_marker, and every row of an
    unknown role, has no marker.
    """
    conv, role = F.col("conv_id").cast("string"), F.lower(F.trim(F.col("role").cast("string")))
    style = F.pmod(F.xxhash64(conv, F.lit("style")), F.lit(len(styles)))
    bare = F.pmod(F.xxhash64(conv, "turn", "text"), F.lit(without_marker)) == 0
    marker = F.lit("")
    for k, names in enumerate(styles):
        for name, text in zip(ROLES, names, strict=True):
            marker = F.when((style == k) & (role == name), text).otherwise(marker)
    return messages.select("conv_id", "turn", "role", F.concat(F.when(bare, "").otherwise(marker), text_or_empty()).alias("text"))


def held_out(conv) -> F.Column:
    """True for the third of conversations that is never learned from."""
    return F.coalesce(F.crc32(conv.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def marker_of(line: str) -> str:
    """The word of a marker at the start of a line; empty if there is none."""
    m = _MARKER.match(line)
    return m.group(1).lower() if m else ""


def shape_of(line: str) -> int:
    line = line.strip()
    return 2 * int(np.searchsorted(_LENGTHS, len(line))) + line.endswith("?")


@dataclass
class Model:
    """Log probabilities, by state."""

    start: np.ndarray
    steps: np.ndarray
    #: Number of each marker word that is told apart; 0 is none, and the last is any other.
    words: dict[str, int]
    #: Whether a word is the marker of one role and no part of what is said.
    marks: np.ndarray
    #: By (opens a row, marker word) and by shape.
    markers: np.ndarray
    shapes: np.ndarray

    def word(self, line: str) -> int:
        found = marker_of(line)
        return self.words.get(found, len(self.marks) - 1) if found else 0

    def emissions(self, lines: list[tuple[str, bool]]) -> np.ndarray:
        """lines (text, opens its row) -> log probabilities by state."""
        return np.array([self.markers[int(first), self.word(text)] + self.shapes[shape_of(text)] for text, first in lines]).reshape(-1, STATES)

    def without_marker(self, line: str) -> str:
        return line[_MARKER.match(line).end() :] if self.marks[self.word(line)] else line


def model_of(counts: list[tuple[str, str, int, int, int]]) -> Model:
    """counts (kind, marker word, row or state before, state, n); kinds: start, step, marker, shape."""
    start, steps = np.full(STATES, _PRIOR), np.full((STATES, STATES), _PRIOR)
    shapes, often = np.full((_SHAPES, STATES), _PRIOR), Counter()
    for kind, word, at, state, n in counts:
        if kind == "start":
            start[state] += n
        elif kind == "step":
            steps[at, state] += n
        elif kind == "shape":
            shapes[at, state] += n
        elif word:
            often[word] += n
    chosen = sorted(sorted(often, key=lambda w: (-often[w], w))[:MARKER_WORDS])
    words = {w: k + 1 for k, w in enumerate(chosen)}
    markers = np.zeros((2, len(words) + 2, STATES))
    for kind, word, at, state, n in counts:
        if kind == "marker":
            markers[at, words.get(word, len(words) + 1) if word else 0, state] += n
    by_word = markers.sum(0)
    marks = (by_word.sum(1) >= 5) & (by_word[:, ::2].max(1, initial=0) >= 0.9 * by_word.sum(1))
    marks[[0, -1]] = False
    markers += _PRIOR
    log = lambda x: np.log(x / x.sum())
    start = np.where(np.arange(STATES) % 2 == 0, start, 0)
    with np.errstate(divide="ignore"):
        start = np.maximum(log(start), _NEVER)
        for a in range(STATES):
            for b in range(1, STATES, 2):
                if a // 2 != b // 2:  # a turn that goes on keeps its role
                    steps[a, b] = 0
        steps = np.stack([np.maximum(log(row), _NEVER) for row in steps])
    return Model(start, steps, words, marks, np.log(markers / markers.sum((0, 1))), np.log(shapes / shapes.sum(0)))


def segment_matrix(e: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Best score from each state before the lines to each state at the last of them."""
    m = steps + e[0][None, :]
    for row in e[1:]:
        m = (m[:, :, None] + steps[None, :, :]).max(1) + row[None, :]
    return m


def best_path(e: np.ndarray, steps: np.ndarray, entry: np.ndarray, last: int | None) -> list[int]:
    """Best states for lines, from entry scores of the first line's states to a given last state (or the best)."""
    score, back = entry + e[0], []
    for row in e[1:]:
        reach = score[:, None] + steps
        back.append(reach.argmax(0))
        score = reach.max(0) + row
    path = [int(score.argmax()) if last is None else last]
    for pointers in reversed(back):
        path.append(int(pointers[path[-1]]))
    return path[::-1]


def rendered(role: int, lines: list[str]) -> str:
    return f"<|{ROLES[role]}|>\n" + "\n".join(lines).strip() + "\n<|end|>"


def _lines(texts: list[str]) -> list[tuple[str, bool]]:
    return [(line, k == 0) for text in texts for k, line in enumerate(text.split("\n"))]


def _rows_by_segment(table: pa.Table):
    """(conv, seg, texts, roles) of every segment in a group, rows in order."""
    rows = table.sort_by([(c, "ascending") for c in ("conv", "seg", "dated", "turn", "text")])
    conv, seg = rows.column("conv").to_pylist(), rows.column("seg").to_pylist()
    texts, roles = rows.column("text").to_pylist(), rows.column("role").to_pylist()
    start = 0
    for k in range(1, len(conv) + 1):
        if k == len(conv) or (conv[k], seg[k]) != (conv[start], seg[start]):
            yield conv[start], seg[start], texts[start:k], roles[start:k]
            start = k


def _counted(table: pa.Table) -> pa.Table:
    """Counts of what is seen in the conversations of a group, for model_of."""
    seen: Counter = Counter()
    for _, _, texts, roles in _rows_by_segment(table):
        before = None
        for k, (text, role) in enumerate(zip(texts, roles, strict=True)):
            if role not in ROLES:
                before = None
                continue
            for n, line in enumerate(text.split("\n")):
                state = 2 * ROLES.index(role) + (n > 0)
                if k == 0 and n == 0:
                    seen["start", "", 0, state] += 1
                elif before is not None:
                    seen["step", "", before, state] += 1
                seen["marker", marker_of(line), int(n == 0), state] += 1
                seen["shape", "", shape_of(line), state] += 1
                before = state
    columns = list(zip(*((*key, n) for key, n in seen.items()), strict=True)) if seen else [[], [], [], [], []]
    kinds = [("kind", pa.string()), ("word", pa.string()), ("at", pa.int32()), ("state", pa.int32()), ("n", pa.int64())]
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(kinds, columns, strict=True)})


_TURNS = "conv string, turn_no long, role string, n_lines long, content string, rendered string"
#: Pieces of turns as a segment has them; at_border: the turn may go on in the segment before or after.
_PIECES = "conv string, seg long, place long, role string, n_lines long, continued boolean, at_border boolean, content string"


def _pieces(conv, seg, path: list[int], lines, model: Model) -> list[tuple]:
    out, start = [], 0
    for k in range(1, len(path) + 1):
        if k == len(path) or path[k] % 2 == 0:
            continued = path[start] % 2 == 1
            own = [model.without_marker(t) if n == 0 and not continued else t for n, (t, _) in enumerate(lines[start:k])]
            out.append((conv, seg, len(out), ROLES[path[start] // 2], k - start, continued, continued or k == len(path), "\n".join(own)))
            start = k
    return out


def _piece_table(rows: list[tuple]) -> pa.Table:
    kinds = [("conv", pa.string()), ("seg", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("n_lines", pa.int64()),
             ("continued", pa.bool_()), ("at_border", pa.bool_()), ("content", pa.string())]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(kinds, columns, strict=True)})


def whole_turns(pieces: DataFrame) -> DataFrame:
    """Pieces of the segments of long conversations -> whole turns, numbered from 0 in their conversation."""
    opened = F.sum((~F.col("continued")).cast("long"))
    starts = pieces.groupBy("conv", "seg").agg(opened.alias("n"), F.max(F.col("continued").cast("long")).alias("led"))
    # The number of a segment's first piece: the turns before it, less one if it goes on with the last of these.
    first = F.sum("n").over(Window.partitionBy("conv").orderBy("seg")) - F.col("n") - F.col("led")
    starts = starts.select(F.col("conv").alias("start_conv"), F.col("seg").alias("start_seg"), first.alias("first"))
    numbered = pieces.join(starts, F.col("conv").eqNullSafe(F.col("start_conv")) & (F.col("seg") == F.col("start_seg")))
    numbered = numbered.withColumn("turn_no", F.col("first") + F.col("place"))
    inner = numbered.where("not at_border").select("conv", "turn_no", "role", "n_lines", "content")
    joined = numbered.where("at_border").groupBy("conv", "turn_no").agg(
        F.array_sort(F.collect_list(F.struct("seg", "role", "n_lines", "content"))).alias("own")
    )
    lines = F.aggregate("own", F.lit(0).cast("long"), lambda n, x: n + x["n_lines"])
    joined = joined.select("conv", "turn_no", F.col("own")[0]["role"].alias("role"), lines.alias("n_lines"), F.array_join("own.content", "\n").alias("content"))
    return inner.unionByName(joined)


def _rendered(batches):
    for batch in batches:
        conv, turn_no, role, n_lines, content = batch.columns
        texts = [c.strip() for c in content.to_pylist()]
        full = [rendered(ROLES.index(r), [t]) for r, t in zip(role.to_pylist(), texts, strict=True)]
        columns = [conv, turn_no, role, n_lines, pa.array(texts, pa.string()), pa.array(full, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["conv", "turn_no", "role", "n_lines", "content", "rendered"])


def in_segments(rows: DataFrame, segment: int) -> DataFrame:
    """rows (conv, dated, turn, role, text) with seg: the row's number in its conversation's order over segment.

    Rows are dealt to slices of the common order, numbered in their slice, and slices are
    added up, so no task holds a conversation; rows alike in all may take each other's places.
    """
    order = ["conv", "dated", "turn", "text", "tie"]
    tied = staged(rows.withColumn("tie", F.monotonically_increasing_id()), "long-rows")
    slices = tied.repartitionByRange(parts_for(tied.count(), GROUP_ROWS), *order).sortWithinPartitions(*order).drop("tie")
    # The id is the slice, and the row's place in it in the lower 33 bits.
    placed = staged(slices.withColumn("at", F.monotonically_increasing_id()).withColumn("slice", F.shiftright("at", 33)), "placed-rows")
    runs = placed.groupBy("conv", "slice").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("slice")) - F.col("n")
    runs = runs.select(F.col("conv").alias("run_conv"), F.col("slice").alias("run_slice"), (before - F.col("first")).alias("shift"))
    numbered = placed.join(runs, F.col("conv").eqNullSafe(F.col("run_conv")) & (F.col("slice") == F.col("run_slice")))
    return numbered.select(*rows.columns, F.floor((F.col("at") + F.col("shift")) / segment).cast("long").alias("seg"))


def border_states(summed: DataFrame, model: Model, most: int = 4096) -> DataFrame:
    """summed (conv, seg, matrix, entered) -> (conv, seg, before, last): states before and at the end of each segment.

    before is -1 where a conversation starts.  A conversation of more than most segments is solved block by block:
    products of the matrices of most segments each are solved alike first, and say where its blocks begin and end.
    """

    def ends(table: pa.Table, before: int, last: int) -> pa.Table:
        table = table.sort_by("seg")
        ms, back = table.column("matrix").to_pylist(), []
        score = np.array(table.column("entered")[0].as_py()) if before < 0 else np.array(ms[0]).reshape(STATES, STATES)[before]
        for m in ms[1:]:
            reach = score[:, None] + np.array(m).reshape(STATES, STATES)
            back.append(reach.argmax(0))
            score = reach.max(0)
        path = [int(score.argmax()) if last < 0 else last]
        for pointers in reversed(back):
            path.append(int(pointers[path[-1]]))
        path = path[::-1]
        return pa.table({"conv": table.column("conv"), "seg": table.column("seg"), "before": pa.array([before, *path[:-1]], pa.int32()), "last": pa.array(path, pa.int32())})

    schema = "conv string, seg long, before int, last int"
    if (summed.agg(F.max("seg")).first()[0] or 0) < most:
        return summed.groupBy("conv").applyInArrow(lambda t: ends(t, -1, -1), schema)

    def product(table: pa.Table) -> pa.Table:
        table = table.sort_by("seg")
        m, entered = None, np.array(table.column("entered")[0].as_py())
        for k, x in enumerate(table.column("matrix").to_pylist()):
            x = np.array(x).reshape(STATES, STATES)
            if k:
                entered = (entered[:, None] + x).max(0)
            m = x if m is None else (m[:, :, None] + x[None, :, :]).max(1)
        return pa.table({"conv": table.column("conv")[:1], "seg": pa.array([table.column("block")[0].as_py()], pa.int64()),
                         "matrix": pa.array([m.ravel().tolist()]), "entered": pa.array([entered.tolist()])})

    blocks = summed.withColumn("block", F.floor(F.col("seg") / most).cast("long"))
    whole = staged(blocks.groupBy("conv", "block").applyInArrow(product, summed.schema), "segment-blocks")
    known = border_states(whole, model, most).withColumnsRenamed({"conv": "edge_conv", "seg": "edge_block"})
    inner = blocks.join(known, F.col("conv").eqNullSafe(F.col("edge_conv")) & (F.col("block") == F.col("edge_block")))
    solve = lambda t: ends(t, t.column("before")[0].as_py(), t.column("last")[0].as_py())
    return inner.groupBy("conv", "block").applyInArrow(solve, schema)


def _rows(messages: DataFrame) -> DataFrame:
    """messages as (conv, turn, role, text, dated)."""
    return messages.select(
        F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.lower(F.trim(F.col("role").cast("string"))).alias("role"), text_or_empty().alias("text"),
    ).withColumn("dated", F.col("turn").isNotNull().cast("int"))


def fit_roles(messages: DataFrame, rows: int = FIT_ROWS, segment: int = SEGMENT) -> Model:
    """A model of transcripts (conv_id, turn, role, text), roles being the labels, by counting.

    It is fitted on conversations of at most segment rows outside the held-out third, on about rows
    rows of them, taken by a hash of conv_id.  Rows of other roles, or none, teach nothing; with
    no rows to learn from all roles are alike.
    """
    known = _rows(messages).where(F.col("conv").isNotNull() & ~held_out(F.col("conv")))
    share = parts_for(messages.count(), rows)
    known = known.where(F.pmod(F.xxhash64("conv", F.lit("fit")), F.lit(share)) == 0)
    long = known.groupBy("conv").count().where(F.col("count") > segment).select("conv")
    known = known.join(staged(long, "long-conversations"), "conv", "left_anti").withColumn("seg", F.lit(0).cast("long"))
    dealt = known.withColumn("part", F.pmod(F.xxhash64("conv"), F.lit(parts_for(rows, GROUP_ROWS))))
    counts = dealt.groupBy("part").applyInArrow(_counted, "kind string, word string, at int, state int, n long")
    total = counts.groupBy("kind", "word", "at", "state").agg(F.sum("n").alias("n"))
    # Of the marker words only the most frequent come to the driver.
    words = total.where("word <> ''").groupBy("word").agg(F.sum("n").alias("often")).orderBy(F.desc("often"), "word").limit(MARKER_WORDS)
    shown = total.join(F.broadcast(words.withColumnRenamed("word", "shown")), F.col("word") == F.col("shown"), "left")
    word = F.when(F.col("word") == "", "").otherwise(F.coalesce("shown", F.lit("\u0000")))
    got = shown.groupBy("kind", word.alias("word"), "at", "state").agg(F.sum("n").alias("n")).collect()
    return model_of([tuple(r) for r in got])


def chat_turns(messages: DataFrame, model: Model, segment: int = SEGMENT) -> DataFrame:
    """messages (conv_id, turn, role, text, ...) -> a row per turn found.

    Columns: conv_id, held_out, turn_no (from 0 in its conversation), role, n_lines, content, rendered.
    Lines come in order of turn (nulls first), then text; repeated rows are lines of their own.
    The role column is not looked at.  Null and empty texts are one empty line.  Rows whose conv_id is
    null form one conversation.  Other columns are not read; no rows give no rows.
    """
    rows = _rows(messages).drop("role").withColumn("role", F.lit(None).cast("string"))
    # Conversations of several segments are few, or long; the others take one step.
    long = rows.groupBy("conv").count().where(F.col("count") > segment)
    long = staged(long.select(F.col("conv").alias("long_conv")), "long-conversations")
    groups = parts_for(messages.count(), GROUP_ROWS)
    part = F.pmod(F.xxhash64("conv", "seg"), F.lit(groups))
    same = F.col("conv").eqNullSafe(F.col("long_conv"))
    short = rows.join(long, same, "left_anti").withColumn("seg", F.lit(0).cast("long")).withColumn("part", part)

    def whole(table: pa.Table) -> pa.Table:
        out = []
        for conv, seg, texts, _ in _rows_by_segment(table):
            lines = _lines(texts)
            out += _pieces(conv, seg, best_path(model.emissions(lines), model.steps, model.start, None), lines, model)
        return _piece_table(out)

    found = short.groupBy("part").applyInArrow(whole, _PIECES).select("conv", F.col("place").alias("turn_no"), "role", "n_lines", "content")
    if long.limit(1).count():
        parts = staged(in_segments(rows.join(long, same, "left_semi"), segment).withColumn("part", part), "long-conversation-rows")

        def matrices(table: pa.Table) -> pa.Table:
            out = [(conv, seg, segment_matrix(e, model.steps).ravel().tolist(), _entered(e, model).tolist())
                   for conv, seg, texts, _ in _rows_by_segment(table) for e in [model.emissions(_lines(texts))]]
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            kinds = (pa.string(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            return pa.table({n: pa.array(c, t) for n, c, t in zip(("conv", "seg", "matrix", "entered"), columns, kinds, strict=True)})

        summed = staged(parts.groupBy("part").applyInArrow(matrices, "conv string, seg long, matrix array<double>, entered array<double>"), "segments")

        edges = border_states(summed, model)
        edges = edges.withColumnsRenamed({"conv": "edge_conv", "seg": "edge_seg"})
        bounded = parts.join(edges, F.col("conv").eqNullSafe(F.col("edge_conv")) & (F.col("seg") == F.col("edge_seg")))

        def inside(table: pa.Table) -> pa.Table:
            edge = {(c, s): (b, z) for c, s, b, z in zip(*(table.column(n).to_pylist() for n in ("conv", "seg", "before", "last")), strict=True)}
            out = []
            for conv, seg, texts, _ in _rows_by_segment(table):
                lines = _lines(texts)
                before, last = edge[(conv, seg)]
                entry = model.start if before < 0 else model.steps[before]
                out += _pieces(conv, seg, best_path(model.emissions(lines), model.steps, entry, last), lines, model)
            return _piece_table(out)

        pieces = staged(bounded.groupBy("part").applyInArrow(inside, _PIECES), "turn-pieces")
        found = found.unionByName(whole_turns(pieces))
    turns = found.mapInArrow(_rendered, _TURNS)
    return turns.select(F.col("conv").alias("conv_id"), held_out(F.col("conv")).alias("held_out"), "turn_no", "role", "n_lines", "content", "rendered")


def _entered(e: np.ndarray, model: Model) -> np.ndarray:
    """Best scores of the last line's states when the lines open the conversation."""
    score = model.start + e[0]
    for row in e[1:]:
        score = (score[:, None] + model.steps).max(0) + row
    return score
