"""Chat formatting: each assistant turn becomes an example with all turns before it as context."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written_table

START, END = "<|im_start|>", "<|im_end|>\n"
TARGET = "assistant"


def escape(text: str) -> str:
    """`text` without `<|`: one backslash more between `<` and `|`, whatever backslashes are there."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _plain_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


#: The columns of a prefix row besides the conversation's id.
COLUMNS = ("place bigint, turn bigint, start bigint, piece string, example bigint, loss_start bigint, loss_end bigint")

#: Code points of texts that go to a task's output at once.
_CHUNK = 1 << 22


def _placed(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """Formatted turns with their place, and sums of their run: the turns of a conversation in one part.

    Parts are ranges of conversation and turn, so that a conversation of any share of the rows is
    dealt over many parts. What is held is one batch.
    """
    kind = turns.schema[conversation].dataType.simpleString()
    rows = turns.select(
        F.col(conversation).alias("_c"), F.col(turn).cast("long").alias("_t"),
        F.coalesce(F.col(role), F.lit("")).alias("_r"), F.coalesce(F.col(text), F.lit("")).alias("_x"))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "_c", "_t").sortWithinPartitions("_c", "_t", "_r", "_x")
    names = ["_c", "place", "turn", "part", "start", "piece", "chars", "head", "reply", "replies"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        now, begun, chars, replies, held = None, False, 0, 0, 0
        out: list[tuple] = []
        for batch in batches:
            own = [batch.schema.types[0], *types]
            for i in range(batch.num_rows):
                c, t, r, x = (column[i].as_py() for column in batch.columns)
                if not begun or c != now:
                    now, begun, chars, replies = c, True, 0, 0
                head, said = f"{START}{_role(r)}\n", escape(x)
                piece = f"{head}{said}{END}"
                reply = len(said) if r == TARGET else None
                out.append((c, (part << 40) + at, t, part, chars, piece, len(piece), len(head), reply, replies))
                at, chars, replies, held = at + 1, chars + len(piece), replies + (r == TARGET), held + len(piece)
                if held > _CHUNK:
                    yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*out), own)], names=names)
                    out, held = [], 0
            if out:
                yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*out), own)], names=names)
                out, held = [], 0

    return rows.mapInArrow(run_sums, f"_c {kind}, place bigint, turn bigint, part bigint, start bigint, piece string, "
                                     "chars bigint, head bigint, reply bigint, replies bigint")


def prefix_examples(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn",
                    role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn; every assistant turn is an example whose prefix is named by its place.

    The text of the example of a row is the `piece` of all rows of its conversation with a `place`
    up to its own, joined in order of `place`. Only code points `loss_start` to `loss_end` of that
    text, the reply, are trainable; all before it is context. `example` numbers the replies of a
    conversation from 0; it and the span are null for turns that are no reply. `start` is the code
    points before the piece. So the output grows with the input and not with the square of a
    conversation's length, and its rows may be dealt anew or stored in any order;
    `render_examples` writes the full texts out.

    Turns are marked `<|im_start|>role`, newline, text, `<|im_end|>`, newline. Within texts and
    roles `<|` is escaped reversibly, so no text can make or end a turn. A null role or text
    counts as empty. Rows are ordered by turn, then by role and text, so repeated turns have a
    fixed order; each is a turn of its own. Rows without an id form one conversation. Other input
    columns are left out. An empty table gives an empty one.

    Conversations are cut into runs, at most one per part; the running sums within a run are made
    where the turns are formatted, and those of earlier runs come from one row per run. Only the
    runs after the first of a conversation get an offset: at most one per part.
    """
    placed = written_table(_placed(turns, conversation, turn, role, text), "llm-chat-runs")
    runs = placed.groupBy("_c", "part").agg(F.sum("chars").alias("_chars"), F.count("reply").alias("_replies"))
    before = Window.partitionBy("_c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cut = placed.groupBy("_c").agg(F.min("part").alias("_low"), F.max("part").alias("_high")).filter("_low < _high")
    cut = cut.withColumnRenamed("_c", "_of")
    # A part has one first and one last conversation; all others lie in it whole.
    runs = runs.join(cut, F.col("_c").eqNullSafe(F.col("_of")), "left_semi")
    offsets = runs.select(F.col("_c").alias("_of"), F.col("part").alias("_part"), F.coalesce(F.sum("_chars").over(before), F.lit(0)).alias("_skip"),
                          F.coalesce(F.sum("_replies").over(before), F.lit(0)).alias("_said"))
    same = F.col("_c").eqNullSafe(F.col("_of")) & (F.col("part") == F.col("_part"))
    rows = placed.join(F.broadcast(offsets), same, "left")
    start = F.col("start") + F.coalesce("_skip", F.lit(0))
    said = F.col("reply").isNotNull()
    return rows.select(
        F.col("_c").alias(conversation), "place", "turn", start.alias("start"), "piece",
        F.when(said, F.col("replies") + F.coalesce("_said", F.lit(0))).alias("example"),
        F.when(said, start + F.col("head")).alias("loss_start"),
        F.when(said, start + F.col("head") + F.col("reply")).alias("loss_end"))


#: Code points of a conversation whose examples one task puts together, after all text before them.
_STRETCH = 1 << 20


def whole_texts(examples: DataFrame, conversation: str = "conv_id", stretch: int = _STRETCH) -> DataFrame:
    """Conversation, example, text, loss_start, loss_end and last: each example with all turns before it.

    Takes the rows of `prefix_examples` in any order. `last` marks the row that holds a whole
    conversation; where that does not end in a reply, it is one row more, without example and span.

    Conversations are cut by `start` into stretches. A stretch's task gets the text of each stretch
    before it as one row, then its own turns in order, and puts the texts together as it reads.
    So the texts, which grow with the square of a conversation, are neither shuffled nor written,
    and what is held are two texts and a batch. A text is one string: at most 2 GB.
    """
    kind = examples.schema[conversation].dataType.simpleString()
    rows = examples.select(
        F.col(conversation).alias("_c"), F.floor(F.col("start") / stretch).cast("long").alias("_at"), F.lit(True).alias("_own"),
        "place", "piece", "example", "loss_start", "loss_end")
    # At most one conversation for `stretch` code points of the table has more than one stretch.
    long = rows.filter("_at > 0").groupBy(F.col("_c").alias("_of")).agg(F.max("_at").alias("_end"))
    rows = rows.join(F.broadcast(long), F.col("_c").eqNullSafe(F.col("_of")), "left").drop("_of")
    pieces = F.array_sort(F.collect_list(F.struct("place", "piece")))
    done = rows.filter("_at < _end").groupBy("_c", F.col("_at").alias("_no")).agg(
        F.concat_ws("", F.transform(pieces, lambda p: p["piece"])).alias("piece"))
    later = rows.filter("_end IS NOT NULL AND _at > 0").select(F.col("_c").alias("_of"), "_at", "_end").distinct()
    before = done.join(later, F.col("_c").eqNullSafe(F.col("_of")) & (F.col("_no") < F.col("_at"))).select(
        "_c", "_at", F.lit(False).alias("_own"), F.col("_no").alias("place"), "piece", "_end")
    both = rows.unionByName(before, allowMissingColumns=True)
    both = both.repartition("_c", "_at").sortWithinPartitions("_c", "_at", "_own", "place")
    both = both.select("_c", "_at", "_own", "piece", "example", "loss_start", "loss_end", "_end")
    names = [conversation, "example", "text", "loss_start", "loss_end", "last"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, reply, tail, ends, of = None, [], None, False, False, None
        out: list[tuple] = []
        held = 0

        def batch_of() -> pa.RecordBatch:
            return pa.record_batch([pa.array(v, k) for v, k in zip(zip(*out), [of, *types])], names=names)

        def close() -> list[tuple]:
            """The stretch's last example, and the whole conversation if turns follow it."""
            rest = [] if reply is None else [(*reply, ends and not tail)]
            if now and ends and tail:
                rest.append((now[0], None, "".join(parts), None, None, True))
            return rest

        for batch in batches:
            of = batch.schema.types[0]
            for i in range(batch.num_rows):
                c, at, own, piece, example, begin, end, last = (column[i].as_py() for column in batch.columns)
                if now != (c, at):
                    more = close()
                    now, parts, reply, tail, ends = (c, at), [], None, False, last is None or at == last
                else:
                    more = []
                parts.append(piece)
                if own:
                    tail = example is None
                if example is not None:
                    if reply is not None:
                        more.append((*reply, False))
                    parts = ["".join(parts)]
                    reply = (c, example, parts[0], begin, end)
                for row in more:
                    out.append(row)
                    held += len(row[2])
                if held > _CHUNK:
                    yield batch_of()
                    out, held = [], 0
            if out:
                yield batch_of()
                out, held = [], 0
        out = close()
        if out:
            yield batch_of()

    return both.mapInArrow(put_together, f"`{conversation}` {kind}, example bigint, text string, loss_start bigint, loss_end bigint, last boolean")


def render_examples(examples: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Conversation, example, full text, loss_start and loss_end of each example, by `whole_texts`."""
    return whole_texts(examples, conversation).filter("example IS NOT NULL").drop("last")


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of whole marked turns."""
    found = []
    for part in text.split(START)[1:]:
        role, _, rest = part.partition("\n")
        found.append((_plain_role(role), unescape(rest.removesuffix(END))))
    return found


DIGEST = ("n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, "
          "n_examples bigint")


def read_back(examples: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Per conversation what its examples say: turns, trainable text, and sizes.

    Takes the rows of `prefix_examples` in any order. Each example is put together with all turns
    before it, and its reply is read from that text, under the mask; the turns are read from the
    text that holds the whole conversation. The replies of a conversation then pass one task in
    order, one at a time, as a digest is sequential by its nature.
    """
    kind = examples.schema[conversation].dataType.simpleString()
    names = [conversation, *[c.split()[0] for c in DIGEST.split(", ")]]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                c, example, text, begin, end, last = (column[i].as_py() for column in batch.columns)
                reply = None if example is None else unescape(text[begin:end])
                n, said = (0, sha256()) if last else (None, None)
                for role, turn in read_turns(text) if last else ():
                    n += 1
                    said.update(f"{role}\n{turn}\n".encode())
                out.append((c, example, reply, n, said and said.hexdigest(), len(text) if last else None))
            if out:
                yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*out), [batch.schema.types[0], *types])],
                                      names=["_c", "example", "reply", "turns", "said", "chars"])

    rows = whole_texts(examples, conversation).mapInArrow(
        read, f"_c {kind}, example bigint, reply string, turns bigint, said string, chars bigint")
    rows = rows.repartition("_c").sortWithinPartitions("_c", "example")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        state, kind = None, None
        out: list[list] = []

        def close() -> None:
            if state:
                out.append([state["c"], *state["whole"][:2], state["loss"], state["under"].hexdigest(),
                            state["whole"][2], state["examples"]])

        def batch_of() -> pa.RecordBatch:
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)

        for batch in batches:
            kind = batch.schema.types[0]
            for i in range(batch.num_rows):
                c, example, reply, *whole = (column[i].as_py() for column in batch.columns)
                if state is None or c != state["c"]:
                    close()
                    state = {"c": c, "whole": None, "loss": 0, "under": sha256(), "examples": 0}
                if whole[0] is not None:
                    state["whole"] = whole
                if example is not None:
                    state["examples"] += 1
                    state["loss"] += len(reply)
                    state["under"].update(reply.encode())
            if out:
                yield batch_of()
                out.clear()
        close()
        if out:
            yield batch_of()

    return rows.mapInArrow(digest, f"`{conversation}` {kind}, {DIGEST}")
