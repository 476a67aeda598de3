"""Chat formatting: logs of conversation events become final messages and then training text.

An event has the columns conv_id, seq, kind, turn, role and text. Kinds:

* message: begins a turn with its text (what the turn held before is dropped);
* delta: appends to the turn, as a streamed answer does; begins it if it isn't there;
* edit: replaces the text of the turn, in place; without effect on a turn that isn't there;
* regenerate: as message, and all later turns, as they are then, fall away.

A message is marked as

    ### role: text</turn>\\n

with a backslash before each backslash, # and < of the text (and each : of the role), so no text can
forge a mark and every text can be read back. Loss falls on the texts of assistant turns alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
READ = r"(?s)^### ((?:\\.|[^\\:])*): (.*)</turn>\n$"


def escape(text: Column, chars: str = r"\\#<") -> Column:
    return F.regexp_replace(text, f"([{chars}])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """The final messages (conv_id, turn, role, text) of event logs, as if events were taken one after another.

    Events come in order of seq (null: 0); where seqs tie, deltas come last, and then texts, kinds and turns
    decide. `turn` may have any type with an order, nulls first. A null text is empty, the role is the last
    one given since the turn is there. Events of unknown kinds are errors. The events of one turn meet in one
    row, as its text does; the turns of a conversation don't, they only pass through one sorted window, so a
    conversation may be of any length.
    """
    known = F.when(F.col("kind").isin("message", "delta", "edit", "regenerate"), F.col("kind")).otherwise(
        F.raise_error(F.concat(F.lit("unknown kind of event: "), F.coalesce("kind", F.lit("null"))))
    )
    events = events.select("conv_id", "turn", F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), known.alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    place = F.struct("seq", (F.col("kind") == "delta").alias("late"), "text", "kind")
    turns = events.groupBy("conv_id", "turn").agg(
        F.array_sort(F.collect_list(F.struct(place.alias("place"), "role"))).alias("log"),
        F.max(F.when(F.col("kind") == "regenerate", place)).alias("again"),
    )
    before = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("cut", F.max("again").over(before))
    # what an earlier turn's regeneration has dropped, and edits of what isn't there
    log = F.filter("log", lambda e: F.col("cut").isNull() | (e["place"] >= F.col("cut")))
    turns = turns.select("conv_id", "turn", log.alias("log"))
    begins = F.array_position(F.transform("log", lambda e: e["place"]["kind"] != "edit"), True).cast("int")
    turns = turns.withColumn("begins", begins).where("begins > 0").select("conv_id", "turn", F.slice("log", F.col("begins"), F.size("log") - F.col("begins") + 1).alias("log"))
    # the last event that sets the text, and the deltas behind it
    last = F.size("log") - F.array_position(F.reverse(F.transform("log", lambda e: e["place"]["kind"] != "delta")), True).cast("int") + 1
    turns = turns.withColumn("last", F.when(F.exists("log", lambda e: e["place"]["kind"] != "delta"), last).otherwise(1))
    pieces = F.transform(F.slice("log", F.col("last"), F.size("log") - F.col("last") + 1), lambda e: e["place"]["text"])
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    return turns.select("conv_id", "turn", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), F.array_join(pieces, "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, starts_at, formatted, loss_start, loss_chars.

    The texts `formatted` of a conversation, joined in order of turn, are its training text; starts_at
    is where a piece begins in it. loss_start and loss_chars say which characters of the piece bear
    loss (0 and 0: none). A null role or text is empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), escape(role, r"\\#<:"), F.lit(COLON))
    made = messages.select("conv_id", "turn", (role == "assistant").alias("bears"), head.alias("head"), escape(text).alias("body"))
    made = made.select(
        "conv_id",
        "turn",
        F.concat("head", "body", F.lit(CLOSE)).alias("formatted"),
        F.when(F.col("bears"), F.length("head")).otherwise(0).cast("long").alias("loss_start"),
        F.when(F.col("bears"), F.length("body")).otherwise(0).cast("long").alias("loss_chars"),
    )
    before = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("starts_at", F.coalesce(F.sum(F.length("formatted")).over(before), F.lit(0)).cast("long"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What `render` wrote, read from its output alone: conv_id, turn, role, text, loss_text."""
    part = lambda i: unescape(F.regexp_extract("formatted", READ, i))
    loss = unescape(F.substring(F.col("formatted"), F.col("loss_start").cast("int") + 1, F.col("loss_chars").cast("int")))
    return formatted.select("conv_id", "turn", part(1).alias("role"), part(2).alias("text"), loss.alias("loss_text"), F.length("formatted").alias("size"))


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(turns: DataFrame) -> DataFrame:
    """Counts and hashes of each conversation that `read_back` gives.

    Conversations stream through their task in sorted order, turn by turn: a task holds one running
    hash, not the turns, so memory doesn't depend on a conversation's length.
    """
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first()).drop("turn")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []

        def close() -> None:
            if state:
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in DIGEST.split(", ")])

        for batch in batches:
            for conv, role, text, loss, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "loss_text", "size")), strict=True):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += size
            if len(done) > 5000:
                yield flush()
                done.clear()
        close()
        yield flush()

    return ordered.mapInArrow(work, DIGEST)
