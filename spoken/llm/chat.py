"""Chat formatting: a finite-state machine over roles and a declarative template.

The template gives each turn's prefix and suffix and the roles whose text carries loss. A turn becomes three segments, of which only
the text of a loss role has its flag set. Control strings inside roles and texts are replaced by two-character codes that start with
a backslash (a backslash itself too), so that no control string of the output stems from a text and reading back is exact.
Conversations stream through sorted partitions: memory holds one turn, however long a conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions


@dataclass(frozen=True)
class Template:
    prefix: str = "<|im_start|>{role}\n"
    suffix: str = "<|im_end|>\n"
    loss: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: state to the roles that may follow it; a role is also the name of the next state
    turns: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    end: tuple[str, ...] = ("assistant",)
    #: what texts may not contain, by the code that stands for it
    control: dict[str, str] = field(default_factory=lambda: {"\\": "b", "<|im_start|>": "0", "<|im_end|>": "1", "<|endoftext|>": "2", "<s>": "3", "</s>": "4", "[INST]": "5", "[/INST]": "6", "<<SYS>>": "7", "<</SYS>>": "8"})

    def escape(self, text: str) -> str:
        return re.sub("|".join(map(re.escape, sorted(self.control, key=len, reverse=True))), lambda m: "\\" + self.control[m[0]], text)

    def unescape(self, text: str) -> str:
        names = {v: k for k, v in self.control.items()} | {"n": "\n"}
        return re.sub(r"\\(.)", lambda m: names[m[1]], text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        name = self.escape(role).replace("\n", "\\n")
        return [(self.prefix.replace("{role}", name), False), (self.escape(text), role in self.loss), (self.suffix, False)]

    def read(self, output: str) -> tuple[str, str]:
        """(role, text) of a formatted turn."""
        before, _, after = self.prefix.partition("{role}")
        name, _, rest = output.removeprefix(before).partition(after)
        return self.unescape(name), self.unescape(rest.removesuffix(self.suffix))


_SEGMENTS = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("text", pa.list_(pa.string())), ("loss", pa.list_(pa.bool_())), ("error", pa.string())])


def format_chat(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, seq, text array, loss array, error) for every row of ``conversations(conv_id, turn, role, text)``.

    Rows of a conversation come in the order of turn, then role and text where turns tie (nulls first), and are numbered by ``seq``.
    Null roles and texts are empty. ``error`` names a transition that the template does not allow; such turns are formatted all the
    same. Rows with a null conv_id form one conversation. An empty table gives an empty result.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition(shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, seq = object(), template.start, 0
        for batch in batches:
            out = []
            for c, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                if c != conv:
                    conv, state, seq = c, template.start, 0
                error = None if role in template.turns.get(state, ()) else f"{role} after {state}"
                texts, flags = zip(*template.segments(role, text))
                out.append((c, seq, list(texts), list(flags), error))
                state, seq = role, seq + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _SEGMENTS)], schema=_SEGMENTS)

    return rows.mapInArrow(run, "conv_id long, seq long, text array<string>, loss array<boolean>, error string")


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])


def chat_digest(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """One row a conversation of what reading back the output of ``format_chat`` gives. It runs on that function's partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = object(), None

        def done():
            names, turns, loss, n, chars, size, ok, last = state
            return (conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, ok and last in template.end)

        for batch in batches:
            out = []
            for c, texts, flags, error in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "text", "loss", "error"))):
                if c != conv or state is None:
                    if state is not None:
                        out.append(done())
                    conv, state = c, [None, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, True, ""]
                output = "".join(texts)
                role, text = template.read(output)
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                under = template.unescape("".join(t for t, flag in zip(texts, flags) if flag))
                state[2].update(under.encode("utf-8", "surrogatepass"))
                state[3] += 1
                state[4] += len(under)
                state[5] += len(output)
                state[6] = state[6] and error is None
                state[7] = role
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _DIGEST)], schema=_DIGEST)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(done(), _DIGEST)], schema=_DIGEST)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
