r"""Chat formatting: a finite-state machine over roles and a declarative template.

The template gives each role a prefix, a suffix and a loss flag; control strings inside texts are
broken by a backslash after their first character, and backslashes are doubled, so no text can
close its turn and ``unescape`` restores it. Each turn gives three segments (prefix, text, suffix);
only assistant texts carry loss. The machine reads the roles in order and notes the first turn that
its table does not allow; such conversations are formatted all the same and marked invalid.

Turns are sorted by (turn, role, text), so ties have one order. A conversation streams through its
task row by row, in the order of its turns; nothing of its size is held. Edge cases: a null text is
empty, a null role is the empty role, null conversation ids form one conversation, a null turn comes
first, repeated rows are turns of their own, an empty table gives no segment. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT_SCHEMA = "conv_id long, turn_no long, part string, content string, loss boolean, state string"


@dataclass(frozen=True)
class Template:
    """Marks of a turn by role; other roles use ``other``, whose prefix names them."""

    roles: dict[str, tuple[str, str, bool]] = field(
        default_factory=lambda: {
            "system": ("<<SYS>>", "<</SYS>>", False),
            "user": ("<s>[INST]", "[/INST]", False),
            "assistant": ("[OUT]", "</s>", True),
        }
    )
    other: tuple[str, str, bool] = ("[ROLE]{role}[/ROLE]", "[/TURN]", False)
    controls: tuple[str, ...] = ("<<SYS>>", "<</SYS>>", "<s>", "[INST]", "[/INST]", "[OUT]", "</s>", "[ROLE]", "[/ROLE]", "[/TURN]")
    #: state -> role -> state; a conversation may end in any of ``final``.
    machine: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "ready", "user": "asked"},
            "ready": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    final: tuple[str, ...] = ("answered",)

    def marks(self, role: str) -> tuple[str, str, bool]:
        if role in self.roles:
            return self.roles[role]
        prefix, suffix, loss = self.other
        return prefix.format(role=escape(role, self)), suffix, loss

    def step(self, state: str, role: str) -> str:
        return self.machine.get(state, {}).get(role, "invalid")


def _broken(template: Template) -> re.Pattern:
    starts = "".join(sorted({re.escape(c[0]) for c in template.controls}))
    rest = "|".join(sorted({re.escape(c[1:]) for c in template.controls}, key=len, reverse=True))
    return re.compile(f"([{starts}])(?={rest})")


_PATTERNS: dict[tuple, re.Pattern] = {}


def escape(text: str, template: Template) -> str:
    pattern = _PATTERNS.get(template.controls)
    if pattern is None:
        pattern = _PATTERNS[template.controls] = _broken(template)
    return pattern.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def _sorted(turns: DataFrame) -> DataFrame:
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _segments(template: Template):
    schema = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("part", pa.string()), ("content", pa.string()), ("loss", pa.bool_()), ("state", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, number, state = object(), 0, "start"
        for batch in batches:
            rows = []
            convs, _, roles, texts = (batch.column(i).to_pylist() for i in range(4))
            for conv, role, text in zip(convs, roles, texts):
                if conv != current:
                    current, number, state = conv, 0, "start"
                state = template.step(state, role)
                prefix, suffix, loss = template.marks(role)
                rows += [(conv, number, "prefix", prefix, False, state), (conv, number, "text", escape(text, template), loss, state), (conv, number, "suffix", suffix, False, state)]
                number += 1
            if rows:
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return run


def segments(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments (SEGMENT_SCHEMA), those of a conversation together and in order within a partition.

    ``state`` is the machine's state after the turn, ``invalid`` from the first turn out of order on.
    """
    return _sorted(turns).mapInArrow(_segments(template or Template()), SEGMENT_SCHEMA)


def read_role(prefix: str, template: Template) -> str:
    """The role that a formatted prefix names."""
    for role, (mark, _, _) in template.roles.items():
        if prefix == mark:
            return role
    lead, trail = template.other[0].split("{role}")
    return unescape(prefix[len(lead) : len(prefix) - len(trail)])


def parse(formatted: str, template: Template | None = None) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted conversation, from its text alone."""
    template = template or Template()
    marks = {prefix: (role, suffix) for role, (prefix, suffix, _) in template.roles.items()}
    lead, trail = template.other[0].split("{role}")
    control = re.compile("|".join(re.escape(c) for c in sorted(template.controls, key=len, reverse=True)))
    out, at = [], 0

    def upto(mark: str, start: int) -> int:
        """Place of the next control string, which must be ``mark``."""
        found = control.search(formatted, start)
        if not found or not formatted.startswith(mark, found.start()):
            raise ValueError(f"{mark} expected after {start}")
        return found.start()

    while at < len(formatted):
        named = next((p for p in sorted(marks, key=len, reverse=True) if formatted.startswith(p, at)), None)
        if named is not None:
            role, suffix = marks[named]
            at += len(named)
        elif formatted.startswith(lead, at):
            end = upto(trail, at + len(lead))
            role, suffix = unescape(formatted[at + len(lead) : end]), template.other[1]
            at = end + len(trail)
        else:
            raise ValueError(f"no turn begins at {at}")
        end = upto(suffix, at)
        out.append((role, unescape(formatted[at:end])))
        at = end + len(suffix)
    return out


DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def _digests(template: Template):
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, done = object(), []
        turns = loss = None
        count = loss_chars = chars = 0
        state = "start"

        def close() -> None:
            if turns is not None:
                done.append((current, count, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, state in template.final))

        for batch in batches:
            for conv, part, content, flag, after in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
                if conv != current:
                    close()
                    current, turns, loss, count, loss_chars, chars = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                chars += len(content)
                state = after
                if part == "prefix":
                    turns.update(f"{read_role(content, template)}\n".encode("utf-8", "replace"))
                    count += 1
                elif part == "text":
                    plain = unescape(content)
                    turns.update(f"{plain}\n".encode("utf-8", "replace"))
                    if flag:
                        loss.update(plain.encode("utf-8", "replace"))
                        loss_chars += len(plain)
            if done:
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*done), schema)], schema=schema)
                done.clear()
        close()
        if done:
            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*done), schema)], schema=schema)

    return run


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Read formatted segments back, in the order ``segments`` gives them: one row per conversation."""
    return formatted.mapInArrow(_digests(template or Template()), DIGEST_SCHEMA)
