"""Chat formatting: a finite-state machine over roles, a declarative template, segments with loss flags."""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocks import groups

#: Marks around each turn, roles whose text is learnt, and the roles that may follow each state.
TEMPLATE = {
    "open": "<|im_start|>{role}\n",
    "close": "<|im_end|>\n",
    "loss": ["assistant"],
    "next": {"": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]},
    "final": ["assistant"],
}
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    """No control string is left: each ``<|``, also one with backslashes between, gets one backslash more."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n").replace("|", "\\|")


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


def order_error(roles: list[str], template: dict = TEMPLATE) -> str | None:
    """First breach of the turn order, or None: the machine's state is the last role."""
    state = ""
    for n, role in enumerate(roles):
        if role not in template["next"].get(state, ()):
            return f"turn {n}: {role or 'no role'} after {state or 'start'}"
        state = role
    return None if state in template["final"] else f"ends with {state or 'nothing'}"


def segments(roles: list[str], texts: list[str], template: dict = TEMPLATE) -> list[dict]:
    """Texts with a loss flag each; joined, they are the formatted conversation."""
    out = []
    for role, text in zip(roles, texts):
        out += [{"text": template["open"].format(role=_escape_role(role)), "loss": False},
                {"text": escape(text), "loss": role in template["loss"]},
                {"text": template["close"], "loss": False}]
    return out


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    return [(_unescape_role(role), unescape(text)) for role, text in _TURN.findall(formatted)]


_SEGMENT = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def formatted(turns: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """``turns`` (conv_id, turn, role, text, ...) -> one row per conversation: conv_id, error, segments.

    Rows are ordered by turn, equal turns by role and text; null roles and texts count as empty; rows
    without conv_id make one conversation. A conversation that breaks the turn order is formatted too,
    ``error`` says where. Tasks stream over sorted rows and hold one conversation at a time.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("error", pa.string()), ("segments", _SEGMENT)])

    def run(batches):
        for table, cuts in groups(batches, ["conv_id"]):
            ids, roles, texts = (table.column(c).to_pylist() for c in ("conv_id", "role", "text"))
            spans = list(zip(cuts, cuts[1:]))
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[a] for a, _ in spans], pa.int64()),
                pa.array([order_error(roles[a:b], template) for a, b in spans], pa.string()),
                pa.array([segments(roles[a:b], texts[a:b], template) for a, b in spans], _SEGMENT)], schema=schema)
    rows = turns.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(
        run, "conv_id long, error string, segments array<struct<text string, loss boolean>>")


def digests(conversations: DataFrame) -> DataFrame:
    """Formatted conversations, read back: turns, texts under the loss flag, sizes."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("error", pa.string())])

    def run(batches):
        for batch in batches:
            out = []
            for conv, error, parts in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "error", "segments"))):
                whole = "".join(p["text"] for p in parts)
                turns = parse(whole)
                learnt = "".join(unescape(p["text"]) for p in parts if p["loss"])
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                out.append((conv, len(turns), digest.hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(whole), error))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
    return conversations.select("conv_id", "error", "segments").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, error string")
