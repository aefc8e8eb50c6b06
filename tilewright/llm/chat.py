"""Chat formatting by schema fingerprints.

A record is JSON in any of several layouts: prompt and response, instruction
with input and output, lists of messages, or single turns. The set of its
nested field paths (list positions written ``[]``) is hashed to a fingerprint.
Declarative mappings, each registered under the fingerprints of its required
paths with every choice of its optional ones, name the paths that hold turns;
a record is converted by the mapping of its fingerprint. Records whose
fingerprint is unknown, or that are not objects, are returned with their paths
and without turns.

A turn is formatted as ``<|im_start|>role``, a line end, the text, ``<|im_end|>``
and a line end. Inside roles and texts every ``<``, backslashes, ``|`` gets one
backslash more, so control strings cannot occur there and reading back takes it
away again. The loss mask covers the assistants' texts.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.shared import map_batches, written

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
TURN = re.compile(r"<\|im_start\|>((?:(?!<\|).)*?)\n(.*)<\|im_end\|>\n", re.DOTALL)


@dataclass(frozen=True)
class Mapping:
    """Where turns are: (role, path) pairs, or a list whose items have a role and a text field.

    ``joined`` paths are put together with a blank line between them.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    items: str | None = None
    role: str = "role"
    text: str = "content"
    roles: dict[str, str] = field(default_factory=dict, hash=False)


MAPPINGS = (
    Mapping("turn", ("role",), ("text", "content"), items="", text="text|content"),
    Mapping("untold turn", (), ("text",), items="", text="text"),
    Mapping("prompt", ("prompt",), ("system", "response", "completion"), (
        ("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)), ("assistant", ("completion",)))),
    Mapping("instruction", ("instruction",), ("system", "input", "output"), (
        ("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("question", ("question",), ("answer", "context"), (
        ("user", ("context", "question")), ("assistant", ("answer",)))),
    Mapping("messages", ("messages[].role",), ("messages[].content", "system"), (("system", ("system",)),), items="messages"),
    Mapping("conversations", ("conversations[].from",), ("conversations[].value", "system"), (("system", ("system",)),),
            items="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
)


def paths_of(value, prefix: str = "") -> set[str]:
    """Paths of all leaves; null fields do not count as present."""
    if isinstance(value, dict):
        return set().union(*(paths_of(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items())) if value else set()
    if isinstance(value, list):
        return set().union(*(paths_of(v, f"{prefix}[]") for v in value)) if value else set()
    return set() if value is None else {prefix}


def fingerprint(paths: set[str]) -> str:
    """The same for any order of fields and any number of list items."""
    return hashlib.sha256("\x00".join(sorted(paths)).encode()).hexdigest()[:16]


def registry(mappings: tuple[Mapping, ...] = MAPPINGS) -> dict[str, Mapping]:
    """Mapping by fingerprint; earlier mappings win."""
    out: dict[str, Mapping] = {}
    for mapping in mappings:
        for n in range(len(mapping.optional) + 1):
            for extra in itertools.combinations(mapping.optional, n):
                out.setdefault(fingerprint({*mapping.required, *extra}), mapping)
    return out


def _string(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _item(mapping: Mapping, item: dict) -> tuple[str, str]:
    role = _string(item.get(mapping.role))
    text = next((item[k] for k in mapping.text.split("|") if item.get(k) is not None), None)
    return mapping.roles.get(role, role), _string(text)


def turns_of(mapping: Mapping, record: dict) -> list[tuple[str, str]]:
    """(role, text) pairs of one record."""
    out = []
    for role, paths in mapping.turns:
        found = [record[p] for p in paths if record.get(p) is not None]
        if found:
            out.append((role, "\n\n".join(map(_string, found))))
    if mapping.items == "":
        out.append(_item(mapping, record))
    elif mapping.items:
        out += [_item(mapping, item) for item in record.get(mapping.items) or [] if isinstance(item, dict)]
    return out


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def formatted_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn's piece of the output, and where its loss starts and ends in code points (equal: none)."""
    body, head = escape(text), f"{START}{escape(role)}\n"
    at = len(head)
    return f"{head}{body}{END}\n", at, at + len(body) if role == "assistant" else at


def canonical_turns(records: DataFrame, keys: list[str], mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``keys..., fingerprint, mapping, turn_no, role, text``: one row per turn of each ``record``.

    ``records`` has the key columns and ``record`` (JSON). A record without a
    mapping, and one that is null or not an object, gives one row of mapping
    null, its paths in ``text``.
    """

    def run(batches):
        known = registry(mappings)
        for batch in batches:
            at, rows = [], []
            for i, raw in enumerate(batch.column(len(keys)).to_pylist()):
                try:
                    record = json.loads(raw) if raw is not None else None
                except ValueError:
                    record = None
                paths = paths_of(record) if isinstance(record, dict) else set()
                mark = fingerprint(paths)
                mapping = known.get(mark) if isinstance(record, dict) else None
                found = enumerate(turns_of(mapping, record)) if mapping else [(None, (None, " ".join(sorted(paths))))]
                for number, (role, text) in found:
                    at.append(i)
                    rows.append((mark, mapping.name if mapping else None, number, role, text))
            if rows:
                own = [batch.column(i).take(pa.array(at)) for i in range(len(keys))]
                yield *own, *zip(*rows)

    kinds = dict(records.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "fingerprint STRING, mapping STRING, turn_no INT, role STRING, text STRING"])
    return map_batches(records.select(*keys, "record"), run, schema)


def formatted(turns: DataFrame) -> DataFrame:
    """Adds ``piece, loss_from, loss_to``: the turn's part of the conversation's formatted text.

    A conversation's text is its pieces in order. Pieces stay rows, so a
    conversation of any length is never one value.
    """

    @F.arrow_udf("piece STRING, loss_from INT, loss_to INT")
    def piece(roles, texts):
        found = [formatted_turn(r or "", t or "") for r, t in zip(roles.to_pylist(), texts.to_pylist())]
        columns = list(zip(*found)) or [(), (), ()]
        kinds = (pa.string(), pa.int32(), pa.int32())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["piece", "loss_from", "loss_to"])

    return turns.withColumn("_p", piece("role", "text")).select("*", "_p.*").drop("_p")


def parsed(piece: str, loss_from: int, loss_to: int) -> tuple[str, str, str | None]:
    """(role, text, text under the loss mask or None) of a piece."""
    m = TURN.fullmatch(piece)
    if not m:
        raise ValueError("not a formatted turn")
    role = unescape(m[1])
    return role, unescape(m[2]), unescape(piece[loss_from:loss_to]) if role == "assistant" else None


def digests(output: DataFrame, conversation: str, order: list[str]) -> DataFrame:
    """Counts and digests per conversation, read from the formatted pieces.

    Conversations are dealt to tasks whole and sorted; each goes by as a
    stream, so its length does not matter to memory.
    """
    kind = dict(output.dtypes)[conversation]

    def run(batches):
        current, begun, state = None, False, None

        def result():
            n, turns, chars, loss, size = state
            return current, n, turns.hexdigest(), chars, loss.hexdigest(), size

        def fresh():
            return [0, hashlib.sha256(), 0, hashlib.sha256(), 0]

        for batch in batches:
            done = []
            for conv, piece, a, b in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if not begun or conv != current:
                    if begun:
                        done.append(result())
                    current, begun, state = conv, True, fresh()
                role, text, masked = parsed(piece, a, b)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if masked is not None:
                    state[2] += len(masked)
                    state[3].update(masked.encode("utf-8", "surrogatepass"))
                state[4] += len(piece)
            if done:
                yield list(zip(*done))
        if begun:
            yield list(zip(*[result()]))

    dealt = output.repartition(F.col(conversation)).sortWithinPartitions(conversation, *order)
    return map_batches(
        dealt.select(conversation, "piece", "loss_from", "loss_to"), run,
        f"{conversation} {kind}, n_turns BIGINT, turns_sha256 STRING, loss_chars BIGINT, loss_sha256 STRING, formatted_chars BIGINT",
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` rows as formatted pieces, written once.

    Each row is a record of its own layout; null roles and texts are absent
    fields and come out empty. Turns follow ``turn`` (nulls first), equal ones
    by role and text; repeated rows all count.
    """
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("record", F.expr("to_json(struct(role, text))"))
    turns = canonical_turns(rows.select("conv_id", "turn", "record"), ["conv_id", "turn"])
    return written(formatted(turns), "chat-pieces")
