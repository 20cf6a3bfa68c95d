"""Chat formatting by a small sandboxed template language.

Templates know literal text, `{{ expression }}`, `{% for x in xs %}`, `{% if %}/{% elif %}/{% else %}` and
`{% generation %}` (its output is under the loss mask).  Expressions are names, attributes of messages, string literals,
`loop.first`/`loop.index`, `==`, `!=`, `and`, `or`, `not`, `+` and the filters `escape`, `trim` and `upper`; there is no
other call and no access to Python.  compile_template() parses to a syntax tree, folds constants and returns a generator
function, so that a conversation of any length is rendered turn by turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import ship

#: Strings that may not occur inside a text; the template's own marks are the first three.
CONTROL = ("<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
TEMPLATE = (
    "{% for m in messages %}<|turn|>{{ m.role|escape }}<|text|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}{% else %}{{ m.text|escape }}{% endif %}"
    "<|end|>\n{% endfor %}"
)
PART_SCHEMA = "conv_id long, part int, text string, loss array<struct<start:int,stop:int>>, last boolean"
PART_CHARS = 1_000_000


# --- escaping -----------------------------------------------------------------------------------------------------


_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))


def escape(text: str) -> str:
    """Double each backslash and put one after the first character of each control string; unescape() undoes it."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


# --- syntax tree --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    path: tuple[str, ...]


@dataclass(frozen=True)
class Op:
    kind: str
    args: tuple


@dataclass(frozen=True)
class Emit:
    value: object


@dataclass(frozen=True)
class For:
    name: str
    source: object
    body: tuple


@dataclass(frozen=True)
class If:
    arms: tuple  # (condition, body)


@dataclass(frozen=True)
class Generation:
    body: tuple


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper}
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*')|([A-Za-z_]\w*)|(==|!=|[.|+()]))")


def _expression(source: str):
    tokens, at = [], 0
    source = source.strip()
    while at < len(source):
        if not (m := _TOKEN.match(source, at)):
            raise ValueError(f"template: cannot read {source[at:]!r}")
        tokens.append(m)
        at = m.end()
    tokens.reverse()

    def peek() -> str:
        return tokens[-1][0].strip() if tokens else ""

    def unit():
        if not tokens:
            raise ValueError(f"template: {source!r} ends early")
        m = tokens.pop()
        if m[1]:
            value = Const(re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), m[1][1:-1]))
        elif m[2] == "not":
            return Op("not", (equality(),))
        elif m[2] in ("true", "false"):
            value = Const(m[2] == "true")
        elif m[2]:
            path = [m[2]]
            while peek() == ".":
                tokens.pop()
                path.append(tokens.pop()[2] or "")
            if any(not p or p.startswith("_") for p in path):
                raise ValueError(f"template: {'.'.join(path)!r} is not allowed")
            value = Name(tuple(path))
        elif m[3] == "(":
            value = either()
            if peek() != ")":
                raise ValueError("template: ) is missing")
            tokens.pop()
        else:
            raise ValueError(f"template: unexpected {m[0]!r}")
        while peek() == "|":
            tokens.pop()
            name = tokens.pop()[2] if tokens else ""
            if name not in FILTERS:
                raise ValueError(f"template: no filter {name!r}")
            value = Op(name, (value,))
        return value

    def chain(kinds: tuple[str, ...], below):
        left = below()
        while peek() in kinds:
            kind = tokens.pop()[0].strip()
            left = Op(kind, (left, below()))
        return left

    def total():
        return chain(("+",), unit)

    def equality():
        return chain(("==", "!="), total)

    def both():
        return chain(("and",), equality)

    def either():
        return chain(("or",), both)

    found = either()
    if tokens:
        raise ValueError(f"template: {source!r} goes on after its end")
    return found


def parse(template: str) -> tuple:
    pieces = re.split(r"(\{%.*?%\}|\{\{.*?\}\})", template, flags=re.S)
    pieces.reverse()

    def body(ends: tuple[str, ...]) -> tuple[tuple, str]:
        out = []
        while pieces:
            piece = pieces.pop()
            if piece.startswith("{{"):
                out.append(Emit(_expression(piece[2:-2])))
            elif piece.startswith("{%"):
                word, _, rest = piece[2:-2].strip().partition(" ")
                if word in ends:
                    return tuple(out), piece[2:-2].strip()
                if word == "for" and (m := re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip())):
                    out.append(For(m[1], _expression(m[2]), body(("endfor",))[0]))
                elif word == "if":
                    arms, test = [], _expression(rest)
                    while True:
                        inner, end = body(("elif", "else", "endif"))
                        arms.append((test, inner))
                        if end == "endif":
                            break
                        test = _expression(end[4:]) if end.startswith("elif") else Const(True)
                    out.append(If(tuple(arms)))
                elif word == "generation":
                    out.append(Generation(body(("endgeneration",))[0]))
                else:
                    raise ValueError(f"template: unexpected {piece!r}")
            elif piece:
                out.append(Emit(Const(piece)))
        if ends:
            raise ValueError(f"template: {ends[-1]} is missing")
        return tuple(out), ""

    return body(())[0]


OPS: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": lambda a, b: str(a) + str(b), "and": lambda a, b: a and b, "or": lambda a, b: a or b, "not": lambda a: not a, **FILTERS}


def fold(node):
    """Evaluate what is constant: operations on constants, branches that are never or always taken, adjacent text."""
    if isinstance(node, Op):
        args = tuple(map(fold, node.args))
        return Const(OPS[node.kind](*(a.value for a in args))) if all(isinstance(a, Const) for a in args) else Op(node.kind, args)
    if isinstance(node, tuple):
        out: list = []
        for x in map(fold, node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Emit) and isinstance(y.value, Const) and out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const):
                    out[-1] = Emit(Const(str(out[-1].value.value) + str(y.value.value)))
                else:
                    out.append(y)
        return tuple(out)
    if isinstance(node, Emit):
        return Emit(fold(node.value))
    if isinstance(node, For):
        return For(node.name, fold(node.source), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        arms = []
        for test, inner in node.arms:
            test = fold(test)
            if isinstance(test, Const) and not test.value:
                continue
            arms.append((test, fold(inner)))
            if isinstance(test, Const):
                break
        return arms[0][1] if arms and isinstance(arms[0][0], Const) else If(tuple(arms)) if arms else ()
    return node


# --- closures -----------------------------------------------------------------------------------------------------


def _value(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda scope, v=node.value: v
    if isinstance(node, Name):
        head, rest = node.path[0], node.path[1:]

        def get(scope: dict):
            found = scope.get(head, "")
            for p in rest:
                found = found.get(p, "") if isinstance(found, dict) else ""
            return found

        return get
    args, op = [_value(a) for a in node.args], OPS[node.kind]
    if len(args) == 1:
        return lambda scope, a=args[0]: op(a(scope))
    return lambda scope, a=args[0], b=args[1]: op(a(scope), b(scope))


def _render(node) -> Callable[[dict, bool], Iterator[tuple[str, bool]]]:
    if isinstance(node, tuple):
        parts = [_render(x) for x in node]

        def each(scope, marked):
            for p in parts:
                yield from p(scope, marked)

        return each
    if isinstance(node, Emit):
        value = _value(node.value)

        def emit(scope, marked):
            if text := str(value(scope)):
                yield text, marked

        return emit
    if isinstance(node, Generation):
        inner = _render(node.body)
        return lambda scope, marked: inner(scope, True)
    if isinstance(node, For):
        source, inner, name = _value(node.source), _render(node.body), node.name

        def loop(scope, marked):
            for i, x in enumerate(source(scope)):
                yield from inner(scope | {name: x, "loop": {"first": i == 0, "index": str(i + 1)}}, marked)

        return loop
    arms = [(_value(t), _render(b)) for t, b in node.arms]

    def choose(scope, marked):
        for test, inner in arms:
            if test(scope):
                yield from inner(scope, marked)
                return

    return choose


def compile_template(template: str) -> Callable[[Iterator[dict]], Iterator[tuple[str, bool]]]:
    """messages -> pieces (text, under the loss mask?), in order and as lazily as the messages come."""
    run = _render(fold(parse(template)))
    return lambda messages: run({"messages": messages}, False)


# --- on DataFrames ------------------------------------------------------------------------------------------------


def _turns(batches) -> Iterator[tuple[int, str, str]]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)


def _grouped(rows: Iterator[tuple]):
    """(key, lazy rows) of each run of equal keys."""
    from itertools import groupby

    for key, group in groupby(rows, key=lambda r: r[0]):
        yield key, group


def _parts(template: str, part_chars: int):
    def run(batches):
        render, schema = compile_template(template), pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("last", pa.bool_())])
        rows: list[dict] = []
        held = 0
        for conv, group in _grouped(_turns(batches)):
            text: list[str] = []
            loss: list[dict] = []
            n = part = 0
            for piece, marked in render({"role": r, "text": t} for _, r, t in group):
                if n and n + len(piece) > part_chars:
                    rows.append({"conv_id": conv, "part": part, "text": "".join(text), "loss": loss, "last": False})
                    held, text, loss, n, part = held + n, [], [], 0, part + 1
                if marked:
                    loss.append({"start": n, "stop": n + len(piece)})
                text.append(piece)
                n += len(piece)
                if held >= 4 * part_chars:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            rows.append({"conv_id": conv, "part": part, "text": "".join(text), "loss": loss, "last": True})
            held += n
            if held >= 4 * part_chars or len(rows) >= 10_000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, part_chars: int = PART_CHARS) -> DataFrame:
    """(conv_id, part, text, loss, last): each conversation's formatted text, long ones in parts of about part_chars.

    `loss` lists the spans of `text` under the loss mask.  Turns are put in order of turn (null first), role and text;
    a null role or text is empty; rows with a null conv_id form one conversation; repeated rows are turns of their own;
    an empty table gives no rows.  The parts of a conversation are adjacent and in order within a partition, and are
    made while its turns stream by: one conversation may be of any length.
    """
    ship(conversations.sparkSession)
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_parts(template, part_chars), PART_SCHEMA)


_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", re.S)


def _read_back(batches):
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    fresh = lambda: {"n": 0, "chars": 0, "loss": 0, "turns": hashlib.sha256(), "masked": hashlib.sha256(), "rest": ""}
    state = fresh()
    for batch in batches:
        out = []
        for conv, text, loss, last in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "last")), strict=True):
            state["chars"] += len(text)
            for span in loss:
                masked = unescape(text[span["start"] : span["stop"]])
                state["loss"] += len(masked)
                state["masked"].update(masked.encode())
            whole, at = state["rest"] + text, 0
            for m in _TURN.finditer(whole):
                state["n"] += 1
                state["turns"].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                at = m.end()
            state["rest"] = whole[at:]
            if last:
                out.append((conv, state["n"], state["turns"].hexdigest(), state["loss"], state["masked"].hexdigest(), state["chars"]))
                state = fresh()
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * 6, schema, strict=True)], schema=schema)


def digests(parts: DataFrame) -> DataFrame:
    """What the formatted parts of the standard template say of each conversation: its turns and the text under the mask."""
    return parts.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
