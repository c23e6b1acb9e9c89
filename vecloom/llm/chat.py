"""Chat formatting with a template compiler.

A small sandboxed template language is parsed into a syntax tree, constants are folded, and the tree becomes Python closures
that yield text piece by piece. ``{% generation %}`` blocks mark the text a model learns to write. Conversations stream
through: memory holds one turn and the turn after it, however long the conversation is.

    {{ expression }}   {% for turn in turns %} ... {% endfor %}   {% if a %} ... {% elif b %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}   {# comment #}

Expressions: strings, integers, true, false, names, ``turn.role``, ``==``, ``!=``, ``+`` (joins), ``not``, ``and``, ``or``, parentheses,
and the filters ``| trim``, ``| upper``, ``| lower``, ``| escape``. There are no calls, no imports and no attributes but the fields
of a turn and ``loop.first`` and ``loop.last``, so a template reaches nothing but the turns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The control strings of the standard template and the sign that escapes them
HEAD, TAIL, ESCAPE = "### ", "</turn>", "\\"
ROLE_NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}

TEMPLATE = (
    "{% for turn in turns %}{% if turn.role == 'assistant' %}### Assistant: {% generation %}{{ turn.text | escape }}{% endgeneration %}"
    "{% else %}### {{ turn.name }}: {{ turn.text | escape }}{% endif %}</turn>\n{% endfor %}"
)


class TemplateError(ValueError):
    """The template isn't one of this language."""


# ---- escaping: texts may hold control strings, and must read back as they were


def escape(text: str) -> str:
    """The text with every escape sign doubled and one put before each control string; ``unescape`` undoes it."""
    return text.replace(ESCAPE, ESCAPE * 2).replace("###", ESCAPE + "###").replace("</", ESCAPE + "</")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


# ---- syntax tree


@dataclass(frozen=True)
class Constant:
    value: object


@dataclass(frozen=True)
class Field:
    names: tuple[str, ...]


@dataclass(frozen=True)
class Operation:
    kind: str
    parts: tuple


@dataclass(frozen=True)
class Write:
    value: object


@dataclass(frozen=True)
class Block:
    parts: tuple


@dataclass(frozen=True)
class Loop:
    name: str
    over: object
    body: Block


@dataclass(frozen=True)
class Choice:
    test: object
    then: Block
    otherwise: Block


@dataclass(frozen=True)
class Generation:
    body: Block


_PIECE = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?)|(==|!=|[+()|]))")
_ESCAPES = {"n": "\n", "t": "\t"}
FILTERS: dict[str, Callable[[str], str]] = {"trim": str.strip, "upper": str.upper, "lower": str.lower, "escape": escape}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if m is None:
                raise TemplateError(f"can't read {source[at:]!r}")
            kind = ("string", "number", "name", "sign")[m.lastindex - 1]
            self.tokens.append((kind, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def parse(self):
        value = self._or()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return value

    def _take(self, *texts: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("sign", "name") and self.tokens[self.at][1] in texts:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def _or(self):
        left = self._and()
        while self._take("or"):
            left = Operation("or", (left, self._and()))
        return left

    def _and(self):
        left = self._not()
        while self._take("and"):
            left = Operation("and", (left, self._not()))
        return left

    def _not(self):
        return Operation("not", (self._not(),)) if self._take("not") else self._compare()

    def _compare(self):
        left = self._join()
        sign = self._take("==", "!=")
        return Operation(sign, (left, self._join())) if sign else left

    def _join(self):
        left = self._filtered()
        while self._take("+"):
            left = Operation("+", (left, self._filtered()))
        return left

    def _filtered(self):
        value = self._atom()
        while self._take("|"):
            name = self._take(*FILTERS)
            if name is None:
                raise TemplateError("unknown filter")
            value = Operation(name, (value,))
        return value

    def _atom(self):
        if self._take("("):
            value = self._or()
            if not self._take(")"):
                raise TemplateError("missing )")
            return value
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            return Constant(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "number":
            return Constant(int(text))
        if kind == "name" and text in ("true", "false"):
            return Constant(text == "true")
        if kind == "name" and text not in ("and", "or", "not"):
            return Field(tuple(text.split(".")))
        raise TemplateError(f"unexpected {text!r}")


def parse(template: str) -> Block:
    """The syntax tree of a template."""
    pieces = [p for p in _PIECE.split(template) if p and not p.startswith("{#")]
    tree, at = _block(pieces, 0, ())
    if at != len(pieces):
        raise TemplateError(f"unexpected {pieces[at]!r}")
    return tree


def _statement(piece: str) -> tuple[str, str]:
    word, _, rest = piece[2:-2].strip().partition(" ")
    return word, rest.strip()


def _block(pieces: list[str], at: int, ends: tuple[str, ...]) -> tuple[Block, int]:
    """Parts up to a statement in ``ends`` (or the end), and where that stands."""
    parts: list = []
    while at < len(pieces):
        piece = pieces[at]
        if piece.startswith("{{"):
            parts.append(Write(_Expression(piece[2:-2]).parse()))
            at += 1
        elif piece.startswith("{%"):
            word, rest = _statement(piece)
            if word in ends:
                return Block(tuple(parts)), at
            if word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
                if m is None:
                    raise TemplateError(f"can't read {piece!r}")
                body, at = _block(pieces, at + 1, ("endfor",))
                parts.append(Loop(m[1], _Expression(m[2]).parse(), body))
            elif word == "generation":
                body, at = _block(pieces, at + 1, ("endgeneration",))
                parts.append(Generation(body))
            elif word == "if":
                choice, at = _choice(pieces, at, rest)
                parts.append(choice)
            else:
                raise TemplateError(f"unexpected {piece!r}")
            at += 1
        else:
            parts.append(Write(Constant(piece)))
            at += 1
    if ends:
        raise TemplateError(f"missing {' or '.join(ends)}")
    return Block(tuple(parts)), at


def _choice(pieces: list[str], at: int, test: str) -> tuple[Choice, int]:
    then, at = _block(pieces, at + 1, ("elif", "else", "endif"))
    word, rest = _statement(pieces[at])
    if word == "elif":
        inner, at = _choice(pieces, at, rest)
        return Choice(_Expression(test).parse(), then, Block((inner,))), at
    otherwise = Block(())
    if word == "else":
        otherwise, at = _block(pieces, at + 1, ("endif",))
    return Choice(_Expression(test).parse(), then, otherwise), at


# ---- constant folding


def _apply(kind: str, values: list):
    if kind == "+":
        return f"{values[0]}{values[1]}"
    if kind == "==":
        return values[0] == values[1]
    if kind == "!=":
        return values[0] != values[1]
    if kind == "not":
        return not values[0]
    return FILTERS[kind](str(values[0]))


def fold(node):
    """The same tree with constant expressions evaluated, decided choices taken and neighbouring texts joined."""
    if isinstance(node, Operation):
        parts = tuple(map(fold, node.parts))
        if node.kind in ("and", "or"):
            if isinstance(parts[0], Constant):
                return parts[1] if bool(parts[0].value) == (node.kind == "and") else parts[0]
        elif all(isinstance(p, Constant) for p in parts):
            return Constant(_apply(node.kind, [p.value for p in parts]))
        return Operation(node.kind, parts)
    if isinstance(node, Write):
        return Write(fold(node.value))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, Loop):
        return Loop(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Choice):
        test = fold(node.test)
        if isinstance(test, Constant):
            return fold(node.then if test.value else node.otherwise)
        return Choice(test, fold(node.then), fold(node.otherwise))
    if isinstance(node, Block):
        parts: list = []
        for part in map(fold, node.parts):
            for p in part.parts if isinstance(part, Block) else (part,):
                if parts and all(isinstance(x, Write) and isinstance(x.value, Constant) for x in (p, parts[-1])):
                    parts[-1] = Write(Constant(f"{parts[-1].value.value}{p.value.value}"))
                else:
                    parts.append(p)
        return Block(tuple(parts))
    return node


# ---- closures

Pieces = Iterator[tuple[str, bool]]


def _value(node) -> Callable[[dict], object]:
    if isinstance(node, Constant):
        return lambda scope, value=node.value: value
    if isinstance(node, Field):
        return partial(_look_up, names=node.names)
    parts = [_value(p) for p in node.parts]
    if node.kind == "and":
        return lambda scope: parts[0](scope) and parts[1](scope)
    if node.kind == "or":
        return lambda scope: parts[0](scope) or parts[1](scope)
    return lambda scope, kind=node.kind: _apply(kind, [p(scope) for p in parts])


def _look_up(scope: dict, names: tuple[str, ...]):
    value = scope.get(names[0])
    for name in names[1:]:
        value = value.get(name) if isinstance(value, dict) else None
    return "" if value is None else value


def _writer(node) -> Callable[[dict, bool], Pieces]:
    if isinstance(node, Write):
        value = _value(node.value)

        def write(scope: dict, learned: bool) -> Pieces:
            yield str(value(scope)), learned

        return write
    if isinstance(node, Generation):
        body = _writer(node.body)
        return lambda scope, learned: body(scope, True)
    if isinstance(node, Choice):
        test, then, otherwise = _value(node.test), _writer(node.then), _writer(node.otherwise)
        return lambda scope, learned: then(scope, learned) if test(scope) else otherwise(scope, learned)
    if isinstance(node, Loop):
        over, inner, name = _value(node.over), _writer(node.body), node.name

        def loop(scope: dict, learned: bool) -> Pieces:
            rows = over(scope)
            rows = iter(rows) if not isinstance(rows, str) else iter(())
            row, first = next(rows, None), True
            while row is not None:
                after = next(rows, None)
                yield from inner({**scope, name: row, "loop": {"first": first, "last": after is None}}, learned)
                row, first = after, False

        return loop
    writers = [_writer(p) for p in node.parts]

    def block(scope: dict, learned: bool) -> Pieces:
        for writer in writers:
            yield from writer(scope, learned)

    return block


def compile_template(template: str) -> Callable[[Iterable[dict]], Pieces]:
    """A function from turns (dicts with role, name, text) to pieces of text and whether a model learns to write them."""
    run = _writer(fold(parse(template)))
    return lambda turns: run({"turns": turns}, False)


def loss_text(formatted: Iterable[tuple[str, bool]]) -> str:
    """What a model learns to write, with its escapes undone."""
    return unescape("".join(text for text, learned in formatted if learned))


# ---- Spark


class Rows:
    """Rows of sorted batches one at a time, with a look at the next: groups can be streamed across batches."""

    def __init__(self, batches: Iterable[pa.RecordBatch]):
        self._rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        self.next = next(self._rows, None)

    def group(self, key) -> Iterator[tuple]:
        while self.next is not None and self.next[0] == key:
            row = self.next
            self.next = next(self._rows, None)
            yield row


def _turns(rows: Iterable[tuple]) -> Iterator[dict]:
    for _, turn, role, text in rows:
        role = role or ""
        # a role without a name of its own is written sign by sign escaped, so that no role reads as another
        name = ROLE_NAMES.get(role) or "".join(ESCAPE + c for c in role)
        yield {"turn": turn, "role": role, "name": name, "text": text or ""}


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Conversations as training text: pieces in order, each with its loss mask.

    General: the project keeps no chat records, so this takes ``conv_id, turn, role, text`` as they are named. Returns ``conv_id``,
    ``seq`` (0, 1, ...), ``text`` and ``in_loss``; the formatted conversation is its pieces in order, and the text under the loss
    mask is what ``{% generation %}`` blocks wrote.

    Turns are ordered by turn, then role and text (null turns first), so ties and repeated rows have one order; null texts are
    empty, a null role is the empty one. Rows with a null conv_id are one conversation. Other columns are not read. An empty
    table gives no rows. A template that doesn't parse raises ``TemplateError`` on the driver.

    Turns are dealt by conv_id and sorted on the executors; a task holds two turns of a conversation at a time, never the whole.
    """
    compile_template(template)
    rows = conversations.select("conv_id", "turn", "role", "text")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, source = compile_template(template), Rows(batches)
        out: list[tuple] = []
        size = 0
        while source.next is not None:
            key = source.next[0]
            for seq, (text, learned) in enumerate(render(_turns(source.group(key)))):
                out.append((key, seq, text, learned))
                size += len(text)
                if size > 1 << 20:
                    yield _batch(out, kinds)
                    out, size = [], 0
            for _ in source.group(key):  # turns that the template didn't ask for
                pass
        if out:
            yield _batch(out, kinds)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType(
        [
            rows.schema["conv_id"],
            T.StructField("seq", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("in_loss", T.BooleanType()),
        ]
    )
    kinds = to_arrow_schema(schema)
    return dealt.mapInArrow(run, schema)


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.field(k).type) for k, c in enumerate(zip(*rows, strict=True))], schema=kinds)


def read_back(pieces: DataFrame) -> DataFrame:
    """Turns and loss text of conversations in the standard template, read from the formatted text alone.

    Takes ``format_conversations``'s pieces and returns per conversation ``n_turns``, ``turns_sha256`` (of role, newline, text,
    newline for each turn), ``loss_chars`` and ``loss_sha256`` (text under the mask, escapes undone) and ``formatted_chars``. Pieces
    are read in order and hashed as they pass; a task holds the text of one turn.
    """
    kept = pieces.select("conv_id", "seq", "text", "in_loss")
    dealt = kept.repartition("conv_id").sortWithinPartitions("conv_id", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = Rows(batches)
        while source.next is not None:
            key = source.next[0]
            yield _batch([(key, *_digest((text, learned) for _, _, text, learned in source.group(key)))], kinds)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType(
        [
            kept.schema["conv_id"],
            T.StructField("n_turns", T.LongType()),
            T.StructField("turns_sha256", T.StringType()),
            T.StructField("loss_chars", T.LongType()),
            T.StructField("loss_sha256", T.StringType()),
            T.StructField("formatted_chars", T.LongType()),
        ]
    )
    kinds = to_arrow_schema(schema)
    return dealt.mapInArrow(run, schema)


_END = re.compile(r"(?:[^\\<]|\\.|<(?!/turn>\n))*+</turn>\n", re.S)
_NAMES = {name: role for role, name in ROLE_NAMES.items()}


def _digest(pieces: Iterable[tuple[str, bool]]) -> tuple[int, str, int, str, int]:
    import hashlib

    turns, loss = hashlib.sha256(), hashlib.sha256()
    n_turns = loss_chars = chars = 0
    held = ""
    for text, learned in pieces:
        chars += len(text)
        if learned:
            own = unescape(text)
            loss.update(own.encode())
            loss_chars += len(own)
        held += text
        while held.endswith(TAIL + "\n") and (m := _END.match(held)):
            name, _, body = m[0][len(HEAD) : -len(TAIL) - 1].partition(": ")
            role = _NAMES.get(name) if name in _NAMES else unescape(name)
            turns.update(f"{role}\n{unescape(body)}\n".encode())
            n_turns += 1
            held = held[m.end() :]
    return n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars
