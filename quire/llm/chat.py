r"""Chat formatting by a small template compiler.

A template (a sandboxed subset of the usual double-brace language) is scanned into tokens, parsed into a
syntax tree, its constant parts folded, and turned into Python closures that write pieces of text. The
language has {{ expression }}, {% for x in y %}, {% if %}/{% elif %}/{% else %}, {% set %},
{% generation %} and comments; expressions have names, attributes of mappings, literals, + ~ == != in
not and or, and filters from a fixed table. There are no calls, no Python attributes, no imports.
{% generation %} marks what a model would have said: its span in the output is under the loss mask.

Texts and roles go through the filter "escape", which is reversible: a backslash is doubled, and the second
character of a control string gets one in front. So no control string stands in an escaped text, whatever the text was.

Rendering streams: rows come sorted by conversation and turn, one turn is held at a time, and a very
long conversation is written in pieces (piece 0, 1, ...) of at least PIECE characters, cut between turns.

Defined results
---------------
* The query writes the formatted conversations to the shared folder and reads them back file by file, in order.
* Rows are ordered by turn, null turns last, ties by role and text; repeated rows are turns of their own.
* A null role or text is empty. Null conv_ids are one conversation. An empty table gives no conversation.
* Only conv_id, turn, role and text are read; others may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from quire.llm.common import new_path, open_shared, tune

#: Strings that have a meaning in the output: before a role, after it, after a turn.
CONTROL = ("### ", ":\n", "</turn>")
TEMPLATE = (
    "{% for message in messages %}"
    "### {{ message.role | escape }}:\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}"
    "</turn>\n"
    "{% endfor %}"
)
#: Characters of output after which a conversation's next turn starts a new piece.
PIECE = 1 << 20


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for c in CONTROL:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


FILTERS: dict[str, Callable[[object], object]] = {
    "escape": lambda v: escape("" if v is None else str(v)),
    "trim": lambda v: ("" if v is None else str(v)).strip(),
    "lower": lambda v: ("" if v is None else str(v)).lower(),
    "upper": lambda v: ("" if v is None else str(v)).upper(),
}


class TemplateError(ValueError):
    pass


# --- scanning ---

TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
LEXEME = re.compile(r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z]\w*)|(?P<op>==|!=|[.|~+()]))")
ESCAPES = {"n": "\n", "t": "\t"}


def lexemes(source: str) -> list[tuple[str, str]]:
    out, at, source = [], 0, source.rstrip()
    while at < len(source):
        m = LEXEME.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:].strip()[:20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


# --- syntax tree ---


@dataclass
class Const:
    value: object


@dataclass
class Name:
    name: str


@dataclass
class Attribute:
    of: object
    name: str


@dataclass
class Filter:
    of: object
    name: str


@dataclass
class Binary:
    op: str
    left: object
    right: object


@dataclass
class Not:
    of: object


@dataclass
class Output:
    value: object


@dataclass
class Choice:
    branches: list[tuple[object, list]]
    otherwise: list


@dataclass
class Loop:
    name: str
    over: object
    body: list


@dataclass
class Assign:
    name: str
    value: object


@dataclass
class Generation:
    body: list


class ExpressionParser:
    """Precedence climbing: or, and, not, comparison, joining, postfix."""

    def __init__(self, source: str):
        self.rest = lexemes(source)

    def peek(self, *what: str) -> bool:
        return bool(self.rest) and self.rest[0][1] in what and self.rest[0][0] != "string"

    def take(self) -> tuple[str, str]:
        if not self.rest:
            raise TemplateError("expression ends too early")
        return self.rest.pop(0)

    def whole(self):
        out = self.either()
        if self.rest:
            raise TemplateError(f"unexpected {self.rest[0][1]!r}")
        return out

    def chain(self, ops: tuple[str, ...], below):
        out = below()
        while self.peek(*ops):
            op = self.take()[1]
            out = Binary(op, out, below())
        return out

    def either(self):
        return self.chain(("or",), lambda: self.chain(("and",), self.negation))

    def negation(self):
        if self.peek("not"):
            self.take()
            return Not(self.negation())
        return self.chain(("==", "!=", "in"), lambda: self.chain(("~", "+"), self.postfix))

    def postfix(self):
        out = self.atom()
        while self.peek(".", "|"):
            op, (kind, name) = self.take()[1], self.take()
            if kind != "name" or name.startswith("_"):
                raise TemplateError(f"{name!r} is not allowed here")
            if op == "|" and name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            out = Attribute(out, name) if op == "." else Filter(out, name)
        return out

    def atom(self):
        kind, text = self.take()
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "number":
            return Const(int(text))
        if text == "(":
            out = self.either()
            if self.take()[1] != ")":
                raise TemplateError("missing )")
            return out
        if kind != "name":
            raise TemplateError(f"unexpected {text!r}")
        return Const({"true": True, "false": False, "none": None}[text]) if text in ("true", "false", "none") else Name(text)


def parse(source: str) -> list:
    """The syntax tree of a template."""
    root: list = []
    stack: list[tuple[str, list]] = [("", root)]  # what is open, and where nodes go now
    opened: list = []
    at = 0
    for m in TAG.finditer(source):
        if m.start() > at:
            stack[-1][1].append(Output(Const(source[at : m.start()])))
        at = m.end()
        if m[1] is not None:
            stack[-1][1].append(Output(ExpressionParser(m[1]).whole()))
        if m[2] is None:
            continue
        word, _, rest = m[2].strip().partition(" ")
        into = stack[-1][1]
        if word == "for":
            f = re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)
            if not f:
                raise TemplateError(f"for {rest}")
            into.append(node := Loop(f[1], ExpressionParser(f[2]).whole(), []))
            stack.append(("for", node.body))
        elif word == "if":
            into.append(node := Choice([(ExpressionParser(rest).whole(), [])], []))
            opened.append(node)
            stack.append(("if", node.branches[0][1]))
        elif word in ("elif", "else"):
            if stack[-1][0] != "if":
                raise TemplateError(f"{word} without if")
            node = opened[-1]
            if word == "elif":
                node.branches.append((ExpressionParser(rest).whole(), []))
            stack[-1] = ("if", node.branches[-1][1] if word == "elif" else node.otherwise)
        elif word == "set":
            name, _, value = rest.partition("=")
            into.append(Assign(name.strip(), ExpressionParser(value).whole()))
        elif word == "generation":
            into.append(node := Generation([]))
            stack.append(("generation", node.body))
        elif word in ("endfor", "endif", "endgeneration"):
            if stack[-1][0] != word[3:]:
                raise TemplateError(f"{word} does not close {stack[-1][0] or 'anything'}")
            stack.pop()
            if word == "endif":
                opened.pop()
        else:
            raise TemplateError(f"unknown tag {word!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    if at < len(source):
        root.append(Output(Const(source[at:])))
    return root


# --- constant folding ---

OPERATIONS: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "in": lambda a, b: a in b,
    "~": lambda a, b: text_of(a) + text_of(b),
    "+": lambda a, b: a + b,
}


def text_of(value: object) -> str:
    return "" if value is None else str(value)


def fold_expression(e):
    if isinstance(e, Attribute):
        return Attribute(fold_expression(e.of), e.name)
    if isinstance(e, Filter):
        of = fold_expression(e.of)
        return Const(FILTERS[e.name](of.value)) if isinstance(of, Const) else Filter(of, e.name)
    if isinstance(e, Not):
        of = fold_expression(e.of)
        return Const(not of.value) if isinstance(of, Const) else Not(of)
    if isinstance(e, Binary):
        left, right = fold_expression(e.left), fold_expression(e.right)
        if isinstance(left, Const) and e.op in ("and", "or"):
            return right if bool(left.value) == (e.op == "and") else left
        if isinstance(left, Const) and isinstance(right, Const):
            return Const(OPERATIONS[e.op](left.value, right.value))
        return Binary(e.op, left, right)
    return e


def fold(nodes: list) -> list:
    """Constant expressions become values, decided branches replace their choice, neighbouring constants join."""
    out: list = []
    for n in nodes:
        if isinstance(n, Output):
            value = fold_expression(n.value)
            new = [Output(Const(text_of(value.value)) if isinstance(value, Const) else value)]
        elif isinstance(n, Loop):
            new = [Loop(n.name, fold_expression(n.over), fold(n.body))]
        elif isinstance(n, Generation):
            new = [Generation(fold(n.body))]
        elif isinstance(n, Assign):
            new = [Assign(n.name, fold_expression(n.value))]
        else:
            branches, otherwise = [], fold(n.otherwise)
            for test, body in n.branches:
                test = fold_expression(test)
                if not isinstance(test, Const):
                    branches.append((test, fold(body)))
                elif test.value:
                    otherwise = fold(body)
                    break
            new = [Choice(branches, otherwise)] if branches else otherwise
        for x in new:
            if isinstance(x, Output) and isinstance(x.value, Const):
                if not x.value.value:
                    continue
                if out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                    out[-1] = Output(Const(out[-1].value.value + x.value.value))
                    continue
            out.append(x)
    return out


# --- closures ---


@dataclass
class Writer:
    """Takes text; knows the length so far and the spans under the loss mask."""

    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)

    def taken(self) -> tuple[str, list[int], list[int]]:
        """What has been written since the last call, with its spans."""
        out = "".join(self.parts), [s for s, _ in self.spans], [e for _, e in self.spans]
        self.parts, self.length, self.spans = [], 0, []
        return out


def compile_expression(e) -> Callable[[dict], object]:
    if isinstance(e, Const):
        value = e.value
        return lambda scope: value
    if isinstance(e, Name):
        name = e.name
        return lambda scope: scope.get(name)
    if isinstance(e, Attribute):
        of, name = compile_expression(e.of), e.name
        return lambda scope: x.get(name) if isinstance(x := of(scope), dict) else None
    if isinstance(e, Filter):
        of, apply = compile_expression(e.of), FILTERS[e.name]
        return lambda scope: apply(of(scope))
    if isinstance(e, Not):
        of = compile_expression(e.of)
        return lambda scope: not of(scope)
    left, right = compile_expression(e.left), compile_expression(e.right)
    if e.op == "and":
        return lambda scope: left(scope) and right(scope)
    if e.op == "or":
        return lambda scope: left(scope) or right(scope)
    apply = OPERATIONS[e.op]
    return lambda scope: apply(left(scope), right(scope))


def compile_nodes(nodes: list) -> Callable[[dict, Writer], None]:
    steps = [compile_node(n) for n in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(scope: dict, w: Writer) -> None:
        for step in steps:
            step(scope, w)

    return run


def compile_node(n) -> Callable[[dict, Writer], None]:
    if isinstance(n, Output):
        if isinstance(n.value, Const):
            text = n.value.value
            return lambda scope, w: w.put(text)
        value = compile_expression(n.value)
        return lambda scope, w: w.put(text_of(value(scope)))
    if isinstance(n, Assign):
        name, value = n.name, compile_expression(n.value)

        def assign(scope: dict, w: Writer) -> None:
            scope[name] = value(scope)

        return assign
    if isinstance(n, Generation):
        body = compile_nodes(n.body)

        def generation(scope: dict, w: Writer) -> None:
            start = w.length
            body(scope, w)
            w.spans.append((start, w.length))

        return generation
    if isinstance(n, Loop):
        steps = compile_loop(n)

        def loop(scope: dict, w: Writer) -> None:
            for _ in steps(scope, w):
                pass

        return loop
    tests = [(compile_expression(t), compile_nodes(b)) for t, b in n.branches]
    otherwise = compile_nodes(n.otherwise)

    def choice(scope: dict, w: Writer) -> None:
        for test, body in tests:
            if test(scope):
                return body(scope, w)
        return otherwise(scope, w)

    return choice


def compile_loop(n: Loop) -> Callable[[dict, Writer], Iterator[None]]:
    """A generator that stops after each item; what the loop goes over may be an iterator, read item by item."""
    name, over, body = n.name, compile_expression(n.over), compile_nodes(n.body)

    def steps(scope: dict, w: Writer) -> Iterator[None]:
        for index, item in enumerate(over(scope) or ()):
            body(scope | {name: item, "loop": {"index": index + 1, "index0": index, "first": index == 0}}, w)
            yield

    return steps


def compile_template(source: str) -> Callable[[dict, Writer], Iterator[None]]:
    """A generator that renders into a Writer and stops after each item of an outermost loop, so that its caller may take what is written."""
    tree = fold(parse(source))
    steps = [(compile_loop(n), None) if isinstance(n, Loop) else (None, compile_node(n)) for n in tree]

    def run(scope: dict, w: Writer) -> Iterator[None]:
        for looped, plain in steps:
            if looped:
                yield from looped(scope, w)
            else:
                plain(scope, w)

    return run


# --- Spark ---


def sorted_turns(conversations: DataFrame) -> DataFrame:
    """Conversations dealt by conv_id, their turns in order. Spark's sort spills; nothing gathers a conversation."""
    tune(conversations.sparkSession)
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")


def by_conversation(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(conv_id, its rows) for rows in order; a conversation's rows are read before the next conversation comes."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", *columns)), strict=True))
    ahead = next(rows, None)

    def of(conv) -> Iterator[tuple]:
        nonlocal ahead
        while ahead is not None and ahead[0] == conv:
            now, ahead = ahead, next(rows, None)
            yield now[1:]

    while ahead is not None:
        conv = ahead[0]
        own = of(conv)
        yield conv, own
        for _ in own:
            pass


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def render(conversations: DataFrame, template: str = TEMPLATE, piece: int = PIECE) -> DataFrame:
    """conv_id, piece, text, starts, ends: the formatted conversation in pieces, and each piece's spans under the loss mask."""
    compile_template(template)  # a faulty template fails here
    kind = conversations.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("piece", pa.int32()), ("text", pa.string()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write, out, size = compile_template(template), [], 0
        for conv, rows in by_conversation(batches, "role", "text"):
            w, number = Writer(), 0
            for _ in write({"messages": ({"role": r, "text": t} for r, t in rows)}, w):
                if w.length >= piece:
                    out.append((conv, number, *w.taken()))
                    number, size = number + 1, size + piece
                if size >= piece:
                    yield _batch(out, schema)
                    out, size = [], 0
            if w.parts or not number:
                size += w.length
                out.append((conv, number, *w.taken()))
            if size >= piece or len(out) >= 1000:
                yield _batch(out, schema)
                out, size = [], 0
        yield _batch(out, schema)

    return sorted_turns(conversations).mapInArrow(run, f"conv_id {kind.simpleString()}, piece int, text string, starts array<int>, ends array<int>")


def turns_of(text: str) -> Iterator[tuple[str, str]]:
    """The turns that a piece of the default template's output holds: role and text, unescaped."""
    at = 0
    while at < len(text):
        if not text.startswith("### ", at):
            raise ValueError(f"no turn starts at character {at}")
        colon = text.index(":\n", at)
        end = text.index("</turn>\n", colon + 2)
        yield unescape(text[at + 4 : colon]), unescape(text[colon + 2 : end])
        at = end + len("</turn>\n")


def store(formatted: DataFrame) -> DataFrame:
    """path: the files that render()'s output is written to, in the shared folder; a conversation is in one of them, in order."""
    spark = formatted.sparkSession
    path = new_path(spark, "formatted")
    formatted.write.option("compression", "zstd").parquet(path)
    files = [(f,) for f in spark.read.schema(formatted.schema).parquet(path).inputFiles()]  # a name for each task that wrote
    return spark.createDataFrame(files, "path string").repartition(max(1, len(files)))


def stored(files: DataFrame, schema: StructType) -> DataFrame:
    """The rows of files that store() has written, file by file in the order in which they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                with open_shared(path, "random") as f:
                    for rows in pq.ParquetFile(f, buffer_size=1 << 20).iter_batches(16):
                        yield pa.RecordBatch.from_arrays([rows.column(c.name).cast(c.type) for c in arrow], schema=arrow)

    arrow = to_arrow_schema(schema)
    return files.mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """What the pieces hold, as digests for each conversation. formatted is sorted by conv_id and piece within its partitions, as render() and stored() give it."""
    kind = formatted.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, pieces in by_conversation(batches, "text", "starts", "ends"):
            turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for text, starts, ends in pieces:
                chars += len(text)
                for role, said in turns_of(text):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
                for start, end in zip(starts, ends, strict=True):
                    part = unescape(text[start:end])
                    loss_chars += len(part)
                    loss.update(part.encode())
            out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) >= 5000:
                yield _batch(out, schema)
                out = []
        yield _batch(out, schema)

    return formatted.mapInArrow(run, f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def digest(conversations: DataFrame) -> DataFrame:
    """The contract's columns for all conversations and for conversation -7, whose texts hold control strings."""
    spark = conversations.sparkSession
    said = "\\### Assistant: </turn> ok"
    rows = conversations.select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    formatted = render(rows.unionByName(extra))
    return read_back(stored(store(formatted), formatted.schema))
