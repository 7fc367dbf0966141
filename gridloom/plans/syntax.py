"""Formula text to syntax tree and back, byte for byte.

Every node keeps the pieces of source that it was read from, in order: strings (tokens and the blanks around them) and
child nodes. Printing joins the pieces, so a tree always prints as its source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

MAX_COLUMNS, MAX_ROWS = 16384, 1048576
#: Fixed value: sheets made from tables end where places, which are longs, do.
TABLE_ROWS = (1 << 63) - 1
#: The error literals.
ERRORS = ("#DIV/0!", "#N/A", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#NULL!", "#SPILL!", "#CALC!", "#GETTING_DATA")
#: How tightly operators bind.
BINDING = {"=": 10, "<>": 10, "<": 10, "<=": 10, ">": 10, ">=": 10, "&": 20, "+": 30, "-": 30, "*": 40, "/": 40, "^": 50, "%": 60, ",": 84, " ": 90, ":": 100, "#": 110}
UNARY, AT = 70, 95


class FormulaError(ValueError):
    """The text is no formula."""


@dataclass
class Node:
    pieces: list = field(default_factory=list, repr=False, compare=False)

    def text(self) -> str:
        return "".join(p if isinstance(p, str) else p.text() for p in self.pieces)

    def children(self) -> list[Node]:
        return [p for p in self.pieces if isinstance(p, Node)]

    def walk(self) -> Iterator[Node]:
        """This node and all below it, parents first."""
        yield self
        for child in self.children():
            yield from child.walk()


@dataclass
class Number(Node):
    value: float = 0.0


@dataclass
class Text(Node):
    value: str = ""


@dataclass
class Bool(Node):
    value: bool = False


@dataclass
class Error(Node):
    code: str = ""


@dataclass
class Sheet:
    """What stands before a reference's exclamation mark."""

    name: str | None = None
    last: str | None = None  # of a span of sheets
    book: str | None = None  # of another workbook
    dead: bool = False  # the sheet is gone

    def key(self) -> str:
        book = f"[{self.book}]" if self.book is not None else ""
        return "#REF" if self.dead else book + (self.name or "").upper() + (f":{self.last.upper()}" if self.last else "")


@dataclass(frozen=True)
class Axis:
    """A row or column, from 0; absolute with a dollar sign."""

    at: int
    absolute: bool = False


@dataclass
class Ref(Node):
    """A cell, or whole rows or columns. Whole columns have no rows and the other way round."""

    sheet: Sheet | None = None
    row: Axis | None = None
    col: Axis | None = None
    row2: Axis | None = None
    col2: Axis | None = None
    dead: bool = False  # the cells are gone

    @property
    def single(self) -> bool:
        return not self.dead and self.row is not None and self.col is not None


@dataclass
class Name(Node):
    name: str = ""
    sheet: Sheet | None = None


@dataclass
class Table(Node):
    """A structured reference, kept as it is."""

    name: str = ""
    sheet: Sheet | None = None


@dataclass
class Call(Node):
    name: str = ""
    args: list = field(default_factory=list)  # None: left out


@dataclass
class Binary(Node):
    op: str = ""
    left: Node | None = None
    right: Node | None = None


@dataclass
class Unary(Node):
    op: str = ""  # + - @ before, % # after
    of: Node | None = None


@dataclass
class Array(Node):
    rows: list = field(default_factory=list)


@dataclass
class Paren(Node):
    of: Node | None = None


_ERROR = "|".join(map(re.escape, sorted(ERRORS, key=len, reverse=True)))
_WORD = r"[^\W\d]|[\\_]"
_TOKEN = re.compile(
    rf"""(?P<blank>[ \t\r\n ]+)
    |(?P<text>"(?:[^"]|"")*")
    |(?P<quoted>'(?:[^']|'')*'(?=!))
    |(?P<error>{_ERROR})
    |(?P<number>(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?(?![\w.$]))
    |(?P<rows>\$?\d+(?=\s*:\s*\$?\d))
    |(?P<word>(?:[^\W\d]|[\\_$?])(?:[\w.\\?$])*|\$\d+|\d+(?=[!]))
    |(?P<op><>|<=|>=|[-+*/^&=<>%,;:(){{}}!@#\[\]])""",
    re.X,
)


@dataclass
class Token:
    kind: str
    text: str


def lex(source: str) -> list[Token]:
    """The tokens of a formula; brackets and what they hold are one token."""
    out, at = [], 0
    while at < len(source):
        if source[at] == "[":
            depth, end = 0, at
            while end < len(source):
                if source[end] == "'" and depth > 0:  # escapes the next character
                    end += 1
                elif source[end] == "[":
                    depth += 1
                elif source[end] == "]":
                    depth -= 1
                    if not depth:
                        break
                end += 1
            if end >= len(source):
                raise FormulaError("a bracket isn't closed")
            out.append(Token("bracket", source[at : end + 1]))
            at = end + 1
            continue
        m = _TOKEN.match(source, at)
        if not m:
            raise FormulaError(f"nothing starts with {source[at]!r}")
        out.append(Token(m.lastgroup, m[0]))
        at = m.end()
    return out


_CELL = re.compile(r"(\$?)([A-Za-z]{1,3})(\$?)([1-9]\d{0,18})$")
_COLUMN = re.compile(r"(\$?)([A-Za-z]{1,3})$")
_ROW = re.compile(r"(\$?)([1-9]\d{0,18})$")


def column_number(letters: str) -> int:
    """A is 0."""
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def column_letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def cell_name(row: int, col: int) -> str:
    return f"{column_letters(col)}{row + 1}"


def as_cell(word: str, rows: int = MAX_ROWS) -> tuple[Axis, Axis] | None:
    if (m := _CELL.match(word)) and column_number(m[2]) < MAX_COLUMNS and int(m[4]) <= rows:
        return Axis(int(m[4]) - 1, bool(m[3])), Axis(column_number(m[2]), bool(m[1]))
    return None


def as_column(word: str) -> Axis | None:
    if (m := _COLUMN.match(word)) and column_number(m[2]) < MAX_COLUMNS:
        return Axis(column_number(m[2]), bool(m[1]))
    return None


def as_row(word: str, rows: int = MAX_ROWS) -> Axis | None:
    if (m := _ROW.match(word)) and int(m[2]) <= rows:
        return Axis(int(m[2]) - 1, bool(m[1]))
    return None


class Parser:
    def __init__(self, source: str, rows: int = MAX_ROWS):
        self.tokens, self.at, self.rows = lex(source), 0, rows

    def peek(self, ahead: int = 0) -> Token | None:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else None

    def is_op(self, *ops: str, ahead: int = 0) -> bool:
        token = self.peek(ahead)
        return token is not None and token.kind == "op" and token.text in ops

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1].text

    def blanks(self) -> list[str]:
        out = []
        while (token := self.peek()) and token.kind == "blank":
            out.append(self.take())
        return out

    def whole(self) -> Node:
        before = self.blanks()
        node = self.expression(0, False)
        after = self.blanks()
        if self.peek():
            raise FormulaError(f"{self.peek().text!r} doesn't belong here")
        node.pieces = [*before, *node.pieces, *after]
        return node

    def starts_operand(self, ahead: int) -> bool:
        token = self.peek(ahead)
        return token is not None and (token.kind in ("text", "quoted", "error", "number", "rows", "word", "bracket") or (token.kind == "op" and token.text in ("(", "{", "@")))

    def expression(self, least: int, union: bool) -> Node:
        left = self.prefix(union)
        while True:
            start = self.at
            blank = self.blanks()
            token = self.peek()
            if token is None:
                self.at = start
                return left
            if token.kind == "op" and token.text in ("%", "#"):
                if BINDING[token.text] < least:
                    self.at = start
                    return left
                left = Unary([left, *blank, self.take()], token.text, left)
                continue
            if token.kind == "op" and token.text in BINDING and (token.text != "," or union):
                bind = BINDING[token.text]
                if bind < least:
                    self.at = start
                    return left
                op = self.take()
                after = self.blanks()
                right = self.expression(bind + 1, union)
                left = Binary([left, *blank, op, *after, right], op, left, right)
                continue
            if blank and self.starts_operand(0) and BINDING[" "] >= least:
                right = self.expression(BINDING[" "] + 1, union)
                left = Binary([left, *blank, right], " ", left, right)
                continue
            self.at = start
            return left

    def prefix(self, union: bool) -> Node:
        if self.is_op("+", "-", "@"):
            op = self.take()
            blank = self.blanks()
            of = self.expression(AT if op == "@" else UNARY, union)
            return Unary([op, *blank, of], op, of)
        return self.atom()

    def atom(self) -> Node:
        token = self.peek()
        if token is None:
            raise FormulaError("something is missing at the end")
        if token.kind == "number":
            return Number([self.take()], float(token.text))
        if token.kind == "text":
            return Text([self.take()], token.text[1:-1].replace('""', '"'))
        if token.kind == "error":
            return self.dead_or_error()
        if self.is_op("("):
            return self.parenthesis()
        if self.is_op("{"):
            return self.array()
        if token.kind in ("word", "quoted", "rows", "bracket"):
            return self.reference()
        raise FormulaError(f"{token.text!r} doesn't belong here")

    def dead_or_error(self) -> Node:
        code = self.take()
        if code == "#REF!":
            token = self.peek()  # the exclamation mark of a sheet that is gone
            if token and token.kind == "error" and token.text == "#REF!":
                return Ref([code, self.take()], Sheet(dead=True), dead=True)
            if token and token.kind in ("word", "rows"):
                node = self.reference(Sheet(dead=True))
                node.pieces.insert(0, code)
                return node
        return Error([code], code)

    def parenthesis(self) -> Node:
        pieces: list = [self.take(), *self.blanks()]
        of = self.expression(0, True)
        pieces += [of, *self.blanks()]
        if not self.is_op(")"):
            raise FormulaError("a parenthesis isn't closed")
        return Paren([*pieces, self.take()], of)

    def array(self) -> Node:
        pieces: list = [self.take()]
        rows: list[list[Node]] = [[]]
        while True:
            pieces += self.blanks()
            sign = self.take() if self.is_op("-", "+") else ""
            token = self.peek()
            if token and token.kind == "number":
                value: Node = Number([sign + token.text], float(token.text) * (-1 if sign == "-" else 1))
            elif token and not sign and token.kind == "text":
                value = Text([token.text], token.text[1:-1].replace('""', '"'))
            elif token and not sign and token.kind == "error":
                value = Error([token.text], token.text)
            elif token and not sign and token.kind == "word" and token.text.upper() in ("TRUE", "FALSE"):
                value = Bool([token.text], token.text.upper() == "TRUE")
            else:
                raise FormulaError("arrays hold constants only")
            self.take()
            rows[-1].append(value)
            pieces += [value, *self.blanks()]
            if self.is_op(","):
                pieces.append(self.take())
            elif self.is_op(";"):
                pieces.append(self.take())
                rows.append([])
            elif self.is_op("}"):
                pieces.append(self.take())
                return Array(pieces, rows)
            else:
                raise FormulaError("an array isn't closed")

    def sheet(self) -> tuple[Sheet | None, list[str]]:
        """What stands before an exclamation mark, if any."""
        start, pieces, book = self.at, [], None
        token = self.peek()
        if token.kind == "quoted":
            pieces = [self.take(), self.take()]
            name = token.text[1:-1].replace("''", "'")
            if m := re.match(r"(.*)\[([^\]]*)\](.*)$", name):
                book, name = m[1] + m[2], m[3]
            first, colon, last = name.partition(":")
            return Sheet(first, last if colon else None, book), pieces
        if token.kind == "bracket":
            pieces.append(self.take())
            book = token.text[1:-1]
            token = self.peek()
            if self.is_op("!"):
                return Sheet(None, None, book), [*pieces, self.take()]
        if token and token.kind == "word":
            pieces.append(self.take())
            last = None
            if self.is_op(":") and self.peek(1) and self.peek(1).kind == "word" and self.is_op("!", ahead=2):
                pieces += [self.take(), last := self.take()]
            if self.is_op("!"):
                return Sheet(token.text, last, book), [*pieces, self.take()]
        self.at = start
        return None, []

    def reference(self, sheet: Sheet | None = None) -> Node:
        before: list = []
        if sheet is None:
            sheet, before = self.sheet()
        token = self.peek()
        if token is None:
            raise FormulaError("a reference is missing")
        if token.kind == "error" and token.text == "#REF!" and sheet:
            return Ref([*before, self.take()], sheet, dead=True)
        if token.kind == "bracket" and not sheet:
            return Table([*before, self.take()], "", sheet)
        if token.kind not in ("word", "rows", "number"):
            raise FormulaError(f"{token.text!r} is no reference")
        word = token.text
        whole = self.whole_axis(as_column, word) or self.whole_axis(lambda w: as_row(w, self.rows), word)
        if whole:
            (first, last), pieces = whole
            if as_column(word):
                return Ref([*before, *pieces], sheet, None, first, None, last)
            return Ref([*before, *pieces], sheet, first, None, last, None)
        if token.kind != "word":
            raise FormulaError(f"{word!r} is no reference")
        self.take()
        following = self.peek()
        if following and following.kind == "op" and following.text == "(" and not (sheet and sheet.dead):
            return self.call(word, before)
        if cell := as_cell(word, self.rows):
            return Ref([*before, word], sheet, cell[0], cell[1])
        if following and following.kind == "bracket":
            return Table([*before, word, self.take()], word, sheet)
        if not sheet and word.upper() in ("TRUE", "FALSE"):
            return Bool([word], word.upper() == "TRUE")
        if "$" in word:
            raise FormulaError(f"{word!r} is no name")
        return Name([*before, word], word, sheet)

    def whole_axis(self, kind, word: str):
        first = kind(word)
        if first is None:
            return None
        n = 1
        while (t := self.peek(n)) and t.kind == "blank":
            n += 1
        if not self.is_op(":", ahead=n):
            return None
        n += 1
        while (t := self.peek(n)) and t.kind == "blank":
            n += 1
        other = self.peek(n)
        last = kind(other.text) if other and other.kind in ("word", "rows", "number") else None
        if last is None or self.is_op("(", ahead=n + 1) or self.is_op("!", ahead=n + 1):
            return None
        return (first, last), [self.take() for _ in range(n + 1)]

    def call(self, word: str, before: list) -> Node:
        pieces: list = [*before, word, self.take()]
        args: list[Node | None] = []
        pieces += self.blanks()
        if self.is_op(")"):
            return Call([*pieces, self.take()], word, args)
        while True:
            if self.is_op(",", ")"):
                args.append(None)
            else:
                arg = self.expression(0, False)
                args.append(arg)
                pieces += [arg, *self.blanks()]
            if self.is_op(","):
                pieces += [self.take(), *self.blanks()]
                if self.is_op(")"):
                    args.append(None)
                    return Call([*pieces, self.take()], word, args)
            elif self.is_op(")"):
                return Call([*pieces, self.take()], word, args)
            else:
                raise FormulaError("a call isn't closed")


@lru_cache(maxsize=100_000)
def _parsed(source: str, rows: int) -> Node:
    if not source.strip():
        raise FormulaError("nothing there")
    try:
        return Parser(source, rows).whole()
    except RecursionError:
        raise FormulaError("nested too deeply") from None


def parse(source: str, rows: int = MAX_ROWS) -> Node:
    """The tree of a formula without its equals sign. What names a row beyond ``rows`` is a name. Trees are shared: don't
    change them."""
    return _parsed(source, rows)


def parses(source: str, rows: int = MAX_ROWS) -> Node | None:
    try:
        return parse(source, rows)
    except FormulaError:
        return None


def plain_name(name: str) -> str:
    """A function's name in capitals, without the prefixes of newer functions."""
    name = name.upper()
    while name.startswith(("_XLFN.", "_XLWS.")):
        name = name[6:]
    return name


VOLATILE = ("NOW", "TODAY", "RAND", "RANDBETWEEN", "RANDARRAY")
EXTERNAL = "[EXTREF]"
_STRINGS = re.compile(r'"(?:[^"]|"")*"')
_QUOTED = re.compile(r"'(?:[^']|'')*'!")
_CALLED = re.compile(r"(?<![\w.\\$\]])([A-Za-z_][\w.]*)\s*\(")
_OUTSIDE = re.compile(r"(?<![\w\]])\[[^\[\]]+\][^\[\],;()]*!|\[\d+\]!|'[^']*\[[^\]]+\][^']*'!")


def functions_in(source: str) -> list[str]:
    """Names of the functions a formula calls, in order of name, and a mark if it reads another workbook. Works on the
    text, so that formulas that don't parse count too."""
    bare = _STRINGS.sub('""', source)
    outside = bool(_OUTSIDE.search(bare))
    found = {plain_name(m[1]) for m in _CALLED.finditer(_QUOTED.sub("", bare))}
    return sorted(found | ({EXTERNAL} if outside else set()))


# --- shapes


@dataclass(frozen=True)
class Extent:
    """A rectangle as seen from its formula's cell: each border is relative ('rel') or absolute ('abs')."""

    sheet: str | None
    r0: tuple[str, int]
    c0: tuple[str, int]
    r1: tuple[str, int]
    c1: tuple[str, int]
    single: bool

    def text(self) -> str:
        def border(letter: str, border: tuple[str, int]) -> str:
            kind, n = border
            return f"{letter}{n + 1}" if kind == "abs" else letter + (f"[{n}]" if n else "")

        first = border("R", self.r0) + border("C", self.c0)
        last = "" if self.single else ":" + border("R", self.r1) + border("C", self.c1)
        return (f"{self.sheet}!" if self.sheet else "") + first + last


@dataclass(frozen=True)
class Shape:
    """A formula seen from its cell. full: copies of one formula agree in it; structural: with its ranges left open."""

    full: str
    structural: str
    ranges: tuple[Extent, ...]
    ref_error: bool


def shape(node: Node, row: int, col: int) -> Shape:
    ranges: list[Extent] = []
    lost = False

    def border(axis: Axis | None, host: int, otherwise: int) -> tuple[str, int]:
        if axis is None:
            return "abs", otherwise
        return ("abs", axis.at) if axis.absolute else ("rel", axis.at - host)

    def extent(a: Ref, b: Ref | None) -> Extent:
        last = b or a
        r1, c1 = (last.row2 or last.row, last.col2 or last.col)
        return Extent(a.sheet.key() if a.sheet else None, border(a.row, row, 0), border(a.col, col, 0), border(r1, row, MAX_ROWS - 1), border(c1, col, MAX_COLUMNS - 1), b is None and a.single)

    def say(n: Node | None) -> tuple[str, str]:
        nonlocal lost
        if n is None:
            return "", ""
        span = n if isinstance(n, Binary) and n.op == ":" and isinstance(n.left, Ref) and isinstance(n.right, Ref) and n.left.single and n.right.single and n.right.sheet is None else None
        if span or isinstance(n, Ref):
            first = span.left if span else n
            if first.dead or (first.sheet and first.sheet.dead):
                lost = True
                return "#REF!", "#REF!"
            own = extent(first, span.right if span else None)
            ranges.append(own)
            return own.text(), f"®{len(ranges) - 1}"
        if isinstance(n, Number):
            return (f"{n.value!r}",) * 2
        if isinstance(n, Text):
            return (f'"{n.value}"',) * 2
        if isinstance(n, Bool):
            return (str(n.value).upper(),) * 2
        if isinstance(n, Error):
            lost = lost or n.code == "#REF!"
            return n.code, n.code
        if isinstance(n, Name | Table):
            own = (n.sheet.key() + "!" if n.sheet else "") + "".join(p for p in n.pieces if isinstance(p, str)).strip().upper()
            return own, own
        if isinstance(n, Call):
            parts = [say(a) for a in n.args]
            return tuple(f"{plain_name(n.name)}({','.join(p[k] for p in parts)})" for k in (0, 1))
        if isinstance(n, Binary):
            a, b = say(n.left), say(n.right)
            return tuple(f"{a[k]}{n.op}{b[k]}" for k in (0, 1))
        if isinstance(n, Unary):
            a = say(n.of)
            return tuple(f"{a[k]}{n.op}" if n.op in "%#" else f"{n.op}{a[k]}" for k in (0, 1))
        if isinstance(n, Paren):
            a = say(n.of)
            return tuple(f"({a[k]})" for k in (0, 1))
        parts = [";".join(",".join(say(x)[0] for x in r) for r in n.rows)]
        return ("{" + parts[0] + "}",) * 2

    full, structural = say(node)
    return Shape(full, structural, tuple(ranges), lost)
