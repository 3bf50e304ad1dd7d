"""A parser for the TypeScript and JavaScript that the engine reads: source text to a tree of nodes.

It covers modules, classes, interfaces, functions, statements and expressions with types skipped over, and markup
(elements as expressions) where the file's grammar has it; what it cannot read raises SyntaxProblem, and the file is
skipped as a whole, so no fact is ever guessed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from typing import Any


class SyntaxProblem(ValueError):
    """The text is not in the language, or not in the part of it that is covered."""


@dataclass
class Node:
    """type, range in the text, children in source order, and named parts."""

    type: str
    start: int
    end: int = 0
    children: list[Node] = field(default_factory=list)
    parts: dict[str, Any] = field(default_factory=dict)


@dataclass
class Token:
    type: str
    text: str
    start: int
    end: int
    line_before: bool


_TOKEN = re.compile(r"(?P<id>[#@]?[A-Za-z_$\u0080-￿][\w$\u0080-￿]*)|(?P<num>0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)|(?P<str>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|\*\*|<<|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[{}()\[\];,<>=+\-*/%&|^!~?:.@#])", re.S)
_SPACE = re.compile(r"(?:\s|//[^\n]*|/\*.*?\*/)*", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_OPERAND_ENDS = {")", "]", "}"}
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "await", "yield", "else", "do", "instanceof"}
_HEADS = {"if", "while", "for", "with"}
#: Binding strength of binary operators: fixed values.
_BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
_MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "override", "declare", "async", "accessor"}


def template_end(text: str, at: int) -> tuple[int, list[tuple[int, int]]]:
    """End of the template literal at `at`, and the ranges of its substitutions."""
    i, holes = at + 1, []
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1, holes
        elif text.startswith("${", i):
            depth, j = 1, i + 2
            while j < len(text) and depth:
                if text[j] == "`":
                    j = template_end(text, j)[0]
                    continue
                if text[j] in "'\"":
                    m = re.compile(r"(['\"])(?:(?!\1)[^\\\n]|\\.)*\1").match(text, j)
                    j = m.end() if m else j + 1
                    continue
                depth += {"{": 1, "}": -1}.get(text[j], 0)
                j += 1
            if depth:
                break
            holes.append((i + 2, j - 1))
            i = j
        else:
            i += 1
    raise SyntaxProblem("a template literal does not end")


_NAME = re.compile(r"[A-Za-z_$][\w$]*(?:[-:.][\w$]+)*")
_ATTRIBUTE = re.compile(r"[A-Za-z_$][\w$]*(?:[-:][\w$]+)*")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")


def markup_end(text: str, at: int, end: int) -> tuple[int, list[tuple[str, int, int]]]:
    """End of the element that begins at `at`, and its parts in order: names, strings and holes with their ranges."""
    parts: list[tuple[str, int, int]] = []
    open_names: list[str] = []

    def space(i: int) -> int:
        return _SPACE.match(text, i, end).end()

    def hole(i: int) -> int:
        stop = tokens(text, i + 1, end, markup=True, hole=True)[-1].start
        parts.append(("hole", i + 1, stop))
        return stop + 1

    def tag(i: int) -> int:
        """Behind an opening or empty tag."""
        i = space(i + 1)
        name = _NAME.match(text, i, end)
        if name:
            parts.append(("name", i, name.end()))
            i = name.end()
        while True:
            i = space(i)
            if text.startswith("/>", i) and name:
                return i + 2
            if text.startswith(">", i):
                open_names.append(name[0] if name else "")
                return i + 1
            if not name:
                raise SyntaxProblem("no element")
            if text.startswith("{", i):
                i = hole(i)
                continue
            attribute = _ATTRIBUTE.match(text, i, end)
            if not attribute:
                raise SyntaxProblem("no attribute")
            i = space(attribute.end())
            if text.startswith("=", i):
                i = space(i + 1)
                if text.startswith("{", i):
                    i = hole(i)
                elif quoted := _QUOTED.match(text, i, end):
                    parts.append(("string", i, quoted.end()))
                    i = quoted.end()
                else:
                    raise SyntaxProblem("no value of an attribute")

    i = tag(at)
    while open_names:
        i = min((k for k in (text.find("{", i, end), text.find("<", i, end)) if k >= 0), default=-1)
        if i < 0:
            raise SyntaxProblem("an element does not end")
        if text[i] == "{":
            i = hole(i)
        elif text.startswith("/", space(i + 1)):
            i = space(space(i + 1) + 1)
            name = _NAME.match(text, i, end)
            if (name[0] if name else "") != open_names.pop():
                raise SyntaxProblem("elements end in another order")
            if name:
                parts.append(("name", i, name.end()))
                i = name.end()
            i = space(i)
            if not text.startswith(">", i):
                raise SyntaxProblem("an end tag does not end")
            i += 1
        else:
            i = tag(i)
    return i, parts


def tokens(text: str, start: int = 0, end: int | None = None, *, markup: bool = False, hole: bool = False) -> list[Token]:
    """The tokens of a range; of a hole those before the brace that ends it."""
    out: list[Token] = []
    at, end = start, len(text) if end is None else end
    heads: list[bool] = []  # of every open parenthesis, whether it holds the condition of a statement
    depth, after_head = 0, False
    while True:
        gap = _SPACE.match(text, at, end)
        line = "\n" in text[at : gap.end()]
        at = gap.end()
        if at >= end or hole and not depth and text[at] == "}":
            if hole and at >= end:
                raise SyntaxProblem("a hole does not end")
            out.append(Token("end", "", at, at, True))
            return out
        last = out[-1] if out else None
        operand = last is None or last.type == "op" and (last.text not in _OPERAND_ENDS or after_head) or last.type == "id" and last.text in _BEFORE_REGEX
        if text[at] == "`":
            stop, _ = template_end(text, at)
            out.append(Token("template", text[at:stop], at, stop, line))
        elif text[at] == "/" and operand and (m := _REGEX.match(text, at, end)):
            out.append(Token("regex", m[0], at, m.end(), line))
        elif markup and text[at] == "<" and operand and (stop := _element_end(text, at, end)):
            out.append(Token("markup", text[at:stop], at, stop, line))
        elif m := _TOKEN.match(text, at, end):
            out.append(Token(m.lastgroup, m[0], at, m.end(), line))
        else:
            raise SyntaxProblem(f"unexpected {text[at]!r}")
        new = out[-1]
        at, after_head = new.end, False
        if new.type == "op":
            depth += (new.text == "{") - (new.text == "}")
            if new.text == "(":
                heads.append(last is not None and last.type == "id" and last.text in _HEADS)
            elif new.text == ")" and heads:
                after_head = heads.pop()


def _element_end(text: str, at: int, end: int) -> int:
    """Where the element at this angle ends; 0 if it is none."""
    try:
        return markup_end(text, at, end)[0]
    except SyntaxProblem:
        return 0


class Parser:
    def __init__(self, text: str, start: int = 0, end: int | None = None, *, markup: bool = False):
        self.text, self.toks, self.at, self.has_markup = text, tokens(text, start, end, markup=markup), 0, markup

    # Tokens

    @property
    def tok(self) -> Token:
        return self.toks[self.at]

    def ahead(self, n: int = 1) -> Token:
        return self.toks[min(self.at + n, len(self.toks) - 1)]

    def is_op(self, *texts: str) -> bool:
        return self.tok.type == "op" and self.tok.text in texts

    def is_word(self, *texts: str) -> bool:
        return self.tok.type == "id" and self.tok.text in texts

    def take(self) -> Token:
        self.at += 1
        return self.toks[self.at - 1]

    def expect(self, text: str) -> Token:
        if self.tok.text != text or self.tok.type not in ("op", "id"):
            raise SyntaxProblem(f"expected {text!r}, found {self.tok.text!r}")
        return self.take()

    def skip(self, text: str) -> bool:
        if self.tok.text == text and self.tok.type in ("op", "id"):
            self.at += 1
            return True
        return False

    def close(self, node: Node) -> Node:
        node.end = self.toks[self.at - 1].end if self.at else node.start
        return node

    def attempt(self, read):
        """read(), or None with nothing consumed if it does not fit."""
        at = self.at
        try:
            return read()
        except SyntaxProblem:
            self.at = at
            return None

    def end_statement(self) -> None:
        if not (self.skip(";") or self.is_op("}") or self.tok.type == "end" or self.tok.line_before):
            raise SyntaxProblem(f"unexpected {self.tok.text!r}")

    # Types: read to know where they end; their string literals are nodes

    def type_(self, into: Node) -> tuple[int, int]:
        start = self.tok.start
        self._type_union(into)
        if self.is_word("extends") and not self.tok.line_before:
            self.take()
            self._type_union(into)
            self.expect("?")
            self.type_(into)
            self.expect(":")
            self.type_(into)
        return start, self.toks[self.at - 1].end

    def _type_union(self, into: Node) -> None:
        self.skip("|") or self.skip("&")
        while True:
            self._type_one(into)
            if not (self.skip("|") or self.skip("&")):
                return

    def _type_one(self, into: Node) -> None:
        while self.is_word("keyof", "readonly", "unique", "infer", "asserts", "typeof", "abstract") and self.ahead().type in ("id", "op", "str") and self.ahead().text not in (",", ")", ">", ";", "=", "|", "[", "]", "}"):
            self.take()
        if self.is_word("new"):
            self.take()
        if self.is_op("<"):
            self.type_parameters(into)
        if self.is_op("("):
            if self.attempt(lambda: self._function_type(into)) is None:
                self.take()
                self.type_(into)
                self.expect(")")
        elif self.is_op("{"):
            self.members(into)
        elif self.is_op("["):
            self.take()
            while not self.skip("]"):
                self.skip("...")
                if self.tok.type == "id" and self.ahead().text in (":", "?") and self.ahead(2).text != "]":
                    self.take()
                    self.skip("?")
                    self.expect(":")
                self.type_(into)
                self.skip("?")
                self.skip(",")
        elif self.tok.type == "str":
            into.children.append(self.string())
        elif self.tok.type == "template":
            into.children.append(self.string())
        elif self.tok.type == "num":
            self.take()
        elif self.is_op("-"):
            self.take()
            self.take()
        elif self.tok.type == "id":
            if self.take().text == "import" and self.skip("("):
                into.children.append(self.string())
                self.expect(")")
            while self.skip("."):
                self.take()
            if self.is_op("<") and not self.tok.line_before:
                self.type_arguments(into)
            if self.is_word("is") and not self.tok.line_before:
                self.take()
                self.type_(into)
        else:
            raise SyntaxProblem(f"unexpected {self.tok.text!r} in a type")
        while self.is_op("[") and not self.tok.line_before:
            self.take()
            if not self.is_op("]"):
                self.type_(into)
            self.expect("]")

    def _function_type(self, into: Node) -> bool:
        self.parameters(into)
        self.expect("=>")
        self.type_(into)
        return True

    def type_arguments(self, into: Node) -> bool:
        self.expect("<")
        while not self.is_op(">", ">>", ">>>"):
            self.type_(into)
            self.skip(",")
        self._angle()
        return True

    def _angle(self) -> None:
        """One closing angle, split off from a shift if need be."""
        t = self.tok
        if t.text == ">":
            self.take()
        else:
            self.toks[self.at] = Token("op", t.text[1:], t.start + 1, t.end, False)

    def type_parameters(self, into: Node) -> None:
        self.expect("<")
        while not self.is_op(">"):
            self.skip("const")
            self.take()
            if self.skip("extends"):
                self.type_(into)
            if self.skip("="):
                self.type_(into)
            self.skip(",")
        self.expect(">")

    def annotation(self, into: Node) -> tuple[int, int] | None:
        if not self.is_op(":"):
            return None
        self.take()
        return self.type_(into)

    def members(self, into: Node) -> None:
        """The braces of an object type or interface; method signatures become nodes."""
        self.expect("{")
        while not self.skip("}"):
            start, item = self.tok.start, Node("other", self.tok.start)
            while self.is_word("readonly", "get", "set", "static") and self.ahead().text not in (":", "?", "(", ";", ",", "<"):
                self.take()
            name = None
            if self.skip("new"):
                pass
            elif self.is_op("[") and self.ahead(2).text in (":", "in"):
                self.take()
                self.take()
                self.take()
                self.type_(item)
                self.expect("]")
            elif not self.is_op("(", "<"):
                name = self.property_name(item)
            self.skip("?")
            if self.is_op("("  , "<"):
                if self.is_op("<"):
                    self.type_parameters(item)
                item.type = "method_signature" if name else "other"
                item.parts = {"name": name, "parameters": self.parameters(item)}
            self.annotation(item)
            into.children.append(self.close(item))
            item.start = start
            if not (self.skip(";") or self.skip(",")) and not self.is_op("}") and not self.tok.line_before:
                raise SyntaxProblem("unexpected end of a member")

    # Names, parameters, patterns

    def property_name(self, into: Node) -> str:
        t = self.tok
        if t.type == "str":
            into.children.append(self.string())
            return t.text
        if t.type in ("id", "num"):
            return self.take().text
        if self.is_op("["):
            self.take()
            into.children.append(self.assignment())
            self.expect("]")
            return self.text[t.start : self.toks[self.at - 1].end]
        raise SyntaxProblem(f"unexpected {t.text!r} as a name")

    def binding(self, into: Node) -> str:
        """A name or a pattern; its text."""
        start = self.tok.start
        if self.is_op("{", "["):
            into.children.append(self.primary())
        elif self.tok.type == "id":
            self.take()
        else:
            raise SyntaxProblem(f"unexpected {self.tok.text!r} as a binding")
        return self.text[start : self.toks[self.at - 1].end]

    def parameters(self, into: Node) -> list[Node]:
        self.expect("(")
        out = []
        while not self.skip(")"):
            node = Node("parameter", self.tok.start)
            while self.is_op("@") or self.tok.text.startswith("@"):
                self.decorator(node)
            access = False
            while self.is_word(*_MODIFIERS) and self.ahead().type == "id":
                access |= self.take().text in ("public", "private", "protected")
            self.skip("...")
            name = self.binding(node)
            self.skip("?")
            annotation = self.annotation(node)
            if self.skip("="):
                node.children.append(self.assignment())
            node.parts = {"name": name, "annotation": annotation and self.text[slice(*annotation)], "access": access}
            out.append(self.close(node))
            into.children.append(node)
            if not self.is_op(")"):
                self.expect(",")
        return out

    def decorator(self, into: Node) -> None:
        if self.tok.text == "@":
            self.take()
        into.children.append(self.unary_postfix())

    # Statements

    def program(self) -> Node:
        node = Node("program", 0)
        while self.tok.type != "end":
            node.children.append(self.statement())
        node.end = len(self.text)
        return node

    def block(self) -> Node:
        node = Node("block", self.tok.start)
        self.expect("{")
        while not self.skip("}"):
            node.children.append(self.statement())
        return self.close(node)

    def statement(self) -> Node:
        t = self.tok
        word = t.text if t.type == "id" else ""
        node = Node("other", t.start)
        follows = self.ahead()
        if self.is_op("{"):
            return self.block()
        if self.skip(";"):
            return self.close(node)
        if word.startswith("@"):
            self.decorator(node)
            node.children.append(self.statement())
            return self.close(node)
        if word == "import" and follows.text not in ("(", "."):
            return self.import_()
        if word == "export":
            return self.export()
        if word in ("const", "let", "var") and (follows.type == "id" or follows.text in ("{", "[")):
            if word == "const" and follows.text == "enum":
                self.take()
                return self.enum()
            return self.declaration(node)
        if word == "async" and follows.text == "function" and not follows.line_before:
            self.take()
            return self.function(True, t.start)
        if word == "function":
            return self.function(True, t.start)
        if word == "class":
            return self.class_(True)
        if word == "abstract" and follows.text == "class":
            self.take()
            inner = self.class_(True)
            inner.type, inner.start = "other", t.start
            return inner
        if word == "interface" and follows.type == "id" and not follows.line_before:
            return self.interface()
        if word == "type" and follows.type == "id" and not follows.line_before and self.ahead(2).text in ("=", "<"):
            self.take()
            self.take()
            if self.is_op("<"):
                self.type_parameters(node)
            self.expect("=")
            self.type_(node)
            self.end_statement()
            return self.close(node)
        if word == "enum" and follows.type == "id":
            return self.enum()
        if word == "declare" and follows.type == "id" and not follows.line_before:
            self.take()
            node.children.append(self.statement())
            return self.close(node)
        if word in ("namespace", "module") and follows.type in ("id", "str") and not follows.line_before:
            self.take()
            self.take()
            while self.skip("."):
                self.take()
            node.children.append(self.block())
            return self.close(node)
        if word == "if":
            self.take()
            node.type = "if"
            self.expect("(")
            condition = self.expression()
            self.expect(")")
            node.parts["condition"] = condition
            node.children += [condition, self.statement()]
            if self.skip("else"):
                node.children.append(self.statement())
            return self.close(node)
        if word == "return":
            self.take()
            node.type = "return"
            if not (self.is_op(";", "}") or self.tok.line_before or self.tok.type == "end"):
                node.children.append(self.expression())
            self.end_statement()
            return self.close(node)
        if word in ("throw", "break", "continue", "debugger"):
            self.take()
            if not (self.is_op(";", "}") or self.tok.line_before or self.tok.type == "end"):
                node.children.append(self.expression())
            self.end_statement()
            return self.close(node)
        if word in ("while", "with"):
            self.take()
            self.expect("(")
            node.children.append(self.expression())
            self.expect(")")
            node.children.append(self.statement())
            return self.close(node)
        if word == "do":
            self.take()
            node.children.append(self.statement())
            self.expect("while")
            self.expect("(")
            node.children.append(self.expression())
            self.expect(")")
            self.skip(";")
            return self.close(node)
        if word == "for":
            return self.for_(node)
        if word == "try":
            self.take()
            node.children.append(self.block())
            if self.skip("catch"):
                if self.skip("("):
                    self.binding(node)
                    self.annotation(node)
                    self.expect(")")
                node.children.append(self.block())
            if self.skip("finally"):
                node.children.append(self.block())
            return self.close(node)
        if word == "switch":
            self.take()
            self.expect("(")
            node.children.append(self.expression())
            self.expect(")")
            self.expect("{")
            while not self.skip("}"):
                if self.skip("case"):
                    node.children.append(self.expression())
                else:
                    self.expect("default")
                self.expect(":")
                while not (self.is_op("}") or self.is_word("case", "default")):
                    node.children.append(self.statement())
            return self.close(node)
        if t.type == "id" and follows.text == ":" and follows.type == "op":
            self.take()
            self.take()
            node.children.append(self.statement())
            return self.close(node)
        node.children.append(self.expression())
        self.end_statement()
        return self.close(node)

    def for_(self, node: Node) -> Node:
        self.take()
        self.skip("await")
        self.expect("(")
        if self.is_word("const", "let", "var"):
            self.take()
            item = Node("other", self.tok.start)
            name = self.binding(item)
            if self.is_word("of", "in"):
                node.children.append(self.close(item))
            else:
                node.children.append(self.declarators(Node("other", item.start), name, item))
        elif not self.is_op(";"):
            node.children.append(self.expression(no_in=True))
        if self.is_word("of", "in"):
            self.take()
            node.children.append(self.expression())
        else:
            for stop in (";", ")"):
                self.expect(";")
                if not self.is_op(stop):
                    node.children.append(self.expression())
        self.expect(")")
        node.children.append(self.statement())
        return self.close(node)

    def import_(self) -> Node:
        node = Node("import", self.take().start)
        bindings: list[tuple[str, str]] = []
        if self.is_word("type") and self.ahead().text not in ("from", ",", "="):
            self.take()
        if self.tok.type == "id":
            bindings.append(("default", self.take().text))
            if self.skip("="):
                # An import by require binds nothing and names no source.
                node.children.append(self.expression())
                node.parts = {"source": "", "bindings": []}
                self.end_statement()
                return self.close(node)
            self.skip(",")
        if self.skip("*"):
            self.expect("as")
            bindings.append(("*", self.take().text))
        named = []
        if self.skip("{"):
            while not self.skip("}"):
                if self.is_word("type") and self.ahead().text not in (",", "}", "as"):
                    self.take()
                imported = self.take().text
                named.append((imported, self.take().text if self.skip("as") else imported))
                self.skip(",")
        if bindings or named or self.is_word("from"):
            self.expect("from")
        node.children.append(self.string())
        node.parts = {"source": unquoted(self.toks[self.at - 1].text), "bindings": bindings + named}
        if self.is_word("with", "assert") and not self.tok.line_before and self.ahead().text == "{":
            self.take()
            node.children.append(self.object())
        self.end_statement()
        return self.close(node)

    def export(self) -> Node:
        node = Node("export", self.take().start)
        node.parts["source"] = None
        if self.skip("default"):
            if self.is_word("function", "class", "async", "abstract", "interface"):
                node.children.append(self.statement())
            else:
                node.children.append(self.expression())
                self.end_statement()
            return self.close(node)
        if self.is_word("type") and self.ahead().text in ("{", "*"):
            self.take()
        if self.is_op("*", "{"):
            if self.skip("*"):
                if self.skip("as"):
                    self.take()
            else:
                self.take()
                while not self.skip("}"):
                    self.take()
            if self.skip("from"):
                node.children.append(self.string())
                node.parts["source"] = unquoted(self.toks[self.at - 1].text)
            self.end_statement()
            return self.close(node)
        if self.skip("="):
            node.children.append(self.expression())
            self.end_statement()
            return self.close(node)
        node.children.append(self.statement())
        return self.close(node)

    def declaration(self, node: Node) -> Node:
        self.take()
        item = Node("other", self.tok.start)
        name = self.binding(item)
        self.declarators(node, name, item)
        self.end_statement()
        return self.close(node)

    def declarators(self, node: Node, name: str, item: Node) -> Node:
        while True:
            item.type, item.parts = "declarator", {"name": name, "value": None}
            self.skip("!")
            self.annotation(item)
            if self.skip("="):
                item.parts["value"] = self.assignment()
                item.children.append(item.parts["value"])
            node.children.append(self.close(item))
            if not self.skip(","):
                return self.close(node)
            item = Node("other", self.tok.start)
            name = self.binding(item)

    def function(self, declared: bool, start: int) -> Node:
        self.expect("function")
        node = Node("function" if declared else "function_expression", start)
        self.skip("*")
        name = self.take().text if self.tok.type == "id" else None
        if self.is_op("<"):
            self.type_parameters(node)
        node.parts = {"name": name, "parameters": self.parameters(node), "returns": None}
        returns = self.annotation(node)
        node.parts["returns"] = returns and self.text[slice(*returns)]
        if self.is_op("{"):
            node.children.append(self.block())
        else:
            node.type = "other"
            self.end_statement()
        return self.close(node)

    def class_(self, declared: bool) -> Node:
        node = Node("class" if declared else "other", self.take().start)
        name = self.take().text if self.tok.type == "id" and not self.is_word("extends", "implements") else None
        if self.is_op("<"):
            self.type_parameters(node)
        if self.skip("extends"):
            node.children.append(self.unary_postfix())
            if self.is_op("<"):
                self.type_arguments(node)
        implemented = []
        if self.skip("implements"):
            while True:
                implemented.append(self.text[slice(*self.type_(node))])
                if not self.skip(","):
                    break
        node.parts = {"name": name, "implements": implemented}
        body = Node("class_body", self.tok.start)
        self.expect("{")
        while not self.skip("}"):
            if not self.skip(";"):
                body.children.append(self.class_member())
        node.children.append(self.close(body))
        return self.close(node)

    def class_member(self) -> Node:
        node = Node("other", self.tok.start)
        while self.tok.text.startswith("@") and self.tok.text != "":
            self.decorator(node)
        if self.is_word("static") and self.ahead().text == "{":
            self.take()
            node.children.append(self.block())
            return self.close(node)
        ends = (":", "=", "(", ";", "?", "!", "}", "<", ",")
        while self.is_word(*_MODIFIERS, "get", "set") and self.ahead().text not in ends and not self.ahead().line_before:
            self.take()
        self.skip("*")
        if self.is_op("[") and self.ahead(2).text == ":":
            self.take()
            self.take()
            self.take()
            self.type_(node)
            self.expect("]")
            self.annotation(node)
            self.end_statement()
            return self.close(node)
        name = self.property_name(node)
        if not self.skip("?"):
            self.skip("!")
        if self.is_op("(", "<"):
            if self.is_op("<"):
                self.type_parameters(node)
            node.parts = {"name": name, "parameters": self.parameters(node)}
            self.annotation(node)
            if self.is_op("{"):
                node.type = "method"
                node.children.append(self.block())
            else:
                self.end_statement()
            return self.close(node)
        node.type, node.parts = "field", {"name": name, "value": None, "annotation": None}
        annotation = self.annotation(node)
        node.parts["annotation"] = annotation and self.text[slice(*annotation)]
        if self.skip("="):
            node.parts["value"] = self.assignment()
            node.children.append(node.parts["value"])
        self.close(node)
        self.end_statement()
        return node

    def interface(self) -> Node:
        node = Node("interface", self.take().start)
        node.parts["name"] = self.take().text
        if self.is_op("<"):
            self.type_parameters(node)
        if self.skip("extends"):
            while True:
                self.type_(node)
                if not self.skip(","):
                    break
        self.members(node)
        return self.close(node)

    def enum(self) -> Node:
        node = Node("other", self.take().start)
        self.take()
        self.expect("{")
        while not self.skip("}"):
            self.property_name(node)
            if self.skip("="):
                node.children.append(self.assignment())
            if not self.is_op("}"):
                self.expect(",")
        return self.close(node)

    # Expressions

    def expression(self, no_in: bool = False) -> Node:
        first = self.assignment(no_in)
        if not self.is_op(","):
            return first
        node = Node("sequence", first.start, children=[first])
        while self.skip(","):
            node.children.append(self.assignment(no_in))
        return self.close(node)

    def assignment(self, no_in: bool = False) -> Node:
        start = self.tok.start
        if self.is_word("async") and not self.ahead().line_before and (self.ahead().text in ("(", "<") or self.ahead().type == "id" and self.ahead(2).text == "=>"):
            if (arrow := self.attempt(lambda: self.arrow(start, True))) is not None:
                return arrow
        if self.is_op("(", "<") or self.tok.type == "id" and self.ahead().text == "=>":
            if (arrow := self.attempt(lambda: self.arrow(start, False))) is not None:
                return arrow
        if self.is_word("yield"):
            self.take()
            node = Node("yield", start)
            self.skip("*")
            if not (self.is_op(")", "]", "}", ",", ";") or self.tok.line_before):
                node.children.append(self.assignment(no_in))
            return self.close(node)
        left = self.conditional(no_in)
        if self.is_op(">") and self.angles()[0] in _ASSIGN:
            self.at += self.angles()[1] - 1
            self.toks[self.at] = Token("op", ">>=", self.tok.start, self.tok.end, False)
        if self.tok.type == "op" and self.tok.text in _ASSIGN:
            self.take()
            return self.close(Node("assignment", start, children=[left, self.assignment(no_in)]))
        return left

    def arrow(self, start: int, is_async: bool) -> Node:
        if is_async:
            self.take()
        node = Node("arrow", start)
        if self.tok.type == "id":
            t = self.take()
            parameters = [Node("parameter", t.start, t.end, parts={"name": t.text, "annotation": None, "access": False})]
            self.expect("=>")
        else:
            if self.is_op("<"):
                self.type_parameters(node)
            parameters = self.parameters(node)
            self.annotation(node)
            if self.tok.line_before:
                raise SyntaxProblem("no arrow on this line")
            self.expect("=>")
        node.parts = {"parameters": parameters}
        node.children.append(self.block() if self.is_op("{") else self.assignment())
        return self.close(node)

    def conditional(self, no_in: bool) -> Node:
        start = self.tok.start
        test = self.binary(0, no_in)
        if not self.is_op("?"):
            return test
        self.take()
        yes = self.assignment()
        self.expect(":")
        return self.close(Node("ternary", start, children=[test, yes, self.assignment(no_in)]))

    def angles(self) -> tuple[str, int]:
        """An operator that begins with an angle, which the tokens hold in pieces for the types' sake: text, tokens."""
        joined, n = "", 0
        while self.ahead(n).type == "op" and self.ahead(n).text in (">", "=") and (not n or self.ahead(n).start == self.ahead(n - 1).end) and not joined.endswith("="):
            joined += self.ahead(n).text
            n += 1
        return joined, n

    def operator(self, no_in: bool) -> tuple[str, int]:
        """The binary operator here and its number of tokens; an empty text if there is none."""
        t = self.tok
        if self.is_op(">"):
            joined, n = self.angles()
            return (joined, n) if joined in _BINARY else ("", 0)
        if t.type == "op" and t.text in _BINARY or t.type == "id" and (t.text == "instanceof" or t.text == "in" and not no_in):
            return t.text, 1
        return "", 0

    def binary(self, least: int, no_in: bool) -> Node:
        start = self.tok.start
        left = self.unary_postfix()
        while True:
            if self.is_word("as", "satisfies") and not self.tok.line_before:
                self.take()
                left = Node("as", start, children=[left])
                if not self.skip("const"):
                    self.type_(left)
                self.close(left)
                continue
            op, n = self.operator(no_in)
            strength = _BINARY.get(op, 0)
            if not op or strength <= least:
                return left
            self.at += n
            right = self.binary(strength - (op == "**"), no_in)
            left = self.close(Node("binary", start, children=[left, right], parts={"left": left, "right": right, "operator": op}))

    def unary_postfix(self) -> Node:
        t = self.tok
        if self.is_op("!", "~", "+", "-", "++", "--") or self.is_word("typeof", "void", "delete", "await") and self.ahead().text not in ("=", ")", ",", ";", ".", "=>"):
            self.take()
            return self.close(Node("await" if t.text == "await" else "unary", t.start, children=[self.unary_postfix()]))
        if self.is_op("<"):
            if self.has_markup:
                raise SyntaxProblem("an element cannot be read")
            node = Node("as", t.start)
            self.take()
            self.type_(node)
            self._angle()
            node.children.append(self.unary_postfix())
            return self.close(node)
        node = self.postfix(self.new() if self.is_word("new") and self.ahead().text != "." else self.primary(), True)
        if self.is_op("++", "--") and not self.tok.line_before:
            self.take()
            node = self.close(Node("update", t.start, children=[node]))
        return node

    def postfix(self, node: Node, calls: bool) -> Node:
        while True:
            start = node.start
            if self.is_op(".", "?.") and calls or self.is_op("."):
                optional = self.take().text == "?."
                if optional and self.is_op("("):
                    node = self.call(node, start)
                    node.parts["optional"] = True
                    continue
                if optional and self.is_op("["):
                    self.take()
                    inner = self.expression()
                    self.expect("]")
                    node = self.close(Node("subscript", start, children=[node, inner]))
                    continue
                if self.tok.type != "id":
                    raise SyntaxProblem("a property name is missing")
                name = self.take().text
                node = self.close(Node("member", start, children=[node], parts={"object": node, "property": name, "optional": optional}))
            elif self.is_op("["):
                self.take()
                inner = self.expression()
                self.expect("]")
                node = self.close(Node("subscript", start, children=[node, inner]))
            elif self.is_op("!") and not self.tok.line_before and self.ahead().text not in ("=",):
                self.take()
                node = self.close(Node("non_null", start, children=[node]))
            elif calls and self.is_op("("):
                node = self.call(node, start)
            elif self.tok.type == "template":
                node = self.close(Node("tagged", start, children=[node, self.string()]))
            elif calls and self.is_op("<") and (made := self.attempt(lambda node=node, start=start: self.generic_call(node, start))) is not None:
                node = made
            else:
                return node

    def generic_call(self, node: Node, start: int) -> Node:
        holder = Node("other", self.tok.start)
        self.type_arguments(holder)
        if not self.is_op("("):
            raise SyntaxProblem("no call")
        made = self.call(node, start)
        made.children[1:1] = holder.children
        return made

    def call(self, callee: Node, start: int) -> Node:
        arguments = self.arguments()
        return self.close(Node("call", start, children=[callee, *arguments], parts={"callee": callee, "arguments": arguments}))

    def arguments(self) -> list[Node]:
        self.expect("(")
        out = []
        while not self.skip(")"):
            out.append(self.spread() if self.is_op("...") else self.assignment())
            if not self.is_op(")"):
                self.expect(",")
        return out

    def spread(self) -> Node:
        start = self.take().start
        return self.close(Node("spread", start, children=[self.assignment()]))

    def new(self) -> Node:
        start = self.take().start
        made = self.new() if self.is_word("new") else self.postfix(self.primary(), False)
        node = Node("new", start, children=[made], parts={"constructor": made, "arguments": []})
        if self.is_op("<"):
            self.type_arguments(node)
        if self.is_op("("):
            node.parts["arguments"] = self.arguments()
            node.children += node.parts["arguments"]
        return self.close(node)

    def string(self) -> Node:
        t = self.take()
        if t.type not in ("str", "template"):
            raise SyntaxProblem(f"expected a string, found {t.text!r}")
        node = Node("string", t.start, t.end)
        if t.type == "template":
            for a, b in template_end(self.text, t.start)[1]:
                inner = Parser(self.text, a, b, markup=self.has_markup)
                node.children.append(inner.expression())
                if inner.tok.type != "end":
                    raise SyntaxProblem("unexpected text in a substitution")
        return node

    def markup(self) -> Node:
        """An element: its names with dots are members, its strings and holes expressions."""
        t = self.take()
        node = Node("markup", t.start, t.end)
        for kind, a, b in markup_end(self.text, t.start, t.end)[1]:
            if kind == "string":
                node.children.append(Node("string", a, b))
            elif kind == "name" and "." in self.text[a:b]:
                inner = Parser(self.text, a, b)
                node.children.append(inner.postfix(inner.primary(), False))
            elif kind == "hole":
                inner = Parser(self.text, a, b, markup=True)
                if inner.tok.type != "end":
                    node.children.append(inner.spread() if inner.is_op("...") else inner.expression())
                if inner.tok.type != "end":
                    raise SyntaxProblem("unexpected text in an element")
        return node

    def primary(self) -> Node:
        t = self.tok
        if t.type == "markup":
            return self.postfix(self.markup(), True)
        if t.type in ("str", "template"):
            return self.string()
        if t.type in ("num", "regex"):
            self.take()
            return Node("number" if t.type == "num" else "regex", t.start, t.end)
        if self.is_op("("):
            self.take()
            inner = self.expression()
            self.expect(")")
            return self.close(Node("paren", t.start, children=[inner]))
        if self.is_op("["):
            self.take()
            node = Node("array", t.start)
            while not self.skip("]"):
                if self.skip(","):
                    continue
                node.children.append(self.spread() if self.is_op("...") else self.assignment())
                if not self.is_op("]"):
                    self.expect(",")
            return self.close(node)
        if self.is_op("{"):
            return self.object()
        if t.type != "id":
            raise SyntaxProblem(f"unexpected {t.text!r}")
        if t.text == "function" or t.text == "async" and self.ahead().text == "function":
            self.skip("async")
            return self.function(False, t.start)
        if t.text == "class":
            return self.class_(False)
        self.take()
        kinds = {"this": "this", "true": "true", "false": "false", "null": "null", "undefined": "undefined", "super": "super", "import": "import_call"}
        return Node(kinds.get(t.text, "identifier"), t.start, t.end)

    def object(self) -> Node:
        node = Node("object", self.take().start)
        while not self.skip("}"):
            start = self.tok.start
            if self.is_op("..."):
                node.children.append(self.spread())
            else:
                node.children.append(self.entry(start))
            if not self.is_op("}"):
                self.expect(",")
        return self.close(node)

    def entry(self, start: int) -> Node:
        item = Node("other", start)
        while self.is_word("async", "get", "set") and self.ahead().text not in (",", ":", "(", "}", "=", "<"):
            self.take()
        self.skip("*")
        plain = self.tok.type == "id"
        name = self.property_name(item)
        if self.is_op("(", "<"):
            if self.is_op("<"):
                self.type_parameters(item)
            item.type, item.parts = "method", {"name": name, "parameters": self.parameters(item)}
            self.annotation(item)
            item.children.append(self.block())
        elif self.skip(":"):
            value = self.assignment()
            item.type, item.parts = "pair", {"key": name, "value": value}
            item.children.append(value)
        elif plain:
            item.type, item.parts = "shorthand", {"name": name}
            if self.skip("="):
                item.type = "other"
                item.children.append(self.assignment())
        else:
            raise SyntaxProblem("a value is missing")
        return self.close(item)


def unquoted(text: str) -> str:
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'`" else text


class Places:
    """Line and column, from 1, of offsets in a text."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def of(self, offset: int) -> tuple[int, int]:
        line = bisect_right(self.starts, offset)
        return line, offset - self.starts[line - 1] + 1


def parse(text: str, *, markup: bool = False) -> Node:
    """The program's tree; SyntaxProblem if any part cannot be read. markup: whether the grammar has elements."""
    try:
        return Parser(text, markup=markup).program()
    except RecursionError as e:
        raise SyntaxProblem("too deep") from e
