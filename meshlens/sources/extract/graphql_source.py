"""Root fields of GraphQL schemas and operation documents, from a lexer and a reader of nested brackets."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

Fact = tuple[str, dict]
#: Comments and commas are blanks in the language; strings, block strings first, are one token each.
LEXER = re.compile(r'(?P<blank>[\s,\ufeff]+|#[^\n\r]*)|(?P<string>"""(?:\\"""|.)*?"""|"(?:\\.|[^"\\\n])*")|(?P<name>[A-Za-z_]\w*)|(?P<mark>\.\.\.|.)', re.S)
CLOSING = {"{": "}", "(": ")", "[": "]"}


class Token(NamedTuple):
    kind: str
    text: str
    line: int


class Group(NamedTuple):
    """A pair of brackets and what is inside."""

    kind: str
    inside: list


def lexed(source: str) -> Iterator[Token]:
    line = 1
    for m in LEXER.finditer(source):
        if m.lastgroup != "blank":
            yield Token(m.lastgroup, m[0], line)
        line += m[0].count("\n")


def nested(tokens: Iterator[Token]) -> list[Token | Group]:
    """Tokens with brackets as groups; what a missing bracket leaves open ends with the text."""
    stack: list[Group] = [Group("", [])]
    for t in tokens:
        if t.kind == "mark" and t.text in CLOSING:
            stack.append(Group(t.text, []))
            stack[-2].inside.append(stack[-1])
        elif t.kind == "mark" and len(stack) > 1 and t.text == CLOSING[stack[-1].kind]:
            stack.pop()
        elif t.kind != "mark" or t.text not in CLOSING.values():
            stack[-1].inside.append(t)
    return stack[0].inside


def is_mark(x: Token | Group | None, text: str) -> bool:
    return isinstance(x, Token) and x.kind == "mark" and x.text == text


def is_name(x: Token | Group | None) -> bool:
    return isinstance(x, Token) and x.kind == "name"


def is_block(x: Token | Group | None) -> bool:
    return isinstance(x, Group) and x.kind == "{"


def schema_fields(source: str) -> Iterator[Fact]:
    """Fields of the root types, at the line of their type: names before a colon, with or without arguments between."""
    every = nested(lexed(source))
    for i, t in enumerate(every[:-1]):
        kind = every[i + 1]
        if not (is_name(t) and t.text == "type" and is_name(kind) and kind.text in ("Query", "Mutation", "Subscription")):
            continue
        body = next((x for x in every[i + 2 :] if is_block(x) or is_name(x) and x.text in ("type", "extend", "schema", "input", "enum", "scalar")), None)
        inside = body.inside if is_block(body) else []
        for k, name in enumerate(inside):
            after = inside[k + 1 : k + 3]
            if after and isinstance(after[0], Group) and after[0].kind == "(":
                after = after[1:]
            if is_name(name) and after and is_mark(after[0], ":"):
                yield "root_field", {"kind": kind.text.upper(), "field": name.text, "line": t.line}


def selected(block: Group) -> Iterator[str]:
    """Field names of a selection: of an alias what it stands for; spreads, directives and inner selections are left out."""
    skip = 0
    for k, x in enumerate(block.inside):
        if skip:
            skip -= 1
        elif is_mark(x, "..."):
            after = block.inside[k + 1 : k + 3]
            skip = 2 if after and is_name(after[0]) and after[0].text == "on" else 1 if after and is_name(after[0]) else 0
        elif is_mark(x, "@"):
            skip = 1
        elif is_name(x):
            follows = block.inside[k + 1] if k + 1 < len(block.inside) else None
            if not is_mark(follows, ":"):
                yield x.text


def document_fields(source: str) -> tuple[str, list[str]] | None:
    """(kind, fields) of the first operation of a document."""
    kind = "QUERY"
    for x in nested(lexed(source)):
        if is_name(x) and x.text in ("query", "mutation", "subscription"):
            kind = x.text.upper()
        elif is_name(x) and x.text == "fragment":
            kind = ""
        elif is_block(x):
            if not kind:
                kind = "QUERY"
                continue
            fields = list(selected(x))
            return (kind, fields) if fields else None
    return None
