"""Query language: words, AND / OR / NOT, parentheses, "phrases", near/k(words) and wildcards.

    or := and ("or" and)*      and := not ("and" not)*      not := "not" operand | operand

Mode `standard` is the language as advertised. Mode `legacy` keeps the original engine's habits: quotes
are only seen as separate tokens, what follows a complete query is ignored, `not not x` looks up the word
"not", a word that isn't indexed is an error, and phrases of three or more words step 0, 1, 3, 6, ...
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Protocol

from ..functions.patterns import has_wildcard

STANDARD, LEGACY = "standard", "legacy"


class QueryError(ValueError):
    """A query that can't be parsed, or that an index can't answer."""


@dataclass(frozen=True)
class Term:
    word: str


@dataclass(frozen=True)
class Wildcard:
    pattern: str


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]


@dataclass(frozen=True)
class Near:
    words: tuple[str, ...]
    distance: int


@dataclass(frozen=True)
class Not:
    child: Node


@dataclass(frozen=True)
class And:
    left: Node
    right: Node


@dataclass(frozen=True)
class Or:
    left: Node
    right: Node


Leaf = Term | Wildcard | Phrase | Near
Node = Leaf | Not | And | Or


@dataclass(frozen=True)
class LeafPolicy:
    """What an index can answer."""

    term: bool = True
    phrase: bool = False
    near: bool = False
    wildcard: bool = False
    min_phrase: int = 1


POLICIES = {
    "matrix": LeafPolicy(),
    "inverted": LeafPolicy(wildcard=True),
    "bigram": LeafPolicy(term=False, phrase=True, min_phrase=2),
    "coordinate": LeafPolicy(phrase=True, near=True, wildcard=True),
}


def lex(query: str, mode: str = STANDARD) -> list[str]:
    """Lower-cased tokens. Standard mode splits at any white space and around quotes, legacy mode at blanks only."""
    query = query.lower()
    if mode == STANDARD:
        return re.findall(r'[()"]|[^\s()"]+', query)
    return [t for t in (x.strip() for x in re.findall(r"[()]|[^ ()]+", query)) if t]


class Parser:
    def __init__(self, query: str, policy: LeafPolicy, mode: str = STANDARD):
        self.tokens, self.at, self.policy, self.mode = lex(query, mode), 0, policy, mode

    def parse(self) -> Node:
        node = self.either()
        if self.mode == STANDARD and self.at < len(self.tokens):
            raise QueryError(f"Unexpected '{self.tokens[self.at]}' after the query")
        return node

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> str:
        if self.at >= len(self.tokens):
            raise QueryError("Unexpected end of query")
        self.at += 1
        return self.tokens[self.at - 1]

    def either(self) -> Node:
        node = self.both()
        while self.peek() == "or":
            self.at += 1
            node = Or(node, self.both())
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.peek() == "and":
            self.at += 1
            node = And(node, self.negated())
        return node

    def negated(self) -> Node:
        if self.peek() != "not":
            return self.operand()
        self.at += 1
        return Not(self.operand() if self.mode == LEGACY else self.negated())

    def until(self, end: str, complaint: str) -> tuple[str, ...]:
        words = []
        while self.peek() not in (end, None):
            words.append(self.take())
        if self.peek() is None:
            raise QueryError(complaint)
        self.at += 1
        return tuple(words)

    def operand(self) -> Node:
        token = self.take()
        if token == "(":
            node = self.either()
            if self.peek() != ")":
                raise QueryError("Missing closing parenthesis")
            self.at += 1
            return node
        if token == '"' and self.policy.phrase:
            words = self.until('"', "Missing closing quote")
            if len(words) < self.policy.min_phrase:
                raise QueryError("Phrase must contain at least two words")
            return Phrase(words)
        if token.startswith("near/") and self.policy.near:
            number = token.removeprefix("near/")
            if not re.fullmatch(r"\+?[0-9]+", number):
                raise QueryError(f"Invalid distance in near operator: {number}")
            if self.peek() != "(":
                raise QueryError("Expected '(' after near operator")
            self.at += 1
            words = self.until(")", "Missing closing parenthesis for near operator")
            if len(words) < 2:
                raise QueryError("Near operator requires at least two words")
            return Near(words, int(number))
        if self.mode == STANDARD and (token in ("and", "or", ")") or token == '"' or token.startswith("near/")):
            raise QueryError(f"Unexpected '{token}'")
        if self.mode == STANDARD and has_wildcard(token) and self.policy.wildcard:
            return Wildcard(token)
        if not self.policy.term:
            raise QueryError("Single-word search is not supported by this index; use a phrase")
        return Term(token)


class QueryParser(Protocol):
    """Anything that makes a query's tree for an index; `parse` is the one that collections use."""

    def __call__(self, query: str, index: str = "inverted", mode: str = STANDARD) -> Node: ...


def parse(query: str, index: str = "inverted", mode: str = STANDARD) -> Node:
    return Parser(query, POLICIES[index], mode).parse()


def leaves(node: Node) -> list[Leaf]:
    """Distinct leaves in order of appearance."""
    match node:
        case Not(child):
            found = leaves(child)
        case And(left, right) | Or(left, right):
            found = leaves(left) + leaves(right)
        case _:
            found = [node]
    return list(dict.fromkeys(found))


def holds(node: Node, leaf) -> object:
    """The query's value with leaf(x) for each leaf; works for booleans and for columns."""
    match node:
        case Not(child):
            value = holds(child, leaf)
            return (not value) if isinstance(value, bool) else ~value
        case And(left, right):
            return holds(left, leaf) & holds(right, leaf)
        case Or(left, right):
            return holds(left, leaf) | holds(right, leaf)
    return leaf(node)


def accepts_absent(node: Node) -> bool:
    """Whether a document with none of the leaves matches, so that all documents must be looked at."""
    return bool(holds(node, lambda _: False))


def phrase_offsets(n: int, mode: str = STANDARD) -> list[int]:
    """Distances of a phrase's words from its first: 0, 1, 2, .. or, in legacy mode, 0, 1, 3, 6, .."""
    return [i if mode == STANDARD else i * (i + 1) // 2 for i in range(n)]
