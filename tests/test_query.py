"""Lexer, parser and their errors; no Spark."""

import pytest

from quillgrid.plans.query import LEGACY, And, Near, Not, Or, Phrase, QueryError, Term, Wildcard, accepts_absent, holds, leaves, lex, parse, phrase_offsets


def test_lexers():
    assert lex('Cat AND "red dog"') == ["cat", "and", '"', "red", "dog", '"']
    assert lex('"red cat"', LEGACY) == ['"red', 'cat"']
    assert lex("near/2(cat sat)", LEGACY) == ["near/2", "(", "cat", "sat", ")"]
    assert lex("a\tb c", LEGACY) == ["a\tb", "c"]


def test_precedence():
    assert parse("cat or dog and not sat") == Or(Term("cat"), And(Term("dog"), Not(Term("sat"))))
    assert parse("(cat or dog) and sat") == And(Or(Term("cat"), Term("dog")), Term("sat"))
    assert parse("not not cat") == Not(Not(Term("cat")))
    assert parse("not not cat", mode=LEGACY) == Not(Term("not"))
    assert parse("cat dog", mode=LEGACY) == Term("cat")


def test_leaves_by_index():
    assert parse('"red cat" and near/2(a b)', "coordinate") == And(Phrase(("red", "cat")), Near(("a", "b"), 2))
    assert parse("th*er and not x") == And(Wildcard("th*er"), Not(Term("x")))
    assert parse("th*er", "inverted", LEGACY) == Term("th*er")
    assert leaves(parse("a and (b or a)")) == [Term("a"), Term("b")]


@pytest.mark.parametrize(
    ("query", "index", "mode", "message"),
    [
        ("", "inverted", "standard", "Unexpected end of query"),
        ("cat and", "inverted", "standard", "Unexpected end of query"),
        ("(cat", "inverted", "standard", "Missing closing parenthesis"),
        ("cat dog", "inverted", "standard", "Unexpected 'dog'"),
        ('"cat', "coordinate", "standard", "Missing closing quote"),
        ("near/1(cat)", "coordinate", "standard", "at least two words"),
        ("near/x(cat sat)", "coordinate", "standard", "Invalid distance"),
        ("near/1 cat", "coordinate", "standard", "Expected '\\('"),
        ("near/1(cat sat", "coordinate", "standard", "Missing closing parenthesis for near"),
        ("cat", "bigram", "standard", "not supported"),
        ('"cat"', "bigram", "standard", "at least two words"),
        ('"a b"', "matrix", "standard", "Unexpected"),
        (")", "inverted", "standard", "Unexpected"),
    ],
)
def test_errors(query, index, mode, message):
    with pytest.raises(QueryError, match=message):
        parse(query, index, mode)


def test_absent_documents():
    assert accepts_absent(parse("not cat")) and accepts_absent(parse("dog or not cat"))
    assert not accepts_absent(parse("dog and not cat"))
    assert holds(parse("a and not b"), lambda x: x == Term("a")) is True


def test_offsets():
    assert phrase_offsets(4) == [0, 1, 2, 3] and phrase_offsets(4, LEGACY) == [0, 1, 3, 6]
