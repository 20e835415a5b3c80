"""Dumps lexed as arrays: the same pieces as symbol by symbol, and most text needs no other way."""

from __future__ import annotations

import random

import pytest

from coursecast.sources import sql_lexer
from tests.test_sql_lexer import random_dump

TOKENS = ["'", "''", "a", "e", "E'", "(", ")", ";", ",", " ", "\n", "--", "/*", "*/", '"', "$$", "1", "NULL", "'x'", "é", "VALUES", "INSERT INTO t", "\\"]
CELLS = ["1", "-2.5", "NULL", "null", "'a'", "''", "'it''s'", "'x,y'", "E'q\\'s'", "$$a,b$$", "f(1,'b')", "'a' || 'b'", "date '2020-01-01'", "'a'::text",
         "", "  5", "é", "'é'", "true", "nul", '"it\'s"', "\x1c7", "\n8"]


def read(text: str, state: int) -> tuple | str:
    reader = sql_lexer.Reader(state)
    try:
        reader.feed(text)
        return reader.out, reader.close(False), reader.state, reader.depth
    except ValueError as error:
        return str(error)


def test_arrays_and_symbols_agree(monkeypatch):
    rng = random.Random(8)
    texts = [random_dump(rng)[0] for _ in range(300)] + ["".join(rng.choice(TOKENS) for _ in range(rng.randrange(14))) for _ in range(3000)]
    both = lambda: [(read(t, s), sql_lexer.effect(t, s)) for t in texts for s in (sql_lexer.CODE, sql_lexer.TEXT)]
    as_arrays = both()
    monkeypatch.setattr(sql_lexer, "structure", lambda data, state: None)
    assert both() == as_arrays


def test_cells_of_many_rows():
    rng = random.Random(9)
    for _ in range(2000):
        rows = [rng.choice([",", ", ", " ,"]).join(rng.choice(CELLS) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 5))]
        assert sql_lexer.cell_lists(rows).to_pylist() == [sql_lexer.cells(r) for r in rows]


def test_a_plain_dump_is_not_read_by_symbols(monkeypatch):
    monkeypatch.setattr(sql_lexer, "parts", lambda text, state: pytest.fail("read symbol by symbol"))
    text = "".join(f"INSERT INTO t (id, title) VALUES ({k}, 'the; ''({k})'' $1 -- note');\n" for k in range(50))
    out = read(text, sql_lexer.CODE)[0]
    assert [o[2] for o in out] == [f"{k}, 'the; ''({k})'' $1 -- note'" for k in range(50)]
    assert sql_lexer.effect(text, sql_lexer.CODE) == (sql_lexer.CODE, True, 0)
    assert sql_lexer.cell_lists([f"{k}, 'row {k}', NULL, 1.5" for k in range(9)]).to_pylist() == [[str(k), f"'row {k}", None, "1.5"] for k in range(9)]
