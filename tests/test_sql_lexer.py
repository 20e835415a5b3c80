"""Dumps of any layout: hand-made cases, and random dumps cut into many splits against the rows they were made from."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import types as T

from coursecast.sources import sql_lexer
from coursecast.sources.sql_dump import read_sql_dump
from tests.conftest import rows

SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("title", T.StringType())])

CASES = {
    "comments between tuples": ("INSERT INTO t VALUES (1,'x'), -- note\n(2,'y'),\n/* more */ (3,'z');", [(1, "x"), (2, "y"), (3, "z")]),
    "nested calls": ("INSERT INTO t VALUES (1,concat(upper('x'),'y')),(2,'b');", [(1, "concat(upper('x'),'y')"), (2, "b")]),
    "dead insert": ("/* INSERT INTO t VALUES (9,'dead'); */ INSERT INTO t VALUES (1,'x'); -- INSERT INTO t VALUES (8,'dead');", [(1, "x")]),
    "statement in a text": ("INSERT INTO t VALUES (1,'x; INSERT INTO t VALUES (9,''q'')');", [(1, "x; INSERT INTO t VALUES (9,'q')")]),
    "line in a text": ("INSERT INTO t VALUES (1,'a\nINSERT INTO t VALUES (7, ''b'');\nc');\n", [(1, "a\nINSERT INTO t VALUES (7, 'b');\nc")]),
    "on conflict": ("INSERT INTO t (id, title) VALUES (1,'a'),(2,'b') ON CONFLICT (id) DO UPDATE SET title = (3), id = (4);", [(1, "a"), (2, "b")]),
    "escapes": (r"INSERT INTO t VALUES (1,E'it\'s\n'),(2,$$a'b;($$),(3,$q$c;d$q$);", [(1, "it's\n"), (2, "a'b;("), (3, "c;d")]),
    "casts": ("INSERT INTO t VALUES (1,'a'::text),('2','b'),(+3,DATE '2020-01-01');", [(1, "a"), (2, "b"), (3, "2020-01-01")]),
    "quoted names": ('INSERT INTO public."t" ("title", "id") VALUES (\'a;)\', 1);', [(1, "a;)")]),
    "no last semicolon": ("INSERT INTO t VALUES (1,'a'), (2, null)", [(1, "a"), (2, None)]),
    "other statements": ("SET x = 'it''s';\nCREATE TABLE t (id int, title varchar(9) DEFAULT ('q'));\nINSERT INTO t VALUES (1,'a');\nSELECT f(1), (2);\n"
                         "CREATE FUNCTION f() AS $b$ begin; 'x ( $b$ LANGUAGE q;\nINSERT INTO t VALUES (2,'b');", [(1, "a"), (2, "b")]),
    "empty texts": ("INSERT INTO t VALUES (1,''),(2,''''),(3,' ');", [(1, ""), (2, "'"), (3, " ")]),
    "nothing": ("-- no rows here\n", []),
}


@pytest.fixture
def small_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(n: int) -> None:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield use
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("n_bytes", [1 << 27, 120])
def test_cases(spark, tmp_path, small_splits, n_bytes):
    want = []
    for k, (text, made) in enumerate(CASES.values()):
        (tmp_path / f"d{k}.sql").write_text(text, newline="")
        want += made
    small_splits(n_bytes)
    assert rows(read_sql_dump(spark, str(tmp_path), SCHEMA, table="t")) == sorted(want, key=repr)


WRONG = {
    "text for a number": ("INSERT INTO t VALUES ('abc','x');", "not a value of id"),
    "chain cut off": ("INSERT INTO t VALUES (1,'a'), (2,'b'", "ends within parentheses"),
    "text not closed": ("INSERT INTO t VALUES (1,'a);\n", "ends within"),
    "no comma": ("INSERT INTO t VALUES (1,'a') (2,'b');", "followed by"),
    "words behind": ("INSERT INTO t VALUES (1,'a') 2,'b';", "followed by"),
    "end within a tuple": ("INSERT INTO t VALUES (1,'a'; INSERT INTO t VALUES (2,'b');", "within parentheses"),
    "a query": ("INSERT INTO t SELECT * FROM u;", "without a list of values"),
    "too many values": ("INSERT INTO t VALUES (1,'a',2);", "number of values"),
}


@pytest.mark.parametrize("case", ["text for a number", "too many values", "chain cut off"])
def test_nothing_is_lost_silently(spark, tmp_path, case):
    text, message = WRONG[case]
    (tmp_path / "d.sql").write_text(text)
    with pytest.raises(Exception, match=message):
        read_sql_dump(spark, str(tmp_path), SCHEMA).collect()


def lexed(text: str, cuts: list[int]) -> list[tuple[str, list]]:
    """(table, cells) of all rows of ``text``, read as splits that begin at ``cuts``, each by itself."""
    splits = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
    now, summaries, found, got = (sql_lexer.CODE, False, 0), [], [], []
    for k, split in enumerate(splits):
        reader = sql_lexer.Reader(now[0], now[2], k == 0)
        reader.feed(split)
        summaries.append(json.loads(json.dumps(reader.close(k == len(splits) - 1))))
        found.append(reader.out)
        now = sql_lexer.compose(now, sql_lexer.effect(split, now[0]))
    rows_, contexts = sql_lexer.join_splits(summaries)
    got += [(table, sql_lexer.cells(inside)) for table, _, inside in rows_]
    for out, (low, high, of_split, _) in zip(found, contexts):
        for at, _, inside, open_, table, _ in out:
            if not open_ or low <= at < high:
                got.append((of_split if open_ else table, sql_lexer.cells(inside)))
    return [(table.replace('"', "").split(".")[-1], c) for table, c in got]


def cut_anywhere(rng: random.Random, text: str) -> list[int]:
    places = [m.start() for m in re.finditer(r"\)", text) if m.start()]
    return sorted(rng.sample(places, rng.randrange(0, len(places) + 1)))


def test_cuts_change_nothing():
    rng = random.Random(11)
    for _ in range(1500):
        text, want = random_dump(rng)
        text = text.replace("\r\n", "\n")
        got = [c for table, c in lexed(text, cut_anywhere(rng, text)) if table == "t"]
        assert sorted((int(c[0]), c[1][1:]) if c[0].isdigit() else (int(c[1]), c[0][1:]) for c in got) == sorted(want)


@pytest.mark.parametrize("case", [c for c in WRONG if c not in ("text for a number", "too many values")])
def test_errors_wherever_it_is_cut(case):
    rng, (text, message) = random.Random(2), WRONG[case]
    for _ in range(20):
        with pytest.raises(ValueError, match=message):
            lexed(text, cut_anywhere(rng, text))


def test_bad_values_can_be_null(spark, tmp_path):
    (tmp_path / "d.sql").write_text("INSERT INTO t VALUES ('abc','x'),(2,'y');")
    assert rows(read_sql_dump(spark, str(tmp_path), SCHEMA, strict=False)) == [(2, "y"), (None, "x")]


def random_dump(rng: random.Random) -> tuple[str, list[tuple]]:
    parts = ["a", "''", "(", ")", ";", ",", "--", "/*", "*/", "\n", "INSERT INTO t VALUES (0,''q'');", '"', "$", "e", " ", "\\", "é"]
    comments = ["", " ", "\n", "-- it's (;\n", "/* ) ' ; ( */", "\r\n"]
    gap = lambda: rng.choice(comments)
    text, want, n = [], [], 0
    for _ in range(rng.randrange(1, 7)):
        if rng.random() < 0.3:
            text.append(rng.choice([
                "SET a = 'x;';", "CREATE TABLE x (a int, b char(3) DEFAULT ')');", "INSERT INTO u VALUES (1,'no');", "/* ' */", "-- ) '\n", "DO $$ it's; ( $$;",
            ]))
            continue
        order = rng.random() < 0.3
        head = "INSERT INTO t" + gap() + (" (title, id)" if order else rng.choice(["", " (id, title)", ' ("id",\n"title")'])) + gap() + " VALUES"
        tuples = []
        for _ in range(rng.randrange(1, 6)):
            raw = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 6)))
            n += 1
            value = (str(n), f"'{raw}'")
            tuples.append("(" + f"{gap()},{gap()}".join(reversed(value) if order else value) + ")")
            want.append((n, raw.replace("''", "'")))
        text.append(head + gap() + f"{gap()},{gap()}".join(tuples) + gap() + rng.choice(["", " ON CONFLICT (id) DO NOTHING"]) + ";" + gap())
    return "".join(text), want


@pytest.mark.parametrize("n_bytes", [200])
def test_random_dumps(spark, tmp_path, small_splits, n_bytes):
    rng, want = random.Random(n_bytes), []
    for k in range(6):
        text, made = random_dump(rng)
        (tmp_path / f"d{k}.sql").write_text(text, newline="")
        want += made
    small_splits(n_bytes)
    assert rows(read_sql_dump(spark, str(tmp_path), SCHEMA, table="t")) == sorted(want, key=repr)


def test_effects_compose():
    """The effect of a text is that of its parts, composed, wherever it is cut before a closing parenthesis."""
    rng = random.Random(4)
    for _ in range(300):
        text = random_dump(rng)[0]
        cuts = [m.start() for m in re.finditer(r"\)", text)]
        for state in sql_lexer.STATES:
            whole = sql_lexer.effect(text, state)
            for cut in rng.sample(cuts, min(3, len(cuts))):
                first = sql_lexer.effect(text[:cut], state)
                both = sql_lexer.compose(first, sql_lexer.effect(text[cut:], first[0]))
                assert both[:2] == whole[:2]


def test_one_statement_is_read_by_many_tasks(spark, tmp_path, small_splits):
    n = 20_000
    (tmp_path / "d.sql").write_text("INSERT INTO t (id, title) VALUES " + ",".join(f"({k},'row {k}; (x)')" for k in range(n)) + ";")
    small_splits(40_000)
    assert sql_lexer._records(spark, str(tmp_path)).rdd.getNumPartitions() > 8
    got = read_sql_dump(spark, str(tmp_path), SCHEMA).selectExpr("count(*)", "count(distinct id)", "sum(id)", "count_if(title = concat('row ', id, '; (x)'))")
    assert tuple(got.first()) == (n, n, n * (n - 1) // 2, n)
