"""The rows of INSERT statements in dump files of any layout, lexed in parallel.

A dump's text cannot be cut where one likes: whether a parenthesis ends a tuple depends on all quotes and comments
before it. So the lexer is a finite automaton whose effect on a split is a small table: for each state it may begin
in, the state it ends in and the change of nesting. The tables are composed over the splits of a file, one row each;
then every split is read again from the state it really begins in.

Text without comments, quoted names, dollar quotes and ``E''`` in its code, which most of a dump is, is lexed as an array: whether
a byte is in a text follows from the number of quotes before it. All other text is lexed symbol by symbol.

Files are read with ``)`` as the record separator, so a statement is cut into many records even if it is one line, and
no symbol of two characters lies across a cut.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursecast.sources.scratch import settle

# States: code, text, text with backslashes, quoted name, comment to the line's end, comment, dollar-quoted text.
CODE, TEXT, ESCAPED, NAME, LINE, COMMENT, DOLLAR = range(7)
STATES = range(7)

_DOLLARS = r"\$(?:[A-Za-z_]\w*)?\$"
#: A stretch of code without structure, with the quoted texts that are whole.
_PLAIN = re.compile(rf"(?:[^'\"();$/eE\-]++|'[^']*+'|\"[^\"]*+\"|(?<=[\w$])[eE](?=')|[eE](?!')|-(?!-)|/(?!\*)|(?!{_DOLLARS})\$)*+")
_SYMBOL = re.compile(rf"--|/\*|{_DOLLARS}|[eE]'|['\"();]")
_ENTERS = {"'": TEXT, "E'": ESCAPED, '"': NAME, "--": LINE, "/*": COMMENT}
_LEAVES = {
    TEXT: re.compile("'"), ESCAPED: re.compile(r"(?:[^\\']|\\.)*+'", re.S), NAME: re.compile('"'), LINE: re.compile("\n"),
    COMMENT: re.compile(r"\*/"), DOLLAR: re.compile(_DOLLARS),
}


def parts(text: str, state: int) -> Iterator[tuple[str, str, int]]:
    """(kind, text, state behind it) of the pieces of ``text``: ``code``, ``quoted``, ``comment``, or one of ``( ) ;``."""
    at = 0
    while at < len(text):
        if state == CODE:
            end = _PLAIN.match(text, at).end()
            if end > at:
                yield "code", text[at:end], CODE
            if end == len(text):
                return
            symbol = _SYMBOL.match(text, end).group()
            at = end + len(symbol)
            if symbol in "();":
                yield symbol, symbol, CODE
                continue
            state = _ENTERS.get(symbol.upper(), DOLLAR)
            yield ("comment", "", state) if state in (LINE, COMMENT) else ("quoted", symbol, state)
        else:
            found = _LEAVES[state].match(text, at) if state == ESCAPED else _LEAVES[state].search(text, at)
            end = found.end() if found else len(text)
            kind = "comment" if state in (LINE, COMMENT) else "quoted"
            behind = CODE if found else state
            yield kind, "" if kind == "comment" else text[at:end], behind
            at, state = end, behind


_RARE = (b'"', b"$", b"--", b"/*")
_NESTING = np.zeros(256, bool)
_NESTING[list(b"();")] = True


def structure(data: bytes, state: int) -> tuple[np.ndarray, int] | None:
    """Where the parentheses and semicolons of code are, and the state behind; None if there is more than quotes to it."""
    if state not in (CODE, TEXT) or not data:
        return None
    buf = np.frombuffer(data, np.uint8)
    quote = np.flatnonzero(buf == 39)
    first = int(state == TEXT)  # a text has an odd number of quotes before it

    def in_code(at: np.ndarray) -> np.ndarray:
        return (np.searchsorted(quote, at) + first) & 1 == 0

    opening = quote[first::2]
    if len(opening) and (buf[opening[int(opening[0] == 0) :] - 1] | 32 == 101).any():
        return None  # E''
    for symbol in _RARE:
        if symbol in data and in_code(np.array([m.start() for m in re.finditer(re.escape(symbol), data)])).any():
            return None
    at = np.flatnonzero(_NESTING[buf])
    return at[in_code(at)], TEXT if (len(quote) + first) & 1 else CODE


def effect(text: str, state: int) -> tuple[int, bool, int]:
    """State behind ``text``, whether a statement ends in it, and the nesting gained (since the last end, if one does)."""
    if state in (NAME, LINE, COMMENT):
        found = _LEAVES[state].search(text)
        return effect(text[found.end() :], CODE) if found else (state, False, 0)
    data = text.encode()
    if plain := structure(data, state):
        at, behind = plain
        symbols = np.frombuffer(data, np.uint8)[at]
        ends = np.flatnonzero(symbols == 59)
        nesting = np.cumsum(81 - 2 * symbols[ends[-1] + 1 if len(ends) else 0 :].astype(np.int64))  # 1 for ( and -1 for )
        depth = int(nesting[-1]) if len(nesting) else 0
        return behind, len(ends) > 0, depth - min(0, int(nesting.min(initial=0))) if len(ends) else depth
    ended, depth = False, 0
    for kind, _, state in parts(text, state):
        if kind == "(":
            depth += 1
        elif kind == ")":
            depth = max(depth - 1, 0) if ended else depth - 1
        elif kind == ";":
            ended, depth = True, 0
    return state, ended, depth


def compose(first: tuple[int, bool, int], second: tuple[int, bool, int]) -> tuple[int, bool, int]:
    """The effect of ``second``, which begins where ``first`` ends, behind ``first``."""
    state, ended, depth = second
    return state, first[1] or ended, depth if ended else first[2] + depth


_INSERT = re.compile(r"insert\s+into\s+((?:\"[^\"]*\"|[^\s(])+)\s*(.*)$", re.I | re.S)
_VALUES = re.compile(r"\bvalues$", re.I)
HEAD, LIST, REST, UNKNOWN = "head", "list", "rest", "unknown"


@lru_cache(1024)
def _insert_into(words: str) -> str | None:
    """The table of an INSERT that begins with ``words``."""
    start = _INSERT.match(words)
    return start.group(1) if start else None


@lru_cache(1024)
def _ends_in_values(words: str) -> bool:
    return bool(_VALUES.search(words))


@dataclass(slots=True)
class Statement:
    """What is known of the statement that is being read."""

    phase: str = HEAD
    table: str = ""
    columns: str | None = None
    opening: list[tuple[str, str]] = field(default_factory=list)  # groups before VALUES: the text before, the text inside

    def group(self, before: str, inside: str) -> bool:
        """Take in a group in parentheses; whether it is a row."""
        if self.phase == HEAD:
            table = _insert_into(self.opening[0][0] if self.opening else before)
            if table is None:
                self.phase = REST
            elif _ends_in_values(before):
                self.table, self.phase = table, LIST
                self.columns = self.opening[0][1] if self.opening else None
                return True
            else:
                self.opening.append((before, inside))
        elif self.phase == LIST:
            if before == ",":
                return True
            self._follows(before)
            self.phase = REST
        return False

    def _follows(self, words: str) -> None:
        if not re.match(r"(on|returning|as)\b", words, re.I):
            raise ValueError(f"the values of an INSERT into {self.table} are followed by: {words[:200]}")

    def end(self, before: str) -> None:
        """The statement's end behind the words ``before``."""
        first = self.opening[0][0] if self.opening else before
        if self.phase == HEAD and re.match(r"insert\s+into\b", first, re.I):
            raise ValueError(f"an INSERT without a list of values: {first[:200]}")
        if self.phase == LIST and before:
            self._follows(before)


class Reader:
    """Reads one split. Groups in parentheses that are rows go to ``out`` as (ord, before, inside, open, table, columns).

    ``open`` groups belong to a statement begun before the split; whether they are rows is decided when it is known. A
    group that crosses the split's begin or end is in the summary.
    """

    ODD = 8  # groups behind something else than a comma that are told of a statement begun before

    def __init__(self, state: int = CODE, depth: int = 0, known: bool = True) -> None:
        self.state, self.depth = state, depth
        self.now = Statement() if known else Statement(UNKNOWN)
        self.gap: list[str] = []
        self.inside: list[str] = []
        self.before = ""
        self.ord = 0
        self.out: list[tuple] = []
        self.summary: dict = {
            "starts_inside": depth > 0, "closes": None, "first": [], "odd": [], "n_open": 0, "ended": False, "end_words": "", "opens": None,
        }

    def words(self) -> str:
        text = " ".join("".join(self.gap).split())
        self.gap = []
        return text

    def _end(self) -> None:
        if self.depth:
            raise ValueError(f"a statement ends within parentheses: ({''.join(self.inside)[-200:]}")
        if self.now.phase == UNKNOWN:
            self.summary |= {"ended": True, "end_words": self.words(), "n_open": self.ord}
        else:
            self.now.end(self.words())
        self.gap, self.now = [], Statement()

    def _close_group(self) -> None:
        self.depth = 0
        inside, self.inside = "".join(self.inside), []
        if self.summary["starts_inside"] and self.summary["closes"] is None:
            self.summary["closes"] = inside
        else:
            self._group(inside)

    def _feed_plain(self, data: bytes, at: np.ndarray) -> None:
        """Text of which the symbols of code are at ``at``."""
        last = 0
        for place, symbol in zip(at.tolist(), np.frombuffer(data, np.uint8)[at].tolist()):
            if self.depth and symbol != 59 and (symbol == 40 or self.depth > 1):  # within a group
                self.depth += 1 if symbol == 40 else -1
                continue
            (self.inside if self.depth else self.gap).append(data[last:place].decode())
            last = place + 1
            if symbol == 59:
                self._end()
            elif symbol == 40:
                self.before, self.inside, self.depth = self.words(), [], 1
            elif self.depth:
                self._close_group()
        (self.inside if self.depth else self.gap).append(data[last:].decode())

    def feed(self, text: str) -> None:
        data = text.encode()
        if plain := structure(data, self.state):
            self.state = plain[1]
            self._feed_plain(data, plain[0])
            return
        for kind, piece, self.state in parts(text, self.state):
            if kind == ";":
                self._end()
            elif kind == "(" and not self.depth:
                self.before, self.inside, self.depth = self.words(), [], 1
            elif kind == ")" and self.depth == 1:
                self._close_group()
            elif self.depth:
                self.depth += (kind == "(") - (kind == ")")
                self.inside.append(piece or " ")
            elif kind != ")":
                self.gap.append(piece or " ")

    def _group(self, inside: str) -> None:
        if self.now.phase == UNKNOWN:
            if self.before != "," and len(self.summary["odd"]) < self.ODD:
                self.summary["odd"].append(self.ord)
                self.summary["first"].append((self.ord, self.before, inside))
            elif not self.ord:
                self.summary["first"].append((0, self.before, inside))
            self.out.append((self.ord, self.before, inside, True, "", None))
            self.ord += 1
        elif self.now.group(self.before, inside):
            self.out.append((self.ord, self.before, inside, False, self.now.table, self.now.columns))
            self.ord += 1

    def close(self, last: bool) -> dict:
        """What the splits behind need to know; at a file's end all must be closed."""
        if last and (self.depth or self.state not in (CODE, LINE)):
            where = "parentheses" if self.depth else "a quoted text or comment"
            raise ValueError(f"the file ends within {where}: {''.join(self.inside)[-200:]}")
        done = self.summary
        if not done["ended"] and self.now.phase == UNKNOWN:
            done["n_open"] = self.ord
        done["within"] = "".join(self.inside) if done["starts_inside"] and done["closes"] is None else None
        if self.depth and done["within"] is None:
            done["opens"] = (self.before, "".join(self.inside))
        done |= {"words": self.words(), "last": last, "phase": self.now.phase, "table": self.now.table, "columns": self.now.columns, "opening": self.now.opening}
        if last and self.now.phase != UNKNOWN:
            self.now.end(done["words"])
        return done


def join_splits(summaries: list[dict]) -> tuple[list[tuple], list[tuple]]:
    """From the summaries of a file's splits in order: the rows that cross splits (table, columns, inside), and per split the open
    groups that are rows, as (from, up to, table, columns)."""
    rows, contexts = [], []
    now, words, crossing = Statement(), "", ("", "")
    for s in summaries:
        if s["within"] is not None:  # a split within one group
            crossing = (crossing[0], crossing[1] + s["within"])
            contexts.append((0, 0, "", None))
            continue
        unknown = s["n_open"] or s["ended"] or s["phase"] == UNKNOWN
        if s["starts_inside"]:
            if now.group(*(crossing := (crossing[0], crossing[1] + s["closes"]))):
                rows.append((now.table, now.columns, crossing[1]))
            words = ""
        lead = words  # code in front of the split, since the last group or statement
        low, high = 0, s["n_open"] if now.phase == LIST else 0
        odd = set(s["odd"])
        for k, before, inside in s["first"]:
            before = f"{lead} {before}".strip() if k == 0 else before
            if k == 0:
                odd = odd | {0} if before != "," else odd - {0}
            if k and k not in odd:
                continue
            was = now.phase
            if now.group(before, inside):
                if was == HEAD:
                    low, high = k, s["n_open"]
            elif was == LIST:
                high = min(high, k)
        contexts.append((low, high, now.table, now.columns))
        alone = not s["n_open"] and not s["ended"] and unknown
        if s["ended"]:
            now.end(f"{lead} {s['end_words']}".strip() if not s["n_open"] else s["end_words"])
        if not unknown or s["ended"]:
            now = Statement(s["phase"], s["table"], s["columns"], [tuple(o) for o in s["opening"]])
        lead = lead if alone else ""
        if s["opens"]:
            crossing = (f"{lead} {s['opens'][0]}".strip(), s["opens"][1])
            words = ""
        else:
            words = f"{lead} {s['words']}".strip()
        if s["last"] and unknown and not s["ended"]:
            now.end(words)
    return rows, contexts


_CELL = re.compile(r"\s*+(?:'((?:[^']++|'')*+)'|([^'\"(),$\s](?:[^'\"(),$]*[^'\"(),$\s])?))\s*+(,|$)")
_WORDS = re.compile(r"'[^']*'|\"[^\"]*\"|,|[^'\",]+")
_TYPED = re.compile(r"(?:date|time|timestamp|timestamptz|interval)\s*(?=')", re.I)
_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_ESCAPE = re.compile(r"\\([0-7]{1,3}|x[0-9A-Fa-f]{1,2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)


def _unescaped(found: re.Match) -> str:
    code = found.group(1)
    if code[0] in "01234567":
        return chr(int(code, 8))
    return chr(int(code[1:], 16)) if code[0] in "xuU" and len(code) > 1 else _ESCAPES.get(code, code)


def _literal(cell: str) -> str | None:
    """A cell's value: text behind a quote, a bare word or number as it is, None for NULL."""
    cell = cell.strip()
    if cell.upper() == "NULL":
        return None
    body = _TYPED.sub("", cell, count=1) if _TYPED.match(cell) else cell
    pieces = list(parts(body, CODE))
    if pieces and pieces[-1][0] == "code" and (cast := re.search(r"\s*::\s*[A-Za-z_][\w ]*$", pieces[-1][1])):
        body = body[: len(body) - len(cast.group())].rstrip()  # a type behind a literal
    if body.upper() == "NULL":
        return None
    if re.fullmatch(r"'(?:[^']++|'')*+'", body):
        return "'" + body[1:-1].replace("''", "'")
    if re.fullmatch(r"[eE]'(?:[^\\']++|\\.|'')*+'", body, re.S):
        return "'" + _ESCAPE.sub(_unescaped, body[2:-1].replace("''", "'"))
    if dollar := re.fullmatch(rf"({_DOLLARS})(.*)\1", body, re.S):
        return "'" + dollar.group(2)
    return body


def cells(inside: str) -> list[str | None]:
    """The values of a row: text begins with a quote and has no other mark, NULL is None, all else is as it stands."""
    out, at = [], 0
    while found := _CELL.match(inside, at):  # the plain cases
        text, bare, comma = found.groups()
        if text is not None:
            out.append("'" + text.replace("''", "'"))
        else:
            out.append(_literal(bare))
        at = found.end()
        if not comma:
            return out
    now, depth = [], 0
    for kind, piece, _ in parts(inside[at:], CODE):
        depth += (kind == "(") - (kind == ")")
        if kind != "code" or depth:
            now.append(piece)
            continue
        for word in _WORDS.findall(piece):
            if word == ",":
                out.append(_literal("".join(now)))
                now = []
            else:
                now.append(word)
    return [*out, _literal("".join(now))]


_BARE = np.zeros(256, bool)  # what numbers and plain words are made of
_BARE[list(b"0123456789+-._ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\r")] = True


def cell_lists(insides: list[str]) -> pa.ListArray:
    """``cells`` of many rows. Rows of numbers, plain words and texts without doubled quotes are cut as arrays, others one by one."""
    rows = pa.array(insides, pa.large_string())
    edge = np.frombuffer(rows.buffers()[1], np.int64)[: len(rows) + 1]
    buf = np.frombuffer(rows.buffers()[2] or b"", np.uint8)
    quotes = np.concatenate([[0], np.cumsum(buf == 39)])
    comma = np.flatnonzero(buf == 44)
    row = np.searchsorted(edge, comma, "right") - 1
    outside = (quotes[comma] - quotes[edge[row]]) & 1 == 0
    comma, row = comma[outside], row[outside]
    n_cells = np.bincount(row, minlength=len(rows)) + 1
    first = np.concatenate([[0], np.cumsum(n_cells)])
    owner = np.repeat(np.arange(len(rows)), n_cells)
    begin, end = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    opens = np.zeros(first[-1], bool)
    opens[first[:-1]] = True
    closes = np.append(opens[1:], True)[: first[-1]]
    begin[opens], begin[~opens] = edge[:-1], comma + 1
    end[closes], end[~closes] = edge[1:], comma
    padded = np.append(buf, 0)
    while (blank := (begin < end) & _BLANK[padded[begin]]).any():
        begin += blank
    while (blank := (begin < end) & _BLANK[padded[end - 1]]).any():
        end -= blank
    n_quotes = quotes[end] - quotes[begin]
    text = (n_quotes == 2) & (padded[begin] == 39) & (padded[end - 1] == 39) & (end > begin)
    strange = np.concatenate([[0], np.cumsum(~_BARE[buf])])
    plain = text | (end > begin) & (strange[end] == strange[begin])
    simple = np.bincount(owner[~plain], minlength=len(rows)) == 0
    end -= text  # a text keeps the quote in front
    letters = [(padded[np.minimum(begin + k, len(buf))] | 32) == c for k, c in enumerate(b"null")]
    null = ~text & (end - begin == 4) & letters[0] & letters[1] & letters[2] & letters[3]
    keep = simple[owner]
    begin, length, null = begin[keep], (end - begin)[keep], null[keep]
    at = np.concatenate([[0], np.cumsum(length)])
    data = buf[np.repeat(begin - at[:-1], length) + np.arange(at[-1])]
    mask = pa.py_buffer(np.packbits(~null, bitorder="little"))
    values = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data), mask).cast(pa.string())
    found = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n_cells[simple])]).astype(np.int32), values)
    others = np.flatnonzero(~simple)
    if not len(others):
        return found
    odd = pa.array([cells(insides[k]) for k in others.tolist()], pa.list_(pa.string()))
    place = np.empty(len(rows), np.int64)
    place[simple], place[others] = np.arange(len(found)), len(found) + np.arange(len(others))
    return pa.concat_arrays([found.cast(odd.type), odd]).take(pa.array(place))


def _records(spark: SparkSession, path: str) -> DataFrame:
    """One row per stretch up to a closing parenthesis, in order within its split. ``value`` has a parenthesis in front, so that rows
    put together are the text."""
    return spark.read.option("lineSep", ")").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), F.octet_length("value").cast("long").alias("bytes"),
        F.concat(F.lit(")"), "value").alias("value"),
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int, int, str]]:
    """(first row, bytes, number of records, text) of the runs of a task's records that share a split.

    The parenthesis before a split's first record, and between two runs of it, is at the beginning of the text.
    Line ends of two characters become one.
    """
    seen = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        file, block = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        other = pc.not_equal(file.slice(1), file.slice(0, n - 1)).to_numpy(zero_copy_only=False).astype(bool) | (block[1:] != block[:-1])
        edges = [0, *(np.flatnonzero(other) + 1).tolist(), n]
        n_bytes, values = batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).cast(pa.large_string())
        begins = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + n + 1].tolist()
        for at, to in zip(edges, edges[1:]):
            first = {name: batch.column(k)[at].as_py() for k, name in enumerate(batch.schema.names) if name != "value"}
            key = first["file"], first["block"]
            text = values.buffers()[2][begins[at] + int(key[1] == 0 and key != seen) : begins[to]].to_pybytes().decode()
            yield first, int(n_bytes[at:to].sum()), to - at, text.replace("\r\n", "\n")
            seen = key


def _ends_in_separator(n_bytes: int, n_records: int, size: int) -> bool:
    """Each record has a separator behind it, the last one perhaps not. (A compressed file's size does not tell.)"""
    return n_bytes + n_records != size + 1


def _effects(records: DataFrame) -> DataFrame:
    """Per split the effect for each state that it may begin in, its bytes and its number of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}
        for first, n_bytes, n, text in _runs(batches):
            key = first["file"], first["block"], first["size"]
            old_bytes, old_n, effects = found.get(key, (0, 0, [(s, False, 0) for s in STATES]))
            of = {s: effect(text, s) for s in {e[0] for e in effects}}
            found[key] = [old_bytes + n_bytes, old_n + n, [compose(e, of[e[0]]) for e in effects]]
        columns = [list(c) for c in zip(*((*k, b, n, json.dumps(e)) for k, (b, n, e) in found.items()))] or [[]] * 6
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["file", "block", "size", "bytes", "records", "effects"])

    return records.mapInArrow(run, "file string, block long, size long, bytes long, records long, effects string")


def _starts(effects: DataFrame) -> DataFrame:
    """Per split the state and nesting that it begins in, whether it is its file's last, and whether that one ends in a separator."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        now, out = (CODE, False, 0), []
        for r in rows:
            out.append([r["file"], r["block"], now[0], now[2], False, False])
            now = compose(now, tuple(json.loads(r["effects"])[now[0]]))
        out[-1][4:] = True, _ends_in_separator(sum(r["bytes"] for r in rows), sum(r["records"] for r in rows), rows[0]["size"])
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["file", "block", "state", "depth", "last", "tail"])

    return effects.groupBy("file").applyInArrow(run, "file string, block long, state int, depth int, last boolean, tail boolean")


_GROUP = "file string, block long, ord long, cells array<string>, open boolean, table string, columns string, summary string"


def _groups(records: DataFrame) -> DataFrame:
    """The groups of every split that are or may be rows, and one row with the split's summary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, begin, total, count = None, {}, 0, 0
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.bool_(), pa.string(), pa.string(), pa.string()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [f.split()[0] for f in _GROUP.split(", ")])

        def rows() -> pa.RecordBatch:
            n, (ords, _, insides, *others) = len(reader.out), zip(*reader.out)
            reader.out = []
            columns = [[begin["file"]] * n, [begin["block"]] * n, ords, cell_lists(list(insides)), *others, [None] * n]
            return pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds)], [f.split()[0] for f in _GROUP.split(", ")]
            )

        def finish() -> Iterator[pa.RecordBatch]:
            tail = begin["tail"] if begin["tail"] is not None else _ends_in_separator(total, count, begin["size"])
            if begin["last"] and tail:
                reader.feed(")")
            done = json.dumps(reader.close(begin["last"]))
            if reader.out:
                yield rows()
            yield batch_of([(begin["file"], begin["block"], -1, None, False, None, None, done)])

        for first, n_bytes, n, text in _runs(batches):
            if (first["file"], first["block"]) != (begin.get("file"), begin.get("block")):
                if reader is not None:
                    yield from finish()
                begin, total, count = first, 0, 0
                reader = Reader(first["state"], first["depth"], first["block"] == 0)
            total, count = total + n_bytes, count + n
            reader.feed(text)
            if reader.out:
                yield rows()
        if reader is not None:
            yield from finish()

    return records.mapInArrow(run, _GROUP)


def _joined(summaries: DataFrame) -> DataFrame:
    """Per file, from its splits' summaries: rows across splits (``cells``), and contexts of open groups (``low``, ``high``)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        found = sorted(zip(table.column("block").to_pylist(), table.column("summary").to_pylist()))
        rows, contexts = join_splits([json.loads(s) for _, s in found])
        out = [(key[0].as_py(), -1, t, c, cells(inside), 0, 0) for t, c, inside in rows]
        out += [(key[0].as_py(), b, t, c, None, low, high) for (b, _), (low, high, t, c) in zip(found, contexts)]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["file", "block", "table", "columns", "cells", "low", "high"])

    kinds = "file string, block long, table string, columns string, cells array<string>, low long, high long"
    return summaries.groupBy("file").applyInArrow(run, kinds)


def insert_rows(spark: SparkSession, path: str) -> DataFrame:
    """``table``, ``columns`` (the statement's list, null without one) and ``cells`` (as of ``cells``) of every row of every ``INSERT ... VALUES`` in the files of ``path``.

    Other statements are skipped. A file that ends within a statement's values, or values followed by something that is no part
    of an INSERT, are an error, as is an INSERT without VALUES. Comments of the form ``/* */`` do not nest,
    and a dollar-quoted text ends at the next dollar tag, whatever its name. Files of one split
    are read once. Larger ones are read twice: their splits' effects come first, one row each, and are broadcast back to them.
    """
    records = _records(spark, path)
    if records.filter("block > 0").take(1):
        starts = F.broadcast(settle(_starts(_effects(records)), "dump-starts"))
        records = records.join(starts, ["file", "block"]).select(*records.columns, "state", "depth", "last", "tail")
    else:
        nothing = {"state": F.lit(CODE), "depth": F.lit(0), "last": F.lit(True), "tail": F.lit(None).cast("boolean")}
        records = records.select("*", *[c.alias(n) for n, c in nothing.items()])
    groups = settle(_groups(records), "dump-groups")
    known = groups.filter("summary is null and not open").select("table", "columns", "cells")
    if not groups.filter("block > 0").take(1):
        return known
    joined = settle(_joined(groups.filter("summary is not null").select("file", "block", "summary")), "dump-joined")
    context = joined.filter("block >= 0").select("file", "block", F.col("table").alias("t"), F.col("columns").alias("c"), "low", "high")
    open_ = groups.filter("open").join(F.broadcast(context), ["file", "block"]).filter("ord >= low and ord < high")
    across = joined.filter("block < 0").select("table", "columns", "cells")
    return known.unionByName(open_.select(F.col("t").alias("table"), F.col("c").alias("columns"), "cells")).unionByName(across)
