"""The full-text query grammar, its predicate form, and pages of ranked hits.

Ranked search runs on a stored index (``operators.index``); ``matches`` is the grammar as a
code-generated predicate for texts that are not indexed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.functions.text import words

K1, B = 1.2, 0.75
#: Columns that a filter ``column:`` can name.
COLUMNS = ("path", "body")
NEAR_REACH = 10


def top_hits(hits: DataFrame, limit: int, *, order: str = "score", tie: str = "id") -> DataFrame:
    """The best ``limit`` hits a query with their 0-based rank."""
    return first_rows(hits, ["query_id"], [F.desc(F.round(order, 9)), F.col(tie)], limit, "rank")


def first_rows(rows: DataFrame, of: list[str], order: list[Column], limit: int, name: str) -> DataFrame:
    """The first ``limit`` rows of each group with their 0-based place. The filter is on the row number
    itself, so that every task cuts its rows to the limit before they are shuffled."""
    w = Window.partitionBy(*of).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).withColumn(name, F.col("_n") - 1).drop("_n")


def normalize_hits(hits: DataFrame, mode: str = "reference") -> DataFrame:
    """``reference`` divides by the least score of the page (all are 1 or more), ``max`` by the most."""
    w = Window.partitionBy("query_id")
    by = F.min("score").over(w) if mode == "reference" else F.max("score").over(w)
    return hits.withColumn("score", F.when(by == 0, F.lit(0.0)).otherwise(F.col("score") / by))


@dataclass(frozen=True, eq=False)
class Node:
    """A parsed query: ``term``, ``prefix`` or ``phrase`` leaves under ``and``, ``or``, ``not`` and
    ``near``. ``cols`` limits a leaf to columns, ``reach`` is the distance of a NEAR group."""

    kind: str
    value: str = ""
    parts: tuple[Node, ...] = ()
    cols: tuple[str, ...] = ()
    reach: int = 0


_LEXEME = re.compile(r'\s*(?:"([^"]*)"(\*?)|(NEAR\()|([()])|(-?\s*(?:%s|\{[^}]*\})\s*:)|([^\s()"]+))' % "|".join(COLUMNS))


def word_list(value: str) -> list[str]:
    return re.findall(r"[^\W_]+", value.lower())


def _lex(query: str) -> list[tuple[str, str]]:
    out, at, query = [], 0, query.rstrip()
    while at < len(query):
        m = _LEXEME.match(query, at)
        if not m:
            raise ValueError(f"unbalanced quote in {query!r}")
        if m[1] is not None:
            out.append(("prefix" if m[2] else "phrase", m[1]))
        elif m[3]:
            out.append(("near", ""))
        elif m[4]:
            out.append((m[4], ""))
        elif m[5]:
            out.append(("cols", m[5]))
        else:
            out.append((m[6], m[6]) if m[6] in ("AND", "OR", "NOT") else ("prefix", m[6][:-1]) if m[6].endswith("*") and len(m[6]) > 1 else ("term", m[6]))
        at = m.end()
    return out


def _columns(text: str) -> tuple[str, ...]:
    named = tuple(re.findall(r"\w+", text))
    if unknown := set(named) - set(COLUMNS):
        raise ValueError(f"no such column: {', '.join(sorted(unknown))}")
    return tuple(c for c in COLUMNS if c not in named) if text.lstrip().startswith("-") else named


def _limited(node: Node, cols: tuple[str, ...]) -> Node:
    inner = tuple(_limited(p, cols) for p in node.parts)
    own = tuple(c for c in cols if c in node.cols) if node.cols else cols
    return Node(node.kind, node.value, inner, own, node.reach)


def parse_query(query: str) -> Node:
    """Words side by side (which bind closest), ``NOT``, ``AND``, ``OR`` (which binds least),
    ``"phrases"``, ``prefix*``, ``NEAR(a b, n)``, ``column:`` filters and parentheses. Raises
    ValueError on a malformed query, before any job runs."""
    tokens = _lex(query)
    place = 0

    def peek() -> str:
        return tokens[place][0] if place < len(tokens) else ""

    def take(kind: str) -> None:
        nonlocal place
        if peek() != kind:
            raise ValueError(f"missing {kind} in {query!r}")
        place += 1

    def near() -> Node:
        nonlocal place
        parts, reach = [], NEAR_REACH
        while peek() in ("term", "phrase", "prefix"):
            kind, value = tokens[place]
            place += 1
            last = value.endswith(",")
            if value.strip(","):
                parts.append(Node(kind, value.rstrip(",")))
            elif not last:
                raise ValueError(f"empty phrase in {query!r}")
            if last:
                if peek() != "term" or not tokens[place][1].isdigit():
                    raise ValueError(f"NEAR needs a number after the comma in {query!r}")
                reach = int(tokens[place][1])
                place += 1
                break
        take(")")
        if not parts or any(not word_list(p.value) for p in parts):
            raise ValueError(f"empty NEAR in {query!r}")
        return Node("near", parts=tuple(parts), reach=reach)

    def unit() -> Node:
        nonlocal place
        kind, value = tokens[place] if place < len(tokens) else ("", "")
        place += 1
        if kind == "cols":
            return _limited(unit(), _columns(value))
        if kind == "(":
            inner = either()
            take(")")
            return inner
        if kind == "near":
            return near()
        if kind in ("term", "phrase", "prefix"):
            if not word_list(value):
                raise ValueError(f"no word in {value!r}")
            return Node(kind, value.lower())
        raise ValueError(f"unexpected {value or kind or 'end'} in {query!r}")

    def beside() -> Node:
        left = unit()
        while peek() in ("term", "phrase", "prefix", "near", "cols", "("):
            left = Node("and", parts=(left, unit()))
        return left

    def without() -> Node:
        nonlocal place
        left = beside()
        while peek() == "NOT":
            place += 1
            left = Node("and", parts=(left, Node("not", parts=(beside(),))))
        return left

    def both() -> Node:
        nonlocal place
        left = without()
        while peek() == "AND":
            place += 1
            left = Node("and", parts=(left, without()))
        return left

    def either() -> Node:
        nonlocal place
        left = both()
        while peek() == "OR":
            place += 1
            left = Node("or", parts=(left, both()))
        return left

    if not tokens:
        raise ValueError("empty query")
    out = either()
    if place < len(tokens):
        raise ValueError(f"unexpected {tokens[place][1] or tokens[place][0]} in {query!r}")
    return out


def leaves(node: Node, near: Node | None = None) -> Iterator[tuple[Node, Node | None]]:
    """The words, prefixes and phrases of a query in order, each with its NEAR group if it has one."""
    if node.kind in ("term", "prefix", "phrase"):
        yield node, near
    for p in node.parts:
        yield from leaves(p, node if node.kind == "near" else near)


def matches(node: Node, text: Column) -> Column:
    """Whether a text satisfies the query, over its tokens joined by single spaces: one scan with
    a code-generated predicate and no join. Column filters and NEAR need the index."""
    joined = F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" "))
    return _holds(node, joined)


def _holds(node: Node, joined: Column) -> Column:
    if node.kind == "near" or node.cols:
        raise ValueError("NEAR and column filters are answered from an index")
    if node.kind == "and":
        return _holds(node.parts[0], joined) & _holds(node.parts[1], joined)
    if node.kind == "or":
        return _holds(node.parts[0], joined) | _holds(node.parts[1], joined)
    if node.kind == "not":
        return ~_holds(node.parts[0], joined)
    value = " ".join(word_list(node.value))
    return joined.contains(f" {value}" if node.kind == "prefix" else f" {value} ")
