"""Boolean queries: AND, OR, NOT and parentheses over terms.

A query is parsed into a tree on the driver; the tree becomes one boolean Column over flags, one flag per term. So
however many operators a query has, it is one scan of its terms' postings and one shuffle by document.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexshard.operators.index import Index


class QuerySyntaxError(ValueError):
    """A query that ends where an operand must stand."""


# Fixed value: parentheses, the three operators in capitals as whole words, or a run without blanks and parentheses.
TOKEN = re.compile(r"\(|\)|\bAND\b|\bOR\b|\bNOT\b|[^\s()]+")


@dataclass(frozen=True)
class Term:
    """term is None if nothing is left of the word: no document then."""

    term: str | None


@dataclass(frozen=True)
class Op:
    """kind is AND, OR, MINUS (both sides) or NOT (one)."""

    kind: str
    args: tuple


Node = Term | Op


def parse(query: str, terms: Callable[[str], list[str]]) -> Node:
    """OR binds least, then AND and NOT between two operands (left to right, NOT meaning difference), then prefix NOT.

    Of a word that gives several terms the first counts. A missing closing parenthesis is tolerated. Whatever follows
    a complete expression is ignored, so words without an operator between them are only read up to the first. A
    closing parenthesis or an operator word where an operand must stand is taken as a word.
    """
    words = iter(TOKEN.findall(query))
    ahead = next(words, None)

    def take() -> str:
        nonlocal ahead
        if ahead is None:
            raise QuerySyntaxError(f"an operand is missing: {query!r}")
        now, ahead = ahead, next(words, None)
        return now

    def chain(operand, kinds: dict[str, str]) -> Node:
        left = operand()
        while ahead in kinds:
            kind = kinds[take()]
            left = Op(kind, (left, operand()))
        return left

    def either() -> Node:
        return chain(both, {"OR": "OR"})

    def both() -> Node:
        return chain(negated, {"AND": "AND", "NOT": "MINUS"})

    def negated() -> Node:
        if ahead == "NOT":
            take()
            return Op("NOT", (negated(),))
        return operand()

    def operand() -> Node:
        word = take()
        if word == "(":
            inner = either()
            if ahead == ")":
                take()
            return inner
        return Term(next(iter(terms(word)), None))

    return either()


def terms_in(node: Node) -> list[str]:
    """The distinct terms of a tree in order."""
    found = [node.term] if isinstance(node, Term) else [t for a in node.args for t in terms_in(a)]
    return [t for t in dict.fromkeys(found) if t is not None]


def condition(node: Node, flag: Callable[[str], Column]) -> Column:
    """The tree as a predicate, given that of each term."""
    if isinstance(node, Term):
        return F.lit(False) if node.term is None else flag(node.term)
    args = [condition(a, flag) for a in node.args]
    return {"AND": lambda a, b: a & b, "OR": lambda a, b: a | b, "MINUS": lambda a, b: a & ~b, "NOT": lambda a: ~a}[node.kind](*args)


def holds_without_terms(node: Node) -> bool:
    """Whether a document without any of the terms is found."""
    if isinstance(node, Term):
        return False
    args = [holds_without_terms(a) for a in node.args]
    return {"AND": all, "OR": any, "MINUS": lambda x: x[0] and not x[1], "NOT": lambda x: not x[0]}[node.kind](args)


def boolean_search(index: Index, query: str) -> DataFrame:
    """(doc_id) of the documents found, in order of doc_id."""
    tree = parse(query, index.analyzer.terms)
    terms = terms_in(tree)
    flags = {t: f"has_{i}" for i, t in enumerate(terms)}
    rows = index.postings.where(F.col("term").isin(terms)) if terms else index.postings.where(F.lit(False))
    marked = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), *(F.max(F.col("term") == t).alias(c) for t, c in flags.items()))
    if holds_without_terms(tree):
        marked = index.all_doc_ids().join(marked, "doc_id", "left")
    found = condition(tree, lambda t: F.coalesce(F.col(flags[t]), F.lit(False)))
    return marked.where(found).select("doc_id").orderBy("doc_id")


def _shape(node: Node, number: dict[str, int]) -> Node:
    """The tree with the numbers of its terms instead of the terms."""
    if isinstance(node, Term):
        return node if node.term is None else Term(str(number[node.term]))
    return Op(node.kind, tuple(_shape(a, number) for a in node.args))


def boolean_batch(index: Index, queries: Sequence[tuple[int, str]]) -> DataFrame:
    """(query_id, doc_id) of many queries in one job, as boolean_search finds them.

    Queries of the same shape are one predicate. Those that documents without any of their terms satisfy see all
    documents, once each, as their result does.
    """
    spark, number_of, rows, every = index.postings.sparkSession, {}, [], []
    for q, text in queries:
        tree = parse(text, index.analyzer.terms)
        number = {t: i for i, t in enumerate(terms_in(tree))}
        kind = number_of.setdefault(_shape(tree, number), len(number_of))
        rows += [(q, kind, i, t) for t, i in number.items()]
        if holds_without_terms(tree):
            every.append((q, kind))
    asked = F.broadcast(spark.createDataFrame(rows, "query_id long, kind int, ordinal int, term string"))
    hits = index.postings.where(F.col("term").isin(sorted({t for *_, t in rows}))).select("term", "doc_id").join(asked, "term")
    width = max((i for _, _, i, _ in rows), default=0) + 1
    flags = [F.max(F.col("ordinal") == i).alias(f"has_{i}") for i in range(width)]
    marked = hits.groupBy("query_id", "kind", "doc_id").agg(*flags)
    if every:
        ids = F.explode(F.array(*(F.struct(F.lit(q).cast("long").alias("query_id"), F.lit(k).alias("kind")) for q, k in every)))
        rest = index.all_doc_ids().select(ids.alias("q"), "doc_id").select("q.query_id", "q.kind", "doc_id", *(F.lit(False).alias(f"has_{i}") for i in range(width)))
        marked = marked.unionAll(rest).groupBy("query_id", "kind", "doc_id").agg(*(F.max(f"has_{i}").alias(f"has_{i}") for i in range(width)))
    found = F.lit(False)
    for shape, kind in number_of.items():
        found = F.when(F.col("kind") == kind, condition(shape, lambda i: F.col(f"has_{i}"))).otherwise(found)
    return marked.where(found).select("query_id", "doc_id")


# The same algebra over sets of documents, one operator at a time.


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").distinct().join(b.select("doc_id"), "doc_id", "left_semi")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").unionAll(b.select("doc_id")).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").distinct().join(b.select("doc_id"), "doc_id", "left_anti")


def by_operators(index: Index, node: Node) -> DataFrame:
    """The tree evaluated operator by operator with joins; boolean_search gives the same in one pass."""
    if isinstance(node, Term):
        return (index.get(node.term) if node.term is not None else index.postings.where(F.lit(False))).select("doc_id").distinct()
    args = [by_operators(index, a) for a in node.args]
    if node.kind == "NOT":
        return difference(index.all_doc_ids(), args[0])
    return reduce({"AND": intersect, "OR": union, "MINUS": difference}[node.kind], args)
