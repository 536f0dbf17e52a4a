"""Named jobs: functions of a context and arguments whose output is text."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

from brindle.operators.bags import Bag
from brindle.operators.keyed import KeyedTable

# Fixed value: what a job that says nothing answers with.
NO_OUTPUT = "no output"

_jobs: dict[str, Callable[[Context, Sequence[str]], None]] = {}


class Context:
    """What a job works with: the session, its tables, and its output so far."""

    def __init__(self, spark: SparkSession):
        self.spark, self._said = spark, []

    def output(self, text: str) -> None:
        """Add to the job's output; all calls are put together."""
        self._said.append(text)

    @property
    def said(self) -> str:
        return "".join(self._said) or NO_OUTPUT

    def keyed(self, name: str) -> KeyedTable:
        return KeyedTable(self.spark, name)

    def parallelize(self, values: Iterable[str]) -> Bag:
        return Bag.parallelize(self.spark, values)

    def from_table(self, table: DataFrame | str, expr) -> Bag:
        return Bag.from_table(self.spark.table(table) if isinstance(table, str) else table, expr)


def job(name: str) -> Callable:
    """Register a function ``(context, arguments)`` as a job."""

    def register(f: Callable[[Context, Sequence[str]], None]) -> Callable:
        _jobs[name] = f
        return f

    return register


def job_names() -> list[str]:
    return sorted(_jobs)


def run_job(spark: SparkSession, name: str, arguments: Sequence[str] = ()) -> str:
    """The output of a job. An unknown name is a LookupError; what the job raises comes through."""
    if name not in _jobs:
        raise LookupError(name)
    context = Context(spark)
    _jobs[name](context, list(arguments))
    return context.said


@job("word-count")
def word_count(context: Context, arguments: Sequence[str]) -> None:
    """Counts of the words of a text path."""
    from pyspark.sql import functions as F

    from brindle.functions.text import tokens

    words = context.spark.read.text(arguments[0]).select(F.explode(tokens("value")).alias("word"))
    for r in words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(int(arguments[1]) if len(arguments) > 1 else 20).collect():
        context.output(f"{r['word']} {r['n']}\n")


@job("merge-indexes")
def merge_two(context: Context, arguments: Sequence[str]) -> None:
    """Two indexes and their document maps, given as tables, to two new tables: index, index, documents, documents, to, to."""
    from brindle.operators.index import merge_all

    a, b, da, db, to, to_docs = arguments
    documents, postings = merge_all((context.spark.table(da), context.spark.table(a)), (context.spark.table(db), context.spark.table(b)))
    postings.write.saveAsTable(to)
    documents.write.saveAsTable(to_docs)
    context.output(f"{to} {to_docs}\n")
