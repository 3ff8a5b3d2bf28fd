"""Small helpers that several operators share."""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import wraps

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.session import materialise

__all__ = ["WORD", "ascii_lower", "counted_join", "hot_join", "materialise", "salted_join", "ship", "text_of", "without_lines", "words", "xxhash128"]

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: The columns of the table ``documents``.
DOCUMENT = frozenset(["doc_id", "text", "lang", "source", "n_chars"])
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_of(column: str | Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, UPPER, UPPER.lower())


def words(column: Column) -> Column:
    return F.regexp_extract_all(column, F.lit(WORD), F.lit(0))


def xxhash128(*columns: Column) -> tuple[Column, Column]:
    """Two hashes with different seeds; together 128 bits."""
    return F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], by: Column, how: str = "inner", salts: int = 16) -> DataFrame:
    """Join where one key may hold a third of ``left``.

    Rows of ``left`` are dealt over ``salts`` tasks a key, so ``right``, which has one
    row a key, is repeated as often. ``by`` deals the rows of one key evenly.
    """
    left = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def counted_join(left: DataFrame, right: DataFrame, keys: list[str], by: Column, total: int, share: int = 1000) -> DataFrame:
    """Inner join where one key may hold a third of ``left``, salted for such keys only.

    ``right`` is a written table with one row a key and ``_rows``, the number of rows of
    ``left`` that hold the key; ``total`` is the number of rows of ``left``. A key with more
    than one in ``share`` of them, of which there are fewer than ``share``, is dealt over as
    many tasks as that share goes into it. Its rows learn of it by broadcast; ``right`` is
    repeated for these keys alone. ``by`` deals the rows of one key evenly.
    """
    part = max(1, total // share)
    salts = F.ceil(F.col("_rows") / part).cast("int")
    hot = right.filter(F.col("_rows") > part).select(*keys, salts.alias("_salts"))
    dealt = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("_salts"))).cast("int")
    left = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", dealt).drop("_salts")
    last = F.when(F.col("_rows") > part, salts - 1).otherwise(0)
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_rows")
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def hot_join(left: DataFrame, right: DataFrame, key: str, hot: int = 1000) -> DataFrame:
    """Left join with ``right``, which has one row a key, where one key may hold much of ``left``.

    Keys with more than one in ``hot`` rows of ``left``, of which there are fewer than
    ``hot``, meet their rows by broadcast; the others are shuffled by key.
    """
    counts = materialise(left.groupBy(key).agg(F.count("*").alias("_n")), "key-counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    busy = F.broadcast(counts.filter(F.col("_n") * hot > total).select(key))
    many = left.join(busy, key, "left_semi").join(F.broadcast(right.join(busy, key, "left_semi")), key, "left")
    return many.unionByName(left.join(busy, key, "left_anti").join(right, key, "left"))


def named(columns: list[str]) -> list[Column]:
    """Columns by their exact names, dots included."""
    return [F.col(f"`{c}`") for c in columns]


def carries_columns(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For functions of ``docs`` that give all its columns back: other columns than those of
    ``documents`` travel under numbered names, so none can clash with one used inside."""

    @wraps(stage)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        if set(docs.columns) <= DOCUMENT:
            return stage(docs, *args, **kwargs)
        inside = [c if c in DOCUMENT else f"other {i}" for i, c in enumerate(docs.columns)]
        out = stage(docs.toDF(*inside), *args, **kwargs)
        back = dict(zip(inside, docs.columns))
        return out.toDF(*[back.get(c, c) for c in out.columns])

    return run


def without_lines(table: DataFrame, gone: str, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with the lines whose numbers are in ``gone`` cut from text.

    Null: nothing goes. ``n_chars``, where there is one, follows a text that changed.
    """
    lines = F.split("text", "\n", -1)
    rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    table = table.withColumn("__lines", F.when(F.col(gone).isNotNull(), lines))
    stays = F.array_join(F.transform(rest, lambda i: F.get(F.col("__lines"), i)), "\n")
    table = table.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(stays))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        table = table.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return table.select(*named(docs.columns))


def ship(module: str) -> None:
    """Send a module's functions to workers by value: they needn't have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
