"""Relational building blocks: latest rows, pages, fixed pivots, checks, fills and set comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last by ``order`` (columns, descending, nulls first in rank).

    An aggregation, no sort: rows are reduced before they are shuffled, so a key with very many revisions costs one row
    per task.
    """
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order and dict(df.dtypes)[c] != "map"])).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in an order that leaves no ties, with their ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def keyset_page(df: DataFrame, order: list[tuple[str, bool]], size: int, after: tuple | None = None) -> DataFrame:
    """One row more than a page of ``size`` in an order of (column, descending); ``after`` is the last row's key seen.

    The extra row tells that there is another page. The cut-off is a filter, so it reaches the scan.
    """
    if after is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for (name, down), value in zip(order, after, strict=True):
            c = F.col(name)
            beyond = beyond | (equal & ((c < F.lit(value)) if down else (c > F.lit(value))))
            equal = equal & (c == F.lit(value))
        df = df.filter(beyond)
    return df.orderBy(*[F.desc(c) if down else F.asc(c) for c, down in order]).limit(size + 1)


def fixed_pivot(df: DataFrame, keys: list[str], column: str, values: list[str]) -> DataFrame:
    """Counts of ``column``'s values as columns, zero where there is none, and their ``total``; one aggregation, no collect."""
    counts = [F.count_if(F.col(column) == v).alias(v) for v in values]
    return df.groupBy(*keys).agg(*counts, F.count(F.lit(1)).alias("total"))


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """``key`` and ``rule`` of every row and every rule it breaks; a rule that is null counts as broken. One pass."""
    broken = F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    return df.select(key, F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("rule"))


def missing_references(df: DataFrame, column: str, owners: DataFrame, owner: str) -> DataFrame:
    """Distinct values of ``column`` that no owner has; nulls aren't references."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().join(owners.select(F.col(owner).alias(column)), column, "left_anti")


def null_or_exists(df: DataFrame, column: str, owners: DataFrame, owner: str) -> DataFrame:
    """Rows whose ``column`` is null or owned: two cheap branches instead of a join condition with OR."""
    return df.filter(F.col(column).isNull()).unionByName(df.join(owners.select(F.col(owner).alias(column)), column, "left_semi").select(*df.columns))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count ``n``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def contiguous(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Per key whether its positions are 0 to n - 1 without gap or repeat."""
    by = df.groupBy(*keys).agg(F.min(position).alias("lo"), F.max(position).alias("hi"), F.count(F.lit(1)).alias("n"), F.count_distinct(position).alias("d"))
    return by.select(*keys, "n", ((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("d") == F.col("n"))).alias("contiguous"))


def broken_chains(df: DataFrame, keys: list[str], order: str, own: str, previous: str) -> DataFrame:
    """Rows whose ``previous`` isn't the ``own`` of the row before them in their key (null for the first)."""
    before = F.lag(own).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("expected", before).filter(~F.col(previous).eqNullSafe(F.col("expected")))


def chunked(df: DataFrame, order: str, size: int, value: str) -> DataFrame:
    """Values in chunks of ``size`` by a position column that counts from 0."""
    return df.groupBy(F.floor(F.col(order) / size).alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias("values"))


def fill_in_phases(phases: list[DataFrame], order: list[Column], size: int) -> DataFrame:
    """Rows of the first phase in order, then of the next ones, until ``size`` are found; with their ``phase``."""
    rows = None
    for k, df in enumerate(phases):
        part = df.orderBy(*order).limit(size).withColumn("phase", F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
    return rows.orderBy("phase", *order).limit(size)


def set_difference(left: Column, right: Column) -> Column:
    """What only one of two arrays holds: a struct of ``missing`` (only left) and ``unknown`` (only right), sorted."""
    return F.struct(F.array_sort(F.array_except(left, right)).alias("missing"), F.array_sort(F.array_except(right, left)).alias("unknown"))


def content_dedup(df: DataFrame, content: str, digest: str = "digest") -> DataFrame:
    """One row per content: its digest, size and number of copies."""
    return df.withColumn(digest, F.concat(F.lit("sha256:"), F.sha2(content, 256))).groupBy(digest).agg(F.max(F.octet_length(content)).alias("bytes"), F.count(F.lit(1)).alias("copies"))


def append_new(history: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key the history doesn't have, each key once: what an insert-only sink may append."""
    return rows.dropDuplicates(keys).join(history.select(*keys), keys, "left_anti")


def encode_cursor(fields: Column) -> Column:
    """A struct as URL-safe base64 of its JSON, without padding."""
    return F.rtrim(F.translate(F.base64(F.encode(F.to_json(fields), "UTF-8")), "+/=", "-_ "))


def decode_cursor(cursor: Column, schema: str) -> Column:
    """The struct of a cursor; null if it isn't one."""
    pad = F.rpad(F.translate(cursor, "-_", "+/"), (F.ceil(F.length(cursor) / 4) * 4).cast("int"), F.lit("="))
    return F.from_json(F.decode(F.try_to_binary(pad, F.lit("base64")), "UTF-8"), schema)


def keyword_score(text: Column, points: dict[str, int]) -> Column:
    """The sum of the points of all words that occur in a text, whatever its case; 0 for null."""
    low = F.coalesce(F.lower(text), F.lit(""))
    return sum((F.when(low.contains(word), n).otherwise(0) for word, n in points.items()), F.lit(0))


def route(df: DataFrame, rules: DataFrame, keys: list[str], otherwise: dict[str, str]) -> DataFrame:
    """Rows with what a small rule table says for their keys (equal with nulls), or ``otherwise`` where no rule holds."""
    names = [c for c in rules.columns if c not in keys]
    told = F.broadcast(rules.select(*[F.col(k).alias(f"_{k}") for k in keys], *names))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    out = df.join(told, on, "left").drop(*[f"_{k}" for k in keys])
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(v)) for n, v in otherwise.items()})
