"""Schema rules of wide feature tables: modalities by prefix, renames, scaling, imputation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kadenz.operators.ordering import numbered, running

#: Columns that are no features.
OTHER = ("meta_", "y", "sentence", "id")


def modalities(columns: list[str]) -> dict[str, list[str]]:
    """Feature columns by the text before their first underscore."""
    out: dict[str, list[str]] = {}
    for c in columns:
        if not (c.startswith("meta") or c in ("y", "sentence", "id")):
            out.setdefault(c.split("_")[0], []).append(c)
    return out


def packed(df: DataFrame, keys: list[str]) -> DataFrame:
    """One array<double> per modality."""
    return df.select(*keys, *[F.array(*[F.col(c).cast("double") for c in cols]).alias(m) for m, cols in sorted(modalities(df.columns).items())])


def without_text_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drops string columns but the named ones."""
    return df.select(*[n for n, kind in df.dtypes if kind != "string" or n in keep])


def matching(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows that equal every wanted value, each cast to its column's type; names that are no columns are passed over."""
    kinds = dict(df.dtypes)
    return df.where(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v).cast(kinds[k]) for k, v in wanted.items() if k in kinds], F.lit(True)))


def complete(df: DataFrame, key: str, part: str, parts: list) -> DataFrame:
    """Rows of the keys that have all parts."""
    whole = df.where(F.col(part).isin(parts)).groupBy(key).agg(F.count_distinct(part).alias("n")).where(F.col("n") == len(set(parts)))
    return df.join(whole, key, "left_semi")


def preferred(df: DataFrame, key: str, value: str, first: Column) -> DataFrame:
    """(key, value): of each key a row where `first` holds, if there is one, with the smallest value."""
    return df.groupBy(key).agg(F.min_by(value, F.struct((~first).cast("int"), value)).alias(value))


def top_per_group(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in the given order; Spark keeps n per task before the shuffle."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("__r", r).where(F.col("__r") <= n).drop("__r")


def without_null_columns(df: DataFrame) -> DataFrame:
    """Drops columns that hold a null anywhere; one pass counts them all."""
    n = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if not n[c]])


def varying(df: DataFrame, columns: list[str], least: float = 1000 * 1.1920929e-07) -> list[str]:
    """Columns whose deviation exceeds `least`."""
    s = df.agg(*[F.stddev_samp(c).alias(c) for c in columns]).first()
    return [c for c in columns if (s[c] or 0.0) > least]


def z_scored(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column by its own mean and sample deviation + 1e-5."""
    m = df.agg(*[e for c in columns for e in (F.avg(c).alias(f"{c}_m"), F.stddev_samp(c).alias(f"{c}_s"))])
    wide = df.crossJoin(F.broadcast(m))  # one row
    return wide.select(*[((F.col(c) - F.col(f"{c}_m")) / (F.col(f"{c}_s") + 1e-5)).alias(c) if c in columns else F.col(c) for c in df.columns])


def learn(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of the columns that vary: two numbers a column."""
    keep = varying(df, columns)
    if not keep:
        return {}
    m = df.agg(*[e for c in keep for e in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s"))]).first()
    return {c: (m[f"{c}_m"], m[f"{c}_s"]) for c in keep}


def apply(df: DataFrame, learned: dict[str, tuple[float, float]], clip: float = 3.0) -> DataFrame:
    """Scales by learned values and clips; features that were not learned are dropped."""
    z = lambda c: F.greatest(F.least((F.col(c) - learned[c][0]) / learned[c][1], F.lit(clip)), F.lit(-clip))
    features = {c for cols in modalities(df.columns).values() for c in cols}
    return df.select(*[z(c).alias(c) if c in learned else F.col(c) for c in df.columns if c in learned or c not in features])


def revert(value: Column, learned: tuple[float, float]) -> Column:
    return value * learned[1] + learned[0]


def imputed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls become the column's mean over all rows."""
    m = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns])
    wide = df.crossJoin(F.broadcast(m))  # one row
    return wide.select(*[F.coalesce(c, f"__m_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def codes(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """Adds codes from 0 in sorted order of the distinct values; their numbering is done over the distinct values only."""
    values = numbered(df.select(column).where(F.col(column).isNotNull()).distinct(), [column], name)
    return df.join(values.withColumn(name, (F.col(name) - 1).cast("int")), column, "left")


def with_defaults(df: DataFrame, defaults: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def nested_by_lengths(flat: DataFrame, lengths: DataFrame, key: str, number: str, value: str, n: str = "n") -> DataFrame:
    """(key, list of values): a flat list, numbered from 1, cut into the keys' lengths in the order of the keys."""
    upto = running(lengths, [key], {"__before": n})
    spans = upto.select(key, F.explode(F.sequence(F.col("__before") + 1, F.col("__before") + F.col(n))).alias(number))
    listed = F.array_sort(F.collect_list(F.struct(number, value)))
    return spans.join(flat, number).groupBy(key).agg(F.transform(listed, lambda e: e[value]).alias(value))


def lexicon_shares(df: DataFrame, key: str, words: Column, lexicon: DataFrame, categories: list[str]) -> DataFrame:
    """(key, categories): of a row's words that the lexicon (word, 0/1 categories) has, the share of each category; 0 without any.

    The lexicon is met before anything is grouped, so words outside it never travel. Spark broadcasts it if it is small.
    """
    found = df.select(key, F.explode(words).alias("word")).join(lexicon, "word")
    got = found.groupBy(key).agg(*[F.avg(c).alias(c) for c in categories])
    return df.select(key).join(got, key, "left").fillna(0.0, categories)


def common_ends(df: DataFrame, column: str) -> DataFrame:
    """(prefix, suffix) that all values share, of any length; nulls are left out. One aggregate: the least and the greatest
    value share what all share, forwards and reversed."""
    back = F.reverse(column)
    ends = df.agg(F.min(column).alias("a"), F.max(column).alias("b"), F.min(back).alias("c"), F.max(back).alias("d"))

    def shared(a: str, b: str) -> Column:
        apart = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y))
        n = F.array_position(apart, True)
        return F.substring(F.col(a), F.lit(1), F.when(n > 0, n - 1).otherwise(F.length(a)).cast("int"))

    return ends.select(shared("a", "b").alias("prefix"), F.reverse(shared("c", "d")).alias("suffix"))
