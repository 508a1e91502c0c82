"""Language names: exact, alias, then nearest by edit distance without case and accents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: accented Latin letters and what they are without accents, in the same places.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def folded(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def resolve(inputs: DataFrame, names: DataFrame, column: str = "input") -> DataFrame:
    """(input, name): names(ord, name, aliases) is a small dimension, broadcast; one row for each input, null if nothing is near.

    Precedence: a name, an alias, then the least distance among names and aliases longer than three
    letters, if at most a third (rounded down by tenths) of the name and at least one.
    """
    d = names.select("ord", "name", F.explode(F.concat(F.array("name"), "aliases")).alias("alias"))
    x, y = folded(F.col(column)), folded(F.col("alias"))
    far = F.levenshtein(x, y)
    rank = F.when(F.col(column) == F.col("name"), 0).when((F.col(column) == F.col("alias")) | (F.lower(column) == F.col("alias")), 1).when((F.char_length("alias") > 3) & (far <= F.greatest(F.lit(1), F.floor(0.3 * F.char_length("name")))), far + 2)
    met = inputs.select(column).distinct().join(F.broadcast(d), rank.isNotNull(), "left").withColumn("_rank", rank)
    return met.groupBy(column).agg(F.min_by("name", F.when(F.col("_rank").isNotNull(), F.struct("_rank", "ord"))).alias("name"))
