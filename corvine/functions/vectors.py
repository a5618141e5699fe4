"""Column functions over vectors (array<float> or array<double>) and scores; sums are in double precision."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector at length one (double); a zero vector stays zero."""
    size = norm(a)
    return F.transform(a, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(F.lit(0.0)))


def similarity_of_distance(distance: Column, metric: str = "cosine") -> Column:
    """cosine: 1 - d within 0 and 1; ip and l2: 1 / (1 + d) with d of 0 at least."""
    if metric == "cosine":
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance))
    return 1 / (1 + F.greatest(F.lit(0.0), distance))


def squash(score: Column, scale: float = 10.0) -> Column:
    """A positive relevance score as a number from 0.5 to 1: the logistic function of score / scale."""
    return 1 / (1 + F.exp(-score / scale))
