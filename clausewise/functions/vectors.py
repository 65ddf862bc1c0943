"""Vector expressions: hashed bag-of-words embedding (D2) and similarity.

Two vector forms are used:

* dense  `array<double>` for stores (templates, history, supplied vectors);
* bucket `array<int>`    for a text query: the hashed bucket of every token,
  with repetition.  The dot product of a bucket bag with a dense vector is a
  single linear fold, so a query text never has to be densified.

Embedding rule (our own; the reference's sentence model is not available):
tokens = maximal runs of letters, digits and `_` in the lower-cased text,
bucket(token) = int(first 8 hex digits of md5(token)) mod dim, vector =
bucket counts scaled to unit length (all zeros for a text without tokens).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_DIM = 384
TOKEN_PATTERN = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_PATTERN), 0)


def bucket_of(token: Column, dim: int = DEFAULT_DIM) -> Column:
    h = F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(dim)).cast("int")


def buckets(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """The token bag as bucket ids (array<int>, with repetition)."""
    return F.transform(tokens(text), lambda t: bucket_of(t, dim))


def bag_norm(bag: Column) -> Column:
    """Euclidean norm of the count vector of a bucket bag, in one pass over
    the sorted bag: a run of c equal ids adds 1 + 3 + ... + (2c-1) = c^2."""
    acc = F.aggregate(
        F.array_sort(bag),
        F.struct(F.lit(-1).alias("prev"), F.lit(0).alias("run"), F.lit(0).cast("bigint").alias("ss")),
        lambda a, b: F.when(b == a["prev"], F.struct(
            b.alias("prev"), (a["run"] + 1).alias("run"), (a["ss"] + 2 * a["run"] + 1).alias("ss")))
        .otherwise(F.struct(b.alias("prev"), F.lit(1).alias("run"), (a["ss"] + 1).alias("ss"))),
    )
    return F.sqrt(acc["ss"].cast("double"))


def dense_from_bag(bag: Column, dim: int = DEFAULT_DIM) -> Column:
    """Unit-length dense vector of a bag.  O(dim * tokens): use it for the
    bounded store side only.  The bag and its norm are bound once (`let`)."""
    from clausewise.functions.text import let

    def build(b: Column) -> Column:
        return let(bag_norm(b), lambda n: F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)),
            lambda i: F.when(n > 0, F.size(F.filter(b, lambda x: x == i)).cast("double") / n)
            .otherwise(F.lit(0.0))))
    return let(bag, build)


def embed_text(text: Column, dim: int = DEFAULT_DIM) -> Column:
    return dense_from_bag(buckets(text, dim), dim)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
