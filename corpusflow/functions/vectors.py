"""Vector columns: pooling of model output, casting and validation."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _depth(kind: T.DataType) -> int:
    depth = 0
    while isinstance(kind, T.ArrayType):
        depth, kind = depth + 1, kind.elementType
    return depth


def pool_first(df: DataFrame, col: str, out_col: str = "embedding") -> DataFrame:
    """Unwrap nested model output: the first vector of the first item, or null if none."""
    depth = _depth(df.schema[col].dataType)
    if depth == 3:
        vector = F.get(F.get(F.col(col), F.lit(0)), F.lit(0))
    elif depth == 2:
        first = F.get(F.col(col), F.lit(0))
        vector = F.when(F.size(first) > 0, first)
    elif depth == 1:
        vector = F.when(F.size(col) > 0, F.col(col))
    else:
        raise ValueError(f"{col} must be an array nested one to three deep")
    return df.withColumn(out_col, vector)


def as_float32(vector: Column) -> Column:
    return vector.cast(T.ArrayType(T.FloatType()))


def validate_vectors(df: DataFrame, dim: int, col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Split into (rows with a float32 vector of `dim` finite components, rejected rows)."""
    cast = df.withColumn(col, as_float32(F.col(col)))
    unusable = F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    reason = (
        F.when(F.col(col).isNull(), F.lit("missing vector"))
        .when(F.size(col) != dim, F.concat(F.lit("dimension "), F.size(col).cast("string")))
        .when(unusable, F.lit("component not finite"))
    )
    checked = cast.withColumn("reason", reason)
    return checked.filter("reason is null").drop("reason"), checked.filter("reason is not null")
