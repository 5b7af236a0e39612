"""Player similarity: per-90 rates, standard scores, principal components, cosine neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchweave.functions.columns import names_without, numeric_columns, ratio

#: Columns with these in their names are not divided.
NOT_RATES = ["90s", "%", "Pct"]


def per_90(df: DataFrame, minutes: str, keep: list[str]) -> DataFrame:
    """Divide every numeric column by ``minutes`` (in nineties), all in one projection.

    ``keep`` and columns with 90s, % or Pct in their names stay as they are.
    Null, NaN and infinite results become 0.
    """
    rates = set(names_without(numeric_columns(df, keep), NOT_RATES))
    quoted = lambda c: F.col(f"`{c}`")
    return df.select(*[ratio(quoted(c), quoted(minutes)).alias(c) if c in rates and c != minutes else quoted(c) for c in df.columns])


def chosen_players(df: DataFrame, position: str, born: int, least_minutes: float | None = None, league: str | None = None, minutes: str = "90s") -> DataFrame:
    """Players of a position born in ``born`` or later; ``least_minutes`` (nineties) and ``league`` filter only if given."""
    kept = df.where(F.col("pos").contains(position) & (F.col("born") >= born))
    if least_minutes is not None:
        kept = kept.where(F.col(f"`{minutes}`") >= least_minutes)
    return kept if league is None else kept.where(F.col("league").cast("string").contains(league))


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace ``columns`` by (x - mean) / population deviation; a constant column becomes 0.

    One row of statistics is computed in one pass and used as literals.
    """
    found = df.agg(*[f(f"`{c}`").alias(f"{n}_{k}") for k, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = {c: (F.col(f"`{c}`") - F.lit(found[f"m_{k}"])) / F.lit(found[f"s_{k}"] or 1.0) for k, c in enumerate(columns)}
    return df.select(*[scaled[c].alias(c) if c in scaled else F.col(f"`{c}`") for c in df.columns])


def assemble(df: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    return df.withColumn(name, F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in columns]))


def fit_pca(df: DataFrame, k: int, name: str = "features"):
    """MLlib PCA model of an array column; the driver sees only a features x k matrix."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    return PCA(k=k, inputCol="_v", outputCol="_p").fit(df.select(array_to_vector(name).alias("_v")))


def project(df: DataFrame, model, name: str = "features", out: str = "components") -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array

    return model.transform(df.withColumn("_v", array_to_vector(name))).withColumn(out, vector_to_array("_p")).drop("_v", "_p")


def explained(df: DataFrame, k: int, name: str = "features") -> list[tuple[int, float, float]]:
    """(component, explained share, running share) of the first ``k`` components."""
    out, total = [], 0.0
    for i, v in enumerate(fit_pca(df, k, name).explainedVariance.toArray().tolist()):
        total += v
        out.append((i + 1, v, total))
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def nearest(df: DataFrame, query_id, k: int = 9, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` rows of least cosine distance to one row, that row left out; ties by id.

    The query is one literal vector, so the table is scanned once and each task
    keeps only its best ``k``.
    """
    from matchweave.operators.joins import exactly_one

    q = F.array(*[F.lit(float(x)) for x in exactly_one(df, F.col(id_col) == query_id, vector)])
    v = F.col(vector)
    distance = 1 - dot(v, q) / (F.sqrt(dot(v, v)) * F.sqrt(dot(q, q)))
    return df.where(F.col(id_col) != query_id).select(id_col, distance.alias("distance")).orderBy("distance", id_col).limit(k)
