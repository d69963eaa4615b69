"""Factor analysis and classification.

Matrices whose size is a parameter (labels, classes, at most MOST terms, axes) are solved on the driver; everything with a row for each unit stays in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.operators.graph import kept
from corpuslab.operators.shared import Scratch, written

#: Columns of a correspondence table whose matrix of products is formed on the driver; beyond it the sparse table is iterated on.
MOST = 400
#: Columns whose cells are a dense table in a task at a time.
COLUMNS = 4096


def gram(counts: DataFrame, row: str, column: str, n: str = "n") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Columns, their masses, and the matrix of inner products of the standardised residuals; rows are summed in Spark."""
    names = [r[0] for r in counts.select(column).distinct().orderBy(column).limit(MOST + 1).collect()]
    if len(names) > MOST:
        raise ValueError(f"more than {MOST} columns: select first")
    total = counts.groupBy(row).agg(F.sum(n).alias("_r"))
    rows = counts.join(total, row)
    x, y = (rows.select(row, F.col(column).alias(c), F.col(n).alias(v), "_r") for c, v in (("a", "x"), ("b", "y")))
    both = x.join(y.drop("_r"), row).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y") / F.col("_r")).alias("s")).collect()
    size = {r[0]: float(r[1]) for r in counts.groupBy(column).agg(F.sum(n)).collect()}
    mass = np.array([size[c] for c in names])
    at = {c: k for k, c in enumerate(names)}
    s = np.zeros((len(names), len(names)))
    for r in both:
        s[at[r["a"]], at[r["b"]]] = r["s"]
    return names, mass, s / np.sqrt(np.outer(mass, mass)) - np.sqrt(np.outer(mass, mass)) / mass.sum()


def row_products(cells: DataFrame, places: dict[object, int]) -> np.ndarray:
    """Inner products of the rows of cells (r, c, a), few rows: each column's cells stand together in one row, and a task adds up its columns' products."""
    k = len(places)
    told = F.broadcast(cells.sparkSession.createDataFrame(list(places.items()), T.StructType([cells.schema["r"], T.StructField("i", T.IntegerType())])))
    packed = cells.join(told, "r").groupBy("c").agg(F.collect_list("i").alias("i"), F.collect_list("a").alias("a")).select("i", "a")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for whole in batches:
            for at in range(0, whole.num_rows, COLUMNS):
                batch = whole.slice(at, COLUMNS)
                table = np.zeros((batch.num_rows, k))
                lengths = np.array(pc.list_value_length(batch.column("i")))
                table[np.repeat(np.arange(batch.num_rows), lengths), batch.column("i").flatten().to_numpy()] = batch.column("a").flatten().to_numpy()
                total += table.T @ table
        x, y = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(total[x, y])], ["x", "y", "s"])

    out = np.zeros((k, k))
    for r in packed.mapInArrow(summed, "x int, y int, s double").groupBy("x", "y").agg(F.sum("s").alias("s")).collect():  # k * k at most
        out[r["x"], r["y"]] = r["s"]
    return out


def narrow_correspondence(scratch: Scratch, cells: DataFrame, by_row: DataFrame, by_column: DataFrame, total: float, axes: int, row: str, column: str) -> tuple[DataFrame, DataFrame, list[float]]:
    """The axes of a table of few rows: the matrix of their products is solved on the driver, one pass over the cells; another one places the columns."""
    mass = {r["r"]: r["rm"] for r in by_row.orderBy("r").collect()}
    places = {r: i for i, r in enumerate(mass)}
    root = np.sqrt(np.array(list(mass.values())) / total)
    values, vectors = np.linalg.eigh(row_products(cells, places) - np.outer(root, root))
    values, vectors = np.maximum(values[::-1][:axes], 0), vectors[:, ::-1][:, :axes]
    labels = [f"axis{k + 1}" for k in range(axes)]
    spark = cells.sparkSession
    kind = T.StructType([cells.schema["r"], *[T.StructField(a, T.DoubleType()) for a in labels]])
    told = F.broadcast(spark.createDataFrame([(r, *map(float, vectors[i])) for r, i in places.items()], kind))
    images = scratch.cut(cells.join(told, "r").groupBy("c").agg(*[F.sum(F.col("a") * F.col(x)).alias(x) for x in labels]).join(by_column, "c"))
    lengths = np.sqrt(values)
    size = lambda k, a: F.abs(F.round(F.col(a) / float(lengths[k] or 1.0), 9))
    largest = images.agg(*[F.max(F.struct(size(k, a).alias("size"), F.col("c"), F.signum(a).alias("sign"))).alias(a) for k, a in enumerate(labels)]).first()
    sign = np.array([largest[a]["sign"] or 1.0 for a in labels])
    columns = images.select(F.col("c").alias(column), *[(F.col(a) * float(sign[k]) / F.sqrt(F.col("cm") / total)).alias(a) for k, a in enumerate(labels)])
    placed = vectors * sign * lengths / root[:, None]
    kind = T.StructType([T.StructField(row, cells.schema["r"].dataType), *kind.fields[1:]])
    rows = spark.createDataFrame([(r, *map(float, placed[i])) for r, i in places.items()], kind)
    columns = written(columns, "column-axes")
    return rows, columns, [float(v) for v in values]


def wide_correspondence(counts: DataFrame, row: str, column: str, axes: int = 2, n: str = "n", more: int = 8, most_rounds: int = 60, tolerance: float = 1e-9, few: int = MOST) -> tuple[DataFrame, DataFrame, list[float]]:
    """What correspondence gives, for any number of rows and columns. Of at most `few` rows the matrix of products is formed; beyond them, subspace iteration on the
    sparse table from a random start (by hash of the column). Cells without a row or column name are left out.

    With a = n / sqrt(row sum * column sum), a round multiplies (axes + more) column vectors by a and by its transpose, two joins and sums, takes the trivial axis away
    and makes them orthonormal. Only products of the vectors among themselves reach the driver. Rounds end when no wanted eigenvalue changes by more than the
    tolerance; most_rounds without that is an error.
    """
    scratch = Scratch(counts.sparkSession, "subspace")
    cells = counts.filter((F.col(n) > 0) & F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(row).alias("r"), F.col(column).alias("c")).agg(F.sum(n).cast("double").alias("n"))
    cells = scratch.cut(cells)
    by_row, by_column = scratch.cut(cells.groupBy("r").agg(F.sum("n").alias("rm"))), scratch.cut(cells.groupBy("c").agg(F.sum("n").alias("cm")))
    size = by_column.agg(F.sum("cm").alias("n"), F.count("*").alias("k")).first()
    height = by_row.count()
    total, q = float(size["n"] or 0), min(axes + more, max(0, min(size["k"], height) - 1))
    axes = min(axes, q)
    names = [f"v{k}" for k in range(q)]
    cells = scratch.cut(cells.join(by_row, "r").join(by_column, "c").select("r", "c", (F.col("n") / F.sqrt(F.col("rm") * F.col("cm"))).alias("a")))

    def products(df: DataFrame, others: list[str]) -> np.ndarray:
        one = df.agg(*[F.sum(F.col(x) * F.col(y)).alias(f"{i}_{j}") for i, x in enumerate(names) for j, y in enumerate(others)]).first()
        return np.array([float(x or 0.0) for x in one]).reshape(len(names), len(others))

    def times(df: DataFrame, m: np.ndarray, made: list[str]) -> DataFrame:
        rest = [c for c in df.columns if c not in names]
        return df.select(*rest, *[sum((F.col(x) * float(v) for x, v in zip(names, m[:, j], strict=True)), F.lit(0.0)).alias(a) for j, a in enumerate(made)])

    def straight(df: DataFrame) -> DataFrame:
        """Without the trivial axis, orthonormal; twice, as once leaves rounding errors."""
        for _ in range(2):
            along = products(df.withColumn("t", F.sqrt(F.col("cm") / total)), ["t"])
            df = df.select("c", "cm", *[(F.col(x) - float(along[k, 0]) * F.sqrt(F.col("cm") / total)).alias(x) for k, x in enumerate(names)])
            df = scratch.cut(times(df, np.linalg.inv(np.linalg.cholesky(products(df, names) + 1e-300 * np.eye(q))).T, names))
        return df

    labels = [f"axis{k + 1}" for k in range(axes)]
    if not q:
        scratch.drop()
        return counts.select(row).distinct(), counts.select(column).distinct(), []
    if height <= few:
        found = narrow_correspondence(scratch, cells, by_row, by_column, total, axes, row, column)
        scratch.drop()
        return found
    random = [(F.pmod(F.xxhash64(F.col("c"), F.lit(k)), F.lit(2_000_003)) / 1_000_001.5 - 1).alias(x) for k, x in enumerate(names)]
    vectors = straight(by_column.select("c", "cm", *random))
    before = None
    for _ in range(most_rounds):
        images = scratch.cut(cells.join(vectors.drop("cm"), "c").groupBy("r").agg(*[F.sum(F.col("a") * F.col(x)).alias(x) for x in names]))
        values, turn = np.linalg.eigh(products(images, names))
        values, turn = values[::-1], turn[:, ::-1]
        if before is not None and np.abs(values[:axes] - before).max() <= tolerance:
            break
        before = values[:axes]
        back = cells.join(images, "r").groupBy("c").agg(*[F.sum(F.col("a") * F.col(x)).alias(x) for x in names])
        vectors = straight(scratch.cut(back.join(by_column, "c").select("c", "cm", *names)))
    else:
        raise RuntimeError(f"eigenvalues still change after {most_rounds} rounds")
    turn = turn[:, :axes]
    columns = scratch.cut(times(vectors, turn, labels))
    largest = columns.agg(*[F.max(F.struct(F.abs(F.round(a, 9)).alias("size"), F.col("c"), F.signum(a).alias("sign"))).alias(a) for a in labels]).first()
    sign = np.array([largest[a]["sign"] or 1.0 for a in labels])
    lengths = np.sqrt(np.maximum(values[:axes], 0))
    columns = columns.select(F.col("c").alias(column), *[(F.col(a) * float(sign[k] * lengths[k]) / F.sqrt(F.col("cm") / total)).alias(a) for k, a in enumerate(labels)])
    rows = times(images.join(by_row, "r"), turn * sign, labels).select(F.col("r").alias(row), *[(F.col(a) / F.sqrt(F.col("rm") / total)).alias(a) for a in labels])
    rows, columns = written(rows, "row-axes"), written(columns, "column-axes")
    scratch.drop()
    return rows, columns, [float(max(v, 0.0)) for v in values[:axes]]


def modalities(docs: DataFrame, variables: list[str], only_variables: list[str] | None = None, only_modalities: list[str] | None = None) -> DataFrame:
    """docs with variable and modality (variable_value, blanks and stars around taken off, lower case): a row for each variable that has a value.

    Selections are compared in the same form; an empty one selects all.
    """
    plain = lambda x: x.strip().lstrip("*").strip().lower()
    entries = F.array(*[F.struct(F.lit(plain(v)).alias("variable"), F.lower(F.trim(F.col(v).cast("string"))).alias("value")) for v in variables])
    rows = docs.withColumn("_e", F.explode(entries)).filter(F.coalesce(F.col("_e.value"), F.lit("")) != "")
    rows = rows.withColumns({"variable": F.col("_e.variable"), "modality": F.concat_ws("_", "_e.variable", F.regexp_replace("_e.value", r"\s+", "_"))}).drop("_e")
    if only_variables:
        rows = rows.filter(F.col("variable").isin([plain(v) for v in only_variables]))
    return rows.filter(F.col("modality").isin([plain(m) for m in only_modalities])) if only_modalities else rows


def correspondence(counts: DataFrame, row: str, column: str, axes: int = 2, n: str = "n") -> tuple[DataFrame, DataFrame, list[float]]:
    """Row coordinates (row, axis1..), column coordinates (column, axis1..), eigenvalues; principal coordinates, the largest loading of an axis positive."""
    if counts.select(column).distinct().limit(MOST + 1).count() > MOST:
        return wide_correspondence(counts, row, column, axes, n)
    names, mass, s = gram(counts, row, column, n)
    values, vectors = np.linalg.eigh(s)
    order = np.argsort(values)[::-1][: min(axes, len(names))]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1, 1)
    scale = np.sqrt(mass / mass.sum())[:, None]
    spark = counts.sparkSession
    labels = [f"axis{k + 1}" for k in range(len(order))]
    principal = vectors / scale * np.sqrt(values)
    columns = spark.createDataFrame([(c, *map(float, p)) for c, p in zip(names, principal, strict=True)], [column, *labels])
    weight = spark.createDataFrame([(c, *map(float, p)) for c, p in zip(names, vectors / scale, strict=True)], ["_c", *labels])
    profile = counts.join(F.broadcast(weight), counts[column] == weight["_c"])  # at most MOST rows
    rows = profile.groupBy(row).agg(*[(F.sum(F.col(n) * F.col(a)) / F.sum(n)).alias(a) for a in labels])
    return rows, columns, [float(v) for v in values]


def supplementary(counts: DataFrame, column: str, row: str, rows: DataFrame, values: list[float], n: str = "n") -> DataFrame:
    """Coordinates of further columns: the mean of their rows' coordinates, over the square root of each axis's eigenvalue."""
    axes = [c for c in rows.columns if c.startswith("axis")]
    both = counts.join(rows, row)
    return both.groupBy(column).agg(*[(F.sum(F.col(n) * F.col(a)) / F.sum(n) / (np.sqrt(v) or 1.0)).alias(a) for a, v in zip(axes, values, strict=True)])


def pca(df: DataFrame, array_col: str, key: str, k: int = 2) -> tuple[DataFrame, list[float]]:
    """key, pc (array) of standardised columns, and the explained shares."""
    rows = df.select(key, array_to_vector(F.col(array_col).cast("array<double>")).alias("v"))
    scaled = StandardScaler(inputCol="v", outputCol="s", withMean=True, withStd=True).fit(rows).transform(rows)
    model = PCA(k=k, inputCol="s", outputCol="p").fit(scaled)
    return model.transform(scaled).select(key, vector_to_array("p").alias("pc")), [float(x) for x in model.explainedVariance]


def kmeans(points: DataFrame, array_col: str, key: str, ks: range = range(2, 7), seed: int = 1) -> tuple[DataFrame, int]:
    """key, cluster for the k with the best silhouette; no row for fewer than 3 points."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    rows = kept(points.select(key, array_to_vector(F.col(array_col)).alias("features")))
    if rows.limit(3).count() < 3:
        return rows.select(key, F.lit(None).cast("int").alias("cluster")).limit(0), 0
    best = max(((ClusteringEvaluator().evaluate((m := KMeans(k=k, seed=seed).fit(rows)).transform(rows)), -k, m) for k in ks), key=lambda x: x[:2])
    return best[2].transform(rows).select(key, F.col("prediction").alias("cluster")), -best[1]
