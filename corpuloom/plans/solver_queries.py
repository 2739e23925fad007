"""Optima of linear machines. Their twins run Newton steps of their own in SQL: a chain of sums over the rows and 3 x 3 systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuloom.plans import common as P
from corpuloom.plans.registry import query

_ROWS = "r AS MATERIALIZED (SELECT l_quantity / 50 AS a, l_discount * 10 AS b, CASE WHEN l_quantity + l_partkey % 20 > 35 THEN 1 ELSE -1 END AS y, l_quantity / 10 + l_partkey % 7 AS t, {c} / count(*) OVER () AS c FROM lineitem)"


def _rounded(x: str, corner: float) -> tuple[str, str]:
    """Slope and curvature of max(0, x) with a corner rounded over so much."""
    return f"least(greatest({x} / {corner}, 0), 1)", f"CASE WHEN {x} > 0 AND {x} < {corner} THEN 1 / {corner} ELSE 0 END"


def _slopes(loss: str, corner: float) -> tuple[str, str]:
    """First and second derivatives of a loss by the margin z."""
    if loss == "logistic":
        return "-y / (1 + exp(y * z))", "1 / ((1 + exp(y * z)) * (1 + exp(-y * z)))"
    if loss == "squared_hinge":
        return "-2 * y * greatest(0, 1 - y * z)", "CASE WHEN y * z < 1 THEN 2 ELSE 0 END"
    if loss == "squared_epsilon":
        return "2 * sign(z - t) * greatest(0, abs(z - t) - 0.1)", "CASE WHEN abs(z - t) > 0.1 THEN 2 ELSE 0 END"
    slope, curve = _rounded("(1 - y * z)" if loss == "hinge" else "(abs(z - t) - 0.1)", corner)
    return (f"-y * {slope}" if loss == "hinge" else f"sign(z - t) * {slope}"), curve


def _chain(loss: str, steps: list[float], signs: tuple[int, int, int] | None = None, damped: float = 1.0) -> str:
    """Newton steps from zero on 1/2 |w|^2 + c losses, one per entry (its corner); with signs on |w|_1 + c losses, weights of sign 0 held at 0."""
    out = ["s0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2)"]
    x = ("a", "b", "1")
    for k, corner in enumerate(steps):
        d, q = _slopes(loss, corner)
        sums = ", ".join([f"sum(c * d * {x[i]}) AS g{i}" for i in range(3)] + [f"sum(c * q * {x[i]} * {x[j]}) AS h{i}{j}" for i in range(3) for j in range(i, 3)])
        out.append(f"""m{k} AS MATERIALIZED (SELECT any_value(w0) AS w0, any_value(w1) AS w1, any_value(w2) AS w2, {sums}
  FROM (SELECT *, {d} AS d, {q} AS q FROM (SELECT *, w0 * a + w1 * b + w2 AS z FROM r, s{k})))""")
        if signs is None:
            g = [f"w{i} + g{i}" for i in range(3)]
            h = [f"h{i}{j}" + (" + 1" if i == j else "") for i in range(3) for j in range(i, 3)]
        else:
            g = [f"{signs[i]} + g{i}" if signs[i] else "0" for i in range(3)]
            h = [(f"h{i}{j}" if signs[i] and signs[j] else "1" if i == j else "0") for i in range(3) for j in range(i, 3)]
        names = ", ".join([f"{v} AS e{i}" for i, v in enumerate(g)] + [f"{v} AS {n}" for n, v in zip(("p", "q", "r", "s", "t", "u"), h)])  # p q r / q s t / r t u
        det = "(p * (s * u - t * t) - q * (q * u - t * r) + r * (q * t - s * r))"
        step = (
            f"((s * u - t * t) * e0 + (r * t - q * u) * e1 + (q * t - r * s) * e2) / {det}",
            f"((t * r - q * u) * e0 + (p * u - r * r) * e1 + (q * r - p * t) * e2) / {det}",
            f"((q * t - s * r) * e0 + (q * r - p * t) * e1 + (p * s - q * q) * e2) / {det}",
        )
        out.append(f"s{k + 1} AS MATERIALIZED (SELECT {', '.join(f'w{i} - {damped} * {step[i]} AS w{i}' for i in range(3))} FROM (SELECT w0, w1, w2, {names} FROM m{k}))")
    return ",\n".join(out)


def _fold_weights(fold: int, c: float) -> str:
    rows = _ROWS.format(c=c).replace("FROM lineitem)", f"FROM lineitem QUALIFY l_orderkey % 3 <> {fold})")
    return f"""(WITH {rows}, {_chain("squared_hinge", [0] * 14)}
SELECT {fold} AS fold, unnest([0, 1, 2]) AS feature, round(unnest([w0, w1, w2]), 5) AS weight FROM s14)"""


def _weights(loss: str, steps: list[float], c: float, signs: tuple[int, int, int] | None = None) -> str:
    return f"""(WITH {_ROWS.format(c=c)}, {_chain(loss, steps, signs)}
SELECT '{loss}' AS loss, unnest([0, 1, 2]) AS feature, round(unnest([w0, w1, w2]), 5) AS weight FROM s{len(steps)})"""


def _lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    rows = P.table(spark, sf_dir, "lineitem").select(
        F.array(F.lit(0), F.lit(1)).alias("idx"), F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10).alias("val"),
        F.when(F.col("l_quantity") + F.col("l_partkey") % 20 > 35, 1).otherwise(-1).alias("sign"), (F.col("l_quantity") / 10 + F.col("l_partkey") % 7).alias("number"),
    )
    return rows, rows.count()


def _told(spark: SparkSession, found: list[tuple[str, list[float]]]) -> DataFrame:
    """Weights of the fits: loss, feature (the bias comes last), weight."""
    return spark.createDataFrame([(loss, i, float(round(w, 5)) + 0.0) for loss, ws in found for i, w in enumerate(ws)], "loss string, feature int, weight double")


@query(" UNION ALL ".join(_weights(loss, [0] * 14, 1000.0) for loss in ("logistic", "squared_hinge", "squared_epsilon")))
def newton_solvers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trust-region Newton: optima of three losses over the lines."""
    from corpuloom.operators import linear as L

    rows, n = _lines(spark, sf_dir)
    fits = [(loss, L.fit(spark, rows.withColumnRenamed("number" if loss in L.REGRESSION else "sign", "y"), 2, loss, c=1000 / n, solver="newton", tolerance=1e-9, merge=True)) for loss in ("logistic", "squared_hinge", "squared_epsilon")]
    return _told(spark, [(loss, m.weights[0].tolist()) for loss, m in fits])


@query(" UNION ALL ".join(_weights(loss, [0] * 14, 100.0, (1, 0, -1)) for loss in ("logistic", "squared_hinge")))
def sparse_solvers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The L1 penalty: the discount says nothing of the label, so its weight is 0."""
    from corpuloom.operators import sparse_linear as S

    rows, n = _lines(spark, sf_dir)
    fits = [(loss, S.fit(spark, rows.withColumnRenamed("sign", "y"), 2, loss, c=100 / n, tolerance=1e-9)) for loss in ("logistic", "squared_hinge")]
    return _told(spark, [(loss, m.weights[0].tolist()) for loss, m in fits])


@query(" UNION ALL ".join(_fold_weights(k, 1000.0) for k in range(3)))
def cross_fold_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of three folds fitted in the same passes: the vectors by which features are grouped."""
    from corpuloom.operators import crossfeatures as X

    lines = P.table(spark, sf_dir, "lineitem")
    rows = lines.select(
        F.array(F.lit(0), F.lit(1)).alias("idx"), F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10).alias("val"),
        F.when(F.col("l_quantity") + F.col("l_partkey") % 20 > 35, 1).otherwise(-1).alias("y"), (F.col("l_orderkey") % 3).cast("int").alias("fold"),
    )
    w = X.fit(spark, rows, 2, 3, "squared_hinge", c=1000 / lines.count(), tolerance=1e-9).weights
    return spark.createDataFrame([(k, i, float(round(x, 5)) + 0.0) for k in range(3) for i, x in enumerate(w[k].tolist())], "fold int, feature int, weight double")


#: Corners of the twin's damped steps on the losses with one.
_CORNERS = [16 * 0.85**k for k in range(56)]


def _value(loss: str, c: float, name: str, share: str = "1") -> str:
    far = "greatest(0, 1 - y * z)" if loss == "hinge" else "greatest(0, abs(z - t) - 0.1)"
    return f"""(WITH {_ROWS.format(c=c)}, {_chain(loss, _CORNERS, damped=0.7)}
SELECT '{name}' AS loss, round({share} * (any_value(w0 * w0 + w1 * w1 + w2 * w2) / 2 + sum(c * {far})) / 1000, 3) AS value, true AS closed
FROM (SELECT *, w0 * a + w1 * b + w2 AS z FROM r, s{len(_CORNERS)}))"""


@query(" UNION ALL ".join([_value("hinge", 1000.0, "hinge"), _value("epsilon", 1000.0, "epsilon"), _value("hinge", 1000.0, "crammer_singer", "0.5")]))
def dual_machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses with corners solved in the dual: their optimal values, and whether the gap to the dual was closed.

    Of two classes, the loss of Crammer and Singer at C is half the hinge loss's problem at 2 C.
    """
    from corpuloom.operators import dual as D

    rows, n = _lines(spark, sf_dir)
    out = []
    for loss in ("hinge", "epsilon", "crammer_singer"):
        data = rows.withColumnRenamed("number" if loss == "epsilon" else "sign", "y")
        m = D.fit(spark, data, 2, loss, c=(500 if loss == "crammer_singer" else 1000) / n, tolerance=1e-4, merge=True)
        out.append((loss, round(m.fitted.value / 1000, 3), m.fitted.converged))
    return spark.createDataFrame(out, "loss string, value double, closed boolean")


def _fixed_point(steps: int) -> str:
    """Synchronous updates of the unlabelled values; each shrinks what is missing to 0.7 of it at most."""
    out = ["f0 AS MATERIALIZED (SELECT id, CASE WHEN labelled THEN y ELSE prior END AS f FROM st)"]
    for k in range(steps):
        out.append(f"""f{k + 1} AS MATERIALIZED (SELECT st.id, CASE WHEN labelled THEN y WHEN bottom IS NULL THEN prior ELSE 0.7 * top / bottom + 0.3 * prior END AS f FROM st LEFT JOIN (
  SELECT src, sum(CASE WHEN labelled THEN 1.0 ELSE 0.1 END * w * f) AS top, sum(CASE WHEN labelled THEN 1.0 ELSE 0.1 END * w) AS bottom
  FROM ed JOIN f{k} ON f{k}.id = dst JOIN st s ON s.id = dst GROUP BY src) ON src = st.id)""")
    return ",\n".join(out)


@query(f"""WITH e AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS x, (label % 2)::DOUBLE AS y, vec_id % 3 = 0 AS labelled FROM embeddings),
r AS MATERIALIZED (SELECT 4 * x[1] AS a, 4 * x[2] AS b, 2 * y - 1 AS y, 0 AS t, 1.0 AS c FROM e WHERE labelled),
{_chain("logistic", [0] * 12)},
u AS MATERIALIZED (SELECT id, list_transform(x, lambda v: v / sqrt(list_sum(list_transform(x, lambda z: z * z)))) AS v,
  list_transform(x[1:5], lambda v: (abs(v) + 0.01) / list_sum(list_transform(x[1:5], lambda z: abs(z) + 0.01))) AS p FROM e),
pr AS (SELECT id AS src, (id * 7 + j * 13) % (SELECT count(*) FROM e) AS dst FROM e, unnest([1, 2, 3, 4]) AS t(j)),
ed AS MATERIALIZED (SELECT src, dst, exp(list_sum(list_transform(list_zip(m.v, n.v), lambda z: z[1] * z[2]))
    - list_sum(list_transform(list_zip(m.p, n.p), lambda z: (z[1] - z[2]) * ln(z[1] / z[2]))) / 5) AS w
  FROM (SELECT src, dst FROM pr UNION SELECT dst, src FROM pr) JOIN u m ON m.id = src JOIN u n ON n.id = dst WHERE src <> dst),
st AS MATERIALIZED (SELECT id, y, labelled, 1 / (1 + exp(-(4 * w0 * x[1] + 4 * w1 * x[2] + w2))) AS prior FROM e, s12),
{_fixed_point(60)},
sh AS (SELECT avg(y) AS one FROM e WHERE labelled)
SELECT id, round(f, 5) AS f, CASE WHEN abs(f) / (1 - one) <= abs(f - 1) / one THEN 0 ELSE 1 END AS label FROM f60, sh""")
def gaussian_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the vectors labelled, the others' classes from a logistic prior and weighted neighbours, by conjugate gradients."""
    from corpuloom.functions import arrays as A
    from corpuloom.operators import transductive as T

    e = P.table(spark, sf_dir, "embeddings")
    n = e.agg(F.count(F.lit(1)).alias("n"))
    x = F.col("embedding").cast("array<double>")
    documents = e.select(
        F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 3 == 0, (F.col("label") % 2).cast("double")).alias("y"), F.array(F.lit(0), F.lit(1)).alias("idx"),
        F.array(4 * x[0], 4 * x[1]).alias("val"), A.l2_normalized(x).alias("vector"), A.l1_normalized(F.transform(F.slice(x, 1, 5), lambda v: F.abs(v) + 0.01)).alias("topics"),
    )
    j = F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])).alias("j")
    pairs = e.select("vec_id", j).crossJoin(F.broadcast(n)).select(F.col("vec_id").alias("src"), ((F.col("vec_id") * 7 + F.col("j") * 13) % F.col("n")).alias("dst"))
    out = T.learn(spark, documents, pairs, 2, tolerance=1e-7)
    return out.select("id", (F.round("f", 5) + 0.0).alias("f"), F.col("label").cast("int").alias("label"))
