"""Objective terms, and the loops that lower them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.mesh import applied


def smallness(model: DataFrame, reference: DataFrame | None = None, weight: float = 1.0) -> DataFrame:
    """One row phi: weighted sum of squares of a model (cell_id, value) from its reference; cells without one are 0."""
    if reference is None:
        return model.agg((F.sum(F.col("value") * F.col("value")) * weight).alias("phi"))
    d = F.col("value") - F.coalesce("_r", F.lit(0.0))
    return model.join(reference.select("cell_id", F.col("value").alias("_r")), "cell_id", "left").agg((F.sum(d * d) * weight).alias("phi"))


def smoothness(model: DataFrame, faces: DataFrame, size: float, weights: dict[str, float]) -> DataFrame:
    """(axis, phi): weighted sums of squared differences of neighbours over the cell size, by axis."""
    a = model.select(F.col("cell_id").alias("a"), F.col("value").alias("_va"))
    b = model.select(F.col("cell_id").alias("b"), F.col("value").alias("_vb"))
    g = (F.col("_vb") - F.col("_va")) / size
    w = F.coalesce(*[F.when(F.col("axis") == k, F.lit(float(v))) for k, v in weights.items()], F.lit(0.0))
    return faces.join(a, "a").join(b, "b").groupBy("axis").agg((F.sum(g * g) * F.first(w)).alias("phi"))


def sparse_norm(value: Column, p: float, eps: float) -> Column:
    """A term of the approximated Lp norm: v^2 / (v^2 + eps^2)^(1 - p/2)."""
    return value * value / F.pow(value * value + eps * eps, 1.0 - p / 2.0)


def sparse_weight(value: Column, p: float, eps: float) -> Column:
    """Weight of a squared term in iteratively reweighted least squares."""
    return F.pow(value * value + eps * eps, p / 2.0 - 1.0)


def rotated_smoothness(operator: DataFrame, model: DataFrame) -> DataFrame:
    """One row phi: sum of squares of a rotated gradient of the model."""
    return applied(operator, model).agg(F.sum(F.col("value") * F.col("value")).alias("phi"))


def cross_gradient(first: DataFrame, second: DataFrame, scale: float = 1.0) -> DataFrame:
    """One row phi: sum of squares of the cross product of two gradients (cell_id, gx, gy, gz) times a scale."""
    b = second.select("cell_id", *[F.col(f"g{t}").alias(f"_h{t}") for t in "xyz"])
    c = F.col
    x = c("gy") * c("_hz") - c("gz") * c("_hy")
    y = c("gz") * c("_hx") - c("gx") * c("_hz")
    z = c("gx") * c("_hy") - c("gy") * c("_hx")
    return first.join(b, "cell_id").agg((F.sum(x * x + y * y + z * z) * scale).alias("phi"))


def cell_gradients(model: DataFrame, faces: DataFrame, size: float) -> DataFrame:
    """(cell_id, gx, gy, gz): differences to the following neighbour over the cell size, 0 at the far end."""
    a = model.select(F.col("cell_id").alias("a"), F.col("value").alias("_va"))
    b = model.select(F.col("cell_id").alias("b"), F.col("value").alias("_vb"))
    g = (F.col("_vb") - F.col("_va")) / size
    per_axis = faces.join(a, "a").join(b, "b").groupBy("a").agg(*[F.sum(F.when(F.col("axis") == x, g)).alias(f"g{t}") for x, t in zip("ijk", "xyz", strict=True)])
    return model.select("cell_id").join(per_axis.withColumnRenamed("a", "cell_id"), "cell_id", "left").na.fill(0.0, ["gx", "gy", "gz"])


def gaussian_class(points: DataFrame, classes: DataFrame, columns: list[str]) -> DataFrame:
    """(cell_id, label): the class of the highest weighted density under Gaussians of diagonal covariance; classes (few)
    have label, weight, mean_<column> and var_<column>; ties go to the smaller label."""
    c = F.col
    density = F.log(c("weight"))
    for k in columns:
        density = density - (F.log(c(f"var_{k}")) + (c(k) - c(f"mean_{k}")) ** 2 / c(f"var_{k}")) * 0.5
    scored = points.crossJoin(F.broadcast(classes)).select("cell_id", "label", density.alias("_p"))
    return scored.groupBy("cell_id").agg((-F.max_by(-c("label"), F.struct("_p", -c("label")))).alias("label"))


def conjugate_gradients(kernel: DataFrame, data: DataFrame, beta: float, steps: int = 10, lower: float | None = None, upper: float | None = None, every: int = 3) -> tuple[DataFrame, list[float]]:
    """A model (cell_id, value) that lowers |G m - d|^2 + beta |m|^2 by conjugate gradients on the normal equations, and
    the squared residual after each step.  G is (id, cell_id, g), d is (id, value).

    Each product is a join and a map-side sum on the cells' or stations' ids; only two numbers a step come to the driver,
    and vectors are cut by checkpoints every few steps.  Bounds clip the result.
    """
    from lodestrata.plans.checkpoints import cut

    forward = lambda m: kernel.join(m, "cell_id").groupBy("id").agg(F.sum(F.col("g") * F.col("value")).alias("value"))
    back = lambda r: kernel.join(r, "id").groupBy("cell_id").agg(F.sum(F.col("g") * F.col("value")).alias("value"))
    normal = lambda v: back(forward(v)).alias("s").join(v.alias("v"), "cell_id").select("cell_id", (F.col("s.value") + F.col("v.value") * beta).alias("value"))
    square = lambda v: v.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0
    plus = lambda a, b, k: a.alias("a").join(b.alias("b"), "cell_id").select("cell_id", (F.col("a.value") + F.col("b.value") * k).alias("value"))
    residual = cut(back(data.select("id", "value")))
    model, search = residual.select("cell_id", F.lit(0.0).alias("value")), residual
    now, history = square(residual), []
    for step in range(steps):
        if now < 1e-24:
            break
        moved = cut(normal(search))
        curve = moved.alias("a").join(search.alias("b"), "cell_id").agg(F.sum(F.col("a.value") * F.col("b.value"))).first()[0]
        alpha = now / curve
        model, residual = plus(model, search, alpha), cut(plus(residual, moved, -alpha))
        then = square(residual)
        search = plus(residual, search, then / now)
        if step % every == every - 1:
            model, search = cut(model), cut(search)
        now = then
        history.append(now)
    if lower is not None or upper is not None:
        value = F.col("value")
        value = F.greatest(value, F.lit(lower)) if lower is not None else value
        value = F.least(value, F.lit(upper)) if upper is not None else value
        model = model.select("cell_id", value.alias("value"))
    return model, history


def initial_beta(kernel: DataFrame, model: DataFrame, ratio: float = 1.0) -> DataFrame:
    """One row beta: ratio times |G m|^2 / |m|^2."""
    g = kernel.join(model, "cell_id").groupBy("id").agg(F.sum(F.col("g") * F.col("value")).alias("_v")).agg(F.sum(F.col("_v") ** 2).alias("_d"))
    return g.crossJoin(model.agg(F.sum(F.col("value") ** 2).alias("_m"))).select((F.try_divide("_d", "_m") * ratio).alias("beta"))


def preconditioner(kernel: DataFrame, beta: float) -> DataFrame:
    """(cell_id, value): the inverse diagonal of the normal equations."""
    return kernel.groupBy("cell_id").agg((F.lit(1.0) / (F.sum(F.col("g") * F.col("g")) + beta)).alias("value"))


def misfit_scales(parts: DataFrame) -> DataFrame:
    """(tile, multiplier): the largest misfit over each tile's, so that all start alike."""
    return parts.crossJoin(F.broadcast(parts.agg(F.max("phi").alias("_most")))).select("tile", F.coalesce(F.try_divide("_most", "phi"), F.lit(1.0)).alias("multiplier"))


