"""Training losses and schedules, as aggregations over given outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import mean, paired
from .focal import bilinear, sobel
from .metrics import log_l1, mse

#: The weights of the terms of the image translation objective.
WEIGHTS = {"gan": 1.0, "recon_x": 10.0, "recon_kl": 0.01, "recon_x_cyc": 10.0, "recon_kl_cyc": 0.01, "vgg": 0.0}


def with_gradients(pairs: DataFrame, height: int, width: int) -> DataFrame:
    """pairs (t, p) with tx, ty, px, py, worked out once for all losses that take them."""
    (tx, ty), (px, py) = sobel(F.col("t"), height, width), sobel(F.col("p"), height, width)
    return pairs.select("*", tx.alias("tx"), ty.alias("ty"), px.alias("px"), py.alias("py"))


def normal_loss() -> Column:
    """Mean of |1 - cosine| between the normals (-gx, -gy, 1) of two surfaces, from with_gradients()."""

    def miss(s: Column) -> Column:
        dot = s["tx"] * s["px"] + s["ty"] * s["py"] + 1.0
        return F.abs(1.0 - dot / (F.sqrt(s["tx"] * s["tx"] + s["ty"] * s["ty"] + 1.0) * F.sqrt(s["px"] * s["px"] + s["py"] * s["py"] + 1.0)))

    return mean(F.transform(F.arrays_zip("tx", "ty", "px", "py"), miss))


def gradient_losses() -> tuple[Column, Column]:
    return log_l1(F.col("tx"), F.col("px")), log_l1(F.col("ty"), F.col("py"))


def multiscale(t: Column, p: Column, height: int, width: int) -> Column:
    """Squared error at full size, plus twice that at half and three times that at a quarter of it, bilinear."""
    out = mse(t, p)
    for k, by in ((2, 2), (3, 4)):
        out += k * mse(*(bilinear(v, height, width, height // by, width // by) for v in (t, p)))
    return out


def l1(t: Column, p: Column) -> Column:
    return mean(paired(t, p, lambda x, y: F.abs(x - y)))


def square(v: Column) -> Column:
    """The mean square: the divergence term of a code of unit variance."""
    return mean(F.transform(v, lambda x: x * x))


def least_squares_gan(v: Column, real: float) -> Column:
    return mean(F.transform(v, lambda x: (x - real) * (x - real)))


def cross_entropy_gan(v: Column, real: float) -> Column:
    """Binary cross entropy of the logistic of the outputs."""
    return mean(F.transform(v, lambda x: F.greatest(x, F.lit(0.0)) - x * real + F.ln(1 + F.exp(-F.abs(x)))))


def translation_total(t: Column, p: Column, code: Column) -> Column:
    """The weighted sum for one direction: adversarial, reconstruction, code, cycle and cycle code terms."""
    return WEIGHTS["gan"] * least_squares_gan(p, 1.0) + WEIGHTS["recon_x"] * l1(t, p) + WEIGHTS["recon_kl"] * square(code) + WEIGHTS["recon_x_cyc"] * l1(p, t) + WEIGHTS["recon_kl_cyc"] * square(p)


def instance_normed(v: Column) -> Column:
    """A channel less its mean, over its deviation."""

    def of(m: Column) -> Column:
        spread = F.sqrt(mean(F.transform(v, lambda x: (x - m) * (x - m))) + 1e-5)
        return F.element_at(F.transform(F.array(spread), lambda s: F.transform(v, lambda x: (x - m) / s)), 1)

    return F.element_at(F.transform(F.array(mean(v)), of), 1)


def translation_terms(
    x: Column, judged: Column, recon: Column, code: Column, cycle: Column, cycle_code: Column, seen: Column, target: Column
) -> dict[str, Column]:
    """The six terms of a direction, without weights: of the discriminator's outputs for the translated image, of the
    image and its code rebuilt at once and over the cycle, and of the features seen and aimed at."""
    features = paired(instance_normed(seen), instance_normed(target), lambda a, b: (a - b) * (a - b))
    return {
        "gan": least_squares_gan(judged, 1.0), "recon_x": l1(recon, x), "recon_kl": square(code),
        "recon_x_cyc": l1(cycle, x), "recon_kl_cyc": square(cycle_code), "vgg": mean(features),
    }


def weighted_total(directions: list[dict[str, Column]], weights: dict[str, float] = WEIGHTS) -> Column:
    """The objective: all terms of all directions by their weights; terms of weight 0 are not worked out."""
    out = F.lit(0.0)
    for terms in directions:
        for name, term in terms.items():
            if weights[name]:
                out = out + weights[name] * term
    return out


def rate_by_epoch(rate: float, epoch: Column, every: int = 5, factor: float = 0.9) -> Column:
    return rate * F.pow(F.lit(factor), F.floor(epoch / every))


def rate_by_step(rate: float, step: Column, size: int, gamma: float) -> Column:
    return rate * F.pow(F.lit(gamma), F.floor(step / size))
