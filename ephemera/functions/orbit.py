"""Broadcast orbit and clock from Keplerian elements, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ephemera.functions.scalars import since_reference

# Fixed values of the GPS interface specification.
GM = 3.986005e14
OMEGA_EARTH = 7.2921151467e-5
RELATIVITY = -4.442807633e-10

ELEMENTS = ("a", "e", "i0", "omega0", "omega", "m0", "toe")
CORRECTIONS = ("delta_n", "omega_dot", "idot", "cuc", "cus", "crc", "crs", "cic", "cis")


def eccentric_anomaly(mean: Column, ecc: Column, steps: int = 12) -> Column:
    """Solution of E - ecc sin E = mean by ``steps`` Newton steps from E = mean.

    Steps are unrolled by a fold over a constant array, which keeps the plan small; extra steps change nothing once
    the equation holds, so no tolerance is needed.
    """
    return F.aggregate(F.array(*(F.lit(k) for k in range(steps))), mean.cast("double"), lambda x, _: x - (x - ecc * F.sin(x) - mean) / (1 - ecc * F.cos(x)))


def _defaults(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in CORRECTIONS})


def with_position(df: DataFrame, ts: str = "timestamp", week_mode: str = "week") -> DataFrame:
    """``df`` with x_broadcast, y_broadcast, z_broadcast (metres, earth-fixed).

    Rows need the columns ELEMENTS; absent or null CORRECTIONS count as 0; rows that lack an element or have a <= 0
    are dropped.
    """
    names = list(df.columns)
    d = _defaults(df.dropna(subset=list(ELEMENTS)).where("a > 0"))
    c = F.col
    d = d.withColumn("__tk", since_reference(c(ts), c("toe"), week_mode))
    d = d.withColumn("__mean", c("m0") + (F.sqrt(F.lit(GM) / F.pow(c("a"), F.lit(3.0))) + c("delta_n")) * c("__tk"))
    d = d.withColumn("__ecc_anom", eccentric_anomaly(c("__mean"), c("e")))
    true_anomaly = F.atan2(F.sqrt(1 - c("e") * c("e")) * F.sin("__ecc_anom"), F.cos("__ecc_anom") - c("e"))
    d = d.withColumn("__phi", true_anomaly + c("omega"))
    d = d.withColumns({"__s2": F.sin(2 * c("__phi")), "__c2": F.cos(2 * c("__phi"))})
    harmonic = lambda s, k: c(s) * c("__s2") + c(k) * c("__c2")
    d = d.withColumns(
        {
            "__u": c("__phi") + harmonic("cus", "cuc"),
            "__r": c("a") * (1 - c("e") * F.cos("__ecc_anom")) + harmonic("crs", "crc"),
            "__i": c("i0") + harmonic("cis", "cic") + c("idot") * c("__tk"),
            "__node": c("omega0") + (c("omega_dot") - OMEGA_EARTH) * c("__tk") - OMEGA_EARTH * c("toe"),
        }
    )
    d = d.withColumns({"__px": c("__r") * F.cos("__u"), "__py": c("__r") * F.sin("__u")})
    return d.select(
        *names,
        (c("__px") * F.cos("__node") - c("__py") * F.cos("__i") * F.sin("__node")).alias("x_broadcast"),
        (c("__px") * F.sin("__node") + c("__py") * F.cos("__i") * F.cos("__node")).alias("y_broadcast"),
        (c("__py") * F.sin("__i")).alias("z_broadcast"),
    )


def with_clock_correction(df: DataFrame, ts: str = "timestamp", week_mode: str = "week") -> DataFrame:
    """``df`` with clock_broadcast (seconds): polynomial from toc, or toe where there is none, and relativity.

    Null coefficients count as 0; without a usable orbit the relativistic part is left out.
    """
    names = list(df.columns)
    c = F.col
    toc = F.coalesce(c("toc"), c("toe")) if "toc" in names else c("toe")
    d = df.withColumn("__dt", since_reference(c(ts), toc, week_mode))
    af = [F.coalesce(c(f"af{k}"), F.lit(0.0)) for k in range(3)]
    mean = F.coalesce(c("m0"), F.lit(0.0)) + F.sqrt(F.lit(GM) / F.pow(c("a"), F.lit(3.0))) * c("__dt")
    d = d.withColumn("__mean", mean)
    d = d.withColumn("__ecc_anom", eccentric_anomaly(c("__mean"), c("e")))
    relativity = F.when(c("a") > 0, RELATIVITY * c("e") * F.sqrt("a") * F.sin("__ecc_anom"))
    total = af[0] + af[1] * c("__dt") + af[2] * c("__dt") * c("__dt") + F.coalesce(relativity, F.lit(0.0))
    return d.select(*names, F.coalesce(total, F.lit(0.0)).alias("clock_broadcast"))
