"""Resource estimates for batches of factorization jobs, as expressions over a table of sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Memory sizes in GB that clusters allot.
MEMORY_STEPS = (2, 4, 8, 16, 32, 64, 128)


def thread_decision(size: Column, most: int) -> Column:
    """Threads for an input of that many symbols: one below 1e5, up to 4 below 1e6, up to 8 below 1e7, else all."""
    return F.when(size < 100_000, 1).when(size < 1_000_000, min(4, most)).when(size < 10_000_000, min(8, most)).otherwise(most)


def cluster_memory(gb: Column) -> Column:
    """The least allotted size that holds it; beyond the largest, a multiple of 64 GB."""
    out = F.floor((gb + 63) / 64) * 64
    for step in reversed(MEMORY_STEPS):
        out = F.when(gb <= step, F.lit(step)).otherwise(out)
    return out.cast("int")


def estimate_fallback(df: DataFrame, size: str, *, threads: int = 1, safety: float = 1.5) -> DataFrame:
    """Rule-of-thumb needs from input bytes: 0.5 ms per 1,000 symbols, 30 bytes of memory a symbol, 20 % of disk."""
    symbols = F.floor(F.col(size) * 0.8)
    seconds = symbols / 1000 * 0.0005 / (threads * 0.7)
    memory = symbols * 30 / (1024 * 1024) * (1 + 0.3 * (threads - 1))
    disk = F.col(size) * 0.2 / (1024 * 1024)
    return df.withColumns({"n_symbols": symbols, "seconds": seconds, "safe_seconds": seconds * safety, "memory_mb": memory, "safe_memory_gb": memory / 1024 * safety, "disk_mb": disk, "cluster_memory_gb": cluster_memory(memory / 1024 * safety)})


def predict(size: Column, slope: float, intercept: float, log_scale: bool = True) -> Column:
    return F.pow(F.lit(10.0), slope * F.log10(size) + intercept) if log_scale else slope * size + intercept


def estimate_from_trends(df: DataFrame, size: str, trends: dict[str, dict], *, threads: int = 1, safety: float = 1.5) -> DataFrame:
    """Needs from fitted trends (time in ms, memory and disk in MB); four fifths of the work runs in parallel."""
    out = {}
    if "time" in trends:
        seconds = predict(F.col(size), **trends["time"]) * (0.2 + 0.8 / threads) / 1000
        out |= {"seconds": seconds, "safe_seconds": seconds * safety}
    if "memory" in trends:
        memory = predict(F.col(size), **trends["memory"]) * (1 + 0.3 * (threads - 1))
        out |= {"memory_mb": memory, "safe_memory_gb": memory / 1024 * safety, "cluster_memory_gb": cluster_memory(memory / 1024 * safety)}
    if "disk" in trends:
        disk = predict(F.col(size), **trends["disk"])
        out |= {"disk_mb": disk, "safe_disk_gb": disk / 1024 * safety}
    return df.withColumns(out)


def fit_trend(df: DataFrame, size: str, value: str, *keys: str) -> DataFrame:
    """(keys, slope, intercept, r_squared) of the least-squares line through the logarithms."""
    x, y = F.log10(size), F.log10(value)
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r_squared"))
