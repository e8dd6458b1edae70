"""Usage windows of model quotas: sessions with a gap, local days, sliding minutes; picking a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP_SECONDS = 60
DAY_ZONE = "America/Los_Angeles"


def session_counts(usage: DataFrame, key: list[str], ts: str, amount: Column, order: str, error: Column | None = None, gap: int = GAP_SECONDS) -> DataFrame:
    """Add session_no (from 1) and used: the running sum in the session.

    An event `gap` seconds or more after the one before it starts a session, at exactly `gap` too.
    An error sets the count to its own amount, and the event after an error starts anew.
    """
    by = Window.partitionBy(*key).orderBy(ts, order)
    prev = F.lag(ts).over(by)
    fresh = prev.isNull() | (F.col(ts) >= prev + F.expr(f"INTERVAL {gap} SECONDS"))
    if error is not None:
        fresh = fresh | error | F.coalesce(F.lag(error).over(by), F.lit(False))
    marked = usage.withColumn("_fresh", fresh.cast("int"))
    numbered = marked.withColumn("session_no", F.sum("_fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*key, "session_no").orderBy(ts, order).rowsBetween(Window.unboundedPreceding, 0)
    return numbered.withColumn("used", F.sum(amount).over(inside)).drop("_fresh")


def local_day(ts: Column, zone: str = DAY_ZONE) -> Column:
    """The day of a UTC timestamp in a zone."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def next_local_midnight(ts: Column, zone: str = DAY_ZONE) -> Column:
    return F.to_utc_timestamp(F.date_trunc("DAY", F.from_utc_timestamp(ts, zone)) + F.expr("INTERVAL 1 DAY"), zone)


def sliding_counts(usage: DataFrame, key: list[str], ts: str, seconds: int, out: str) -> DataFrame:
    """Add the number of events of the last `seconds`, the row's own included and the far end excluded.

    An event counts +1 from its time on, and -1 from the moment it leaves the window: what a row
    sees is the running sum. Time is cut into slices of an hour, each summed on its own on top of
    what the slices before it leave, so few keys still make many groups, and the work is two rows
    an event however dense the events are. Events without time count among themselves.
    """
    width = 3_600_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    enters = F.struct(at.alias("at"), F.lit(1).alias("n"))
    leaves = F.struct((at + seconds * 1_000_000).alias("at"), F.lit(-1).alias("n"))
    moves = F.explode(F.when(at.isNull(), F.array(enters)).otherwise(F.array(enters, leaves)))
    slice_of = (F.col("_m.at") - F.pmod(F.col("_m.at"), F.lit(width))).alias("_slice")
    left = usage.select(*key, moves.alias("_m")).groupBy(*key, slice_of).agg(F.sum("_m.n").alias("_net"))
    earlier = Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    held = left.where("_slice IS NOT NULL").select(*[F.col(k).alias(f"_k_{k}") for k in key], F.col("_slice").alias("_s"), F.coalesce(F.sum("_net").over(earlier), F.lit(0)).alias("_held"))
    upto = Window.partitionBy(*key, "_slice").orderBy("_m.at").rangeBetween(Window.unboundedPreceding, 0)
    seen = usage.select("*", moves.alias("_m")).select("*", slice_of).withColumn("_in", F.sum("_m.n").over(upto)).where("_m.n = 1")
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key]
    met = seen.join(held, [*same, F.col("_slice") == F.col("_s")], "left")
    return met.select(*usage.columns, (F.col("_in") + F.coalesce("_held", F.lit(0))).alias(out))


def exhausted(used: Column, limit: Column, reset_at: Column, now: Column) -> Column:
    return (reset_at > now) & (used >= limit)


def pick_model(models: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    """The model of first priority none of whose windows is exhausted, for each project."""
    spent = state.where(exhausted(F.col("used"), F.col("limit"), F.col("reset_at"), now)).select("project_id", "model_name").distinct()
    return models.join(spent, ["project_id", "model_name"], "left_anti").groupBy("project_id").agg(F.min_by("model_name", "priority").alias("model_name"))


def reset_seconds(value: Column) -> Column:
    """Seconds of '12', '1.5', '250ms', '3s', '2m' or '1h'; else null. Large numbers are relative as well."""
    v = F.lower(F.trim(value))
    number = F.when(F.rlike(v, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$")), F.greatest(F.lit(0.0), v.try_cast("double")))
    amount = F.nullif(F.regexp_extract(v, r"^(\d+)(ms|s|m|h)$", 1), F.lit("")).cast("double")
    unit = F.regexp_extract(v, r"^(\d+)(ms|s|m|h)$", 2)
    scale = F.when(unit == "ms", 0.001).when(unit == "s", 1.0).when(unit == "m", 60.0).when(unit == "h", 3600.0)
    return F.coalesce(number, amount * scale)


def usage_tokens(payload: Column) -> Column:
    """Total of a usage JSON, else prompt and candidate tokens, else 0."""
    at = lambda path: F.get_json_object(payload, path).try_cast("long")
    parts = F.coalesce(at("$.promptTokenCount"), F.lit(0)) + F.coalesce(at("$.candidatesTokenCount"), F.lit(0))
    return F.greatest(F.lit(0), F.coalesce(at("$.totalTokenCount"), parts))
