"""Exact quantiles (linear interpolation, as NumPy's default and SQL's
``quantile_cont``) by counting: a radix selection over the order-preserving
bits of the values.

Spark's ``percentile`` keeps a value->count map per group inside one task;
with one group holding a third of 100 TB that map does not fit, and a sort
shuffles and stores every row. Here no row is shuffled or stored:

1. a value becomes a long that sorts as the value does (``order_bits``);
2. a pass counts the rows of every (group, top 16 bits), with the smallest and
   largest value of each such bucket. Counts combine map-side, so a task sends
   at most 65,536 rows per group, however many rows the group has;
3. running sums over that histogram give, for all wanted ranks of all groups
   at once, the bucket that holds the rank. The rank is found if the bucket
   holds one value, or if it is the bucket's first or last rank;
4. the other ranks go on inside their buckets with the next 16 bits: a pass
   counts only the rows of such buckets (a semi-join with a table of one row
   per open rank). After four passes at most a bucket is one value; buckets
   that are counted to hold at most ``LOCAL_ROWS`` rows are numbered at once.

Each pass reads the input once: pass a stored frame where computing it is
dear (model scores). Histograms are checkpointed in the shared folder; only
the number of open ranks goes to the driver.

Nulls are left out; NaN sorts above all; -0.0 is 0.0; a null group key is a
group. Whole numbers, dates and timestamps select exactly too.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits that are left out of the bucket number in each pass.
SHIFTS = (48, 32, 16, 0)
#: Open buckets up to which the counting pass broadcasts their table.
BROADCAST_ROWS = 100_000
#: Rows of an open bucket up to which its rows are numbered instead of counted
#: again; the value found is the same.
LOCAL_ROWS = 1 << 16


def order_bits(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds a long in the order of the values: the bits of a double's magnitude,
    signed; whole numbers as they are; dates and timestamps as their count.
    Steps are columns of their own, so that none is computed twice."""
    kind, v = df.schema[value].dataType, F.col(value)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return df.withColumn(out, v.cast("long"))
    if isinstance(kind, T.DateType):
        return df.withColumn(out, F.unix_date(v).cast("long"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return df.withColumn(out, F.unix_micros(v.cast("timestamp")))
    if not isinstance(kind, (T.DoubleType, T.FloatType)):
        raise TypeError(f"no counting order for {kind.simpleString()}")
    near, a, two = F.col("_near"), F.abs(v.cast("double")), F.lit(2.0)
    df = df.withColumn("_near", F.when(a < float("inf"), F.floor(F.log2(a))))  # may be off by one at powers of two
    df = df.withColumn("_e", F.when(F.pow(two, near) > a, near - 1).when(F.pow(two, near + 1) <= a, near + 1).otherwise(near))
    normal = (F.col("_e") + 1023) * F.lit(1 << 52) + ((a / F.pow(two, F.col("_e")) - 1.0) * float(1 << 52)).cast("long")
    tiny = (a * float(2.0**537) * float(2.0**537)).cast("long")
    df = df.withColumn(out, F.when(a == 0.0, F.lit(0).cast("long")).when(a < float(2.0**-1022), tiny)
                       .when(F.isnan(v), F.lit((1 << 63) - 1)).when(a == float("inf"), F.lit(2047 << 52)).otherwise(normal))
    return df.withColumn(out, F.when((v < 0) & ~F.isnan(v), -F.col(out)).otherwise(F.col(out))).drop("_near", "_e")


def _histogram(rows: DataFrame, keys: Sequence[str], shift: int) -> DataFrame:
    """Buckets of (keys, bits above ``shift``): count, smallest and largest
    value, rows before the bucket and rows in all among those with its keys."""
    h = rows.groupBy(*keys, F.shiftright("_k", shift).alias("_p")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    all_ = Window.partitionBy(*keys)
    before = all_.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return h.withColumns({"_before": F.coalesce(F.sum("_c").over(before), F.lit(0)), "_n": F.sum("_c").over(all_)})


def select_ranks(df: DataFrame, value: str, ranks: Callable[[Column], Column], by: Sequence[str] = ()) -> DataFrame:
    """(group keys renamed ``_g0.._gk``, _rank, _value), one row per wanted rank
    of a non-empty group: ``ranks`` gives, from the group's size, an array of
    structs with a 0-based rank as ``pos`` (other fields come along); ranks
    outside the group are left out."""
    gk = [f"_g{i}" for i in range(len(by))]
    keys = [*gk, "_all"]  # a constant, so that joins and windows have a key
    rows = df.select(*[F.col(c).alias(g) for c, g in zip(by, gk)], F.lit(0).alias("_all"), F.col(value).alias("_v"))
    rows = order_bits(rows.where("_v IS NOT NULL"), "_v", "_k")
    found = active = None
    left = None
    for level, shift in enumerate(SHIFTS):
        if level == 0:
            hit = _histogram(rows, keys, shift).withColumn("_r", F.explode(ranks(F.col("_n"))))
            hit = hit.withColumn("_at", F.col("_r.pos") - F.col("_before"))
        else:
            inside = rows.withColumn("_in", F.shiftright("_k", SHIFTS[level - 1]))
            h = _histogram(inside.join(active, _on(inside, active, keys), "left_semi"), [*keys, "_in"], shift)
            h = h.withColumnsRenamed({c: f"_a{c}" for c in [*keys, "_in"]})
            hit = left.drop("_value", "_c").join(h, _on(left, h, keys)).withColumn("_at", F.col("_at") - F.col("_before"))
        hit = hit.where((F.col("_at") >= 0) & (F.col("_at") < F.col("_c")))
        got = (F.when((F.col("_min") == F.col("_max")) | (F.col("_at") == 0) | F.lit(shift == 0), F.col("_min"))
               .when(F.col("_at") == F.col("_c") - 1, F.col("_max")))
        step = hit.select(*keys, "_r", "_at", F.col("_p").alias("_in"), "_c", got.alias("_value")).checkpoint()
        done = step.where("_value IS NOT NULL").select(*gk, F.col("_r").alias("_rank"), "_value")
        found = done if found is None else found.unionByName(done)
        left = step.where("_value IS NULL")
        open_ranks, most = left.agg(F.count(F.lit(1)), F.max("_c")).first()
        if not open_ranks:
            break
        active = left.select(*[F.col(c).alias(f"_a{c}") for c in [*keys, "_in"]]).distinct()
        if open_ranks <= BROADCAST_ROWS:
            active, left = F.broadcast(active), F.broadcast(left)
        if most <= LOCAL_ROWS:  # every open bucket is counted: small enough to be numbered
            inside = rows.withColumn("_in", F.shiftright("_k", shift))
            inside = inside.join(active, _on(inside, active, keys), "left_semi")
            place = F.row_number().over(Window.partitionBy(*keys, "_in").orderBy("_k")) - 1
            inside = inside.withColumn("_place", place).withColumnsRenamed({c: f"_a{c}" for c in [*keys, "_in"]})
            hit = left.drop("_value", "_c").join(inside, _on(left, inside, keys) & (F.col("_at") == F.col("_place")))
            return found.unionByName(hit.select(*gk, F.col("_r").alias("_rank"), F.col("_v").alias("_value")))
    return found


def _on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.col("_in") == F.col("_a_in")
    for c in keys:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_a{c}"))
    return cond


def rank_values(df: DataFrame, value: str, targets: Callable[[Column], dict[str, tuple[Column, Column, Column]]],
                by: Sequence[str] = (), tiebreak: str | None = None) -> DataFrame:
    """Generic: ``targets(n)`` gives name -> (lo rank, hi rank, weight) columns
    from the group size ``n``; result = v[lo] + weight * (v[hi] - v[lo]),
    one row per non-empty group with one column per name. Equal values have
    equal results in any order, so ``tiebreak`` changes nothing."""
    by = list(by)
    names = list(targets(F.lit(1)))

    def ranks(n: Column) -> Column:
        return F.array(*[F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), t[side].cast("long").alias("pos"), t[2].cast("double").alias("w"))
                         for name, t in targets(n).items() for side in (0, 1)])

    found = select_ranks(df, value, ranks, by)
    gk = [f"_g{i}" for i in range(len(by))]
    end = lambda name, side: F.max(F.when((F.col("_rank.name") == name) & (F.col("_rank.side") == side), F.col("_value")))
    per = found.groupBy(*gk).agg(*[end(nm, side).alias(f"_e{side}{k}") for k, nm in enumerate(names) for side in (0, 1)],
                                 *[F.max(F.when(F.col("_rank.name") == nm, F.col("_rank.w"))).alias(f"_w{k}") for k, nm in enumerate(names)])

    def between(k: int) -> Column:
        lo, hi = F.col(f"_e0{k}"), F.col(f"_e1{k}")
        return F.when(lo == hi, lo.cast("double")).otherwise(lo + F.col(f"_w{k}") * (hi - lo))
    per = per.select(*[F.col(g).alias(c) for g, c in zip(gk, by)], *[between(k).alias(nm) for k, nm in enumerate(names)])
    return per if by else per.where(F.lit(False) if not names else F.coalesce(*[F.col(nm) for nm in names]).isNotNull())


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (),
                    tiebreak: str | None = None) -> DataFrame:
    """One row per group with a column per named probability (linear
    interpolation between the ranks floor/ceil of (n-1)p)."""
    def targets(n: Column):
        out = {}
        for name, p in probs.items():
            h = (n - 1).cast("double") * F.lit(float(p))
            lo = F.floor(h)
            hi = F.ceil(h)
            out[name] = (lo, hi, h - lo)
        return out
    return rank_values(df, value, targets, by, tiebreak)


def quantile_scalars(df: DataFrame, value: str, probs: dict[str, float]) -> dict[str, float]:
    """Global exact quantiles as Python floats (one small row to the driver)."""
    row = exact_quantiles(df, value, probs).first()
    return {k: (row[k] if row is not None else None) for k in probs}


def approx_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (),
                     accuracy: int = 10000) -> DataFrame:
    """The same shape as ``exact_quantiles`` from ``percentile_approx``: a
    bounded-memory sketch per group that merges map-side (rank error about
    n / accuracy). For dashboards where the exact passes are not needed."""
    names = list(probs)
    arr = F.percentile_approx(F.col(value), [float(probs[n]) for n in names], accuracy)
    agg = (df.groupBy(*by) if by else df.groupBy()).agg(arr.alias("_q"))
    return agg.select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
