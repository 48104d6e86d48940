"""Column-level quality profile of loads, with constraints and drift tests.

All declared checks are compiled into one aggregate scan. Its result is a
mergeable state for any slice of rows: how often each value stands in each
column of a load, and how many of these cells violate which kind of check.
States of slices add up. A ``ProfileStore`` keeps the state of each load, so adding a
load reads that load alone; a load that comes in pieces is merged with what was
there. Everything else - nulls, distinct and most common values, ranges,
lengths, violations, drift, control limits - derives from the states.

Defined results: an empty table gives no rows; a load without a predecessor
has no drift; shares are exact fractions of all rows, repeats included; a load
that the stored profile doesn't list isn't misreported. Other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamwork.operators.snapshots import plain
from loamwork.storage import RunStore, shuffle_partitions

EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


@dataclass(frozen=True)
class Check:
    """One declared constraint: ``violated`` is an SQL condition on a row."""

    column: str
    finding: str
    violated: str


@dataclass(frozen=True)
class LoadProfile:
    """What to profile: the load's keys, its order within the group, columns, declared lengths and checks."""

    group: str
    number: str
    columns: list[str]
    declared: dict[str, int] = field(default_factory=dict)
    checks: list[Check] = field(default_factory=list)

    def all_checks(self) -> list[Check]:
        return [*self.checks, *(Check(c, "maxlength", f"length(rtrim(`{c}`)) >= {n}") for c, n in self.declared.items())]

    def kinds(self) -> list[str]:
        """Kinds of findings that checks of a row give, in order; a state counts them as v0, v1, ..."""
        return sorted({c.finding for c in self.all_checks()})

    def state(self, df: DataFrame) -> DataFrame:
        """(group, number, col, value, n, v0, v1, ...) of a slice; ``col`` is a column's place. One scan and one aggregate."""
        types, checks, kinds = dict(df.dtypes), self.all_checks(), self.kinds()

        def violated(column: str, kind: str) -> Column:
            """How many of the column's checks of a kind a row violates."""
            out = F.lit(0)
            for c in (c for c in checks if (c.column, c.finding) == (column, kind)):
                out = out + F.coalesce(F.expr(c.violated), F.lit(False)).cast("int")
            return out

        cells = F.array(*(F.struct(F.lit(i).alias("col"), plain(c, types[c]).alias("value"), *(violated(c, k).alias(f"v{j}") for j, k in enumerate(kinds))) for i, c in enumerate(self.columns)))
        cell = df.select(self.group, self.number, F.inline(cells))
        return cell.groupBy(self.group, self.number, "col", "value").agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"v{j}").alias(f"v{j}") for j in range(len(kinds))))

    def merge(self, *states: DataFrame) -> DataFrame:
        """Sum of states of slices."""
        out = states[0]
        for s in states[1:]:
            out = out.unionByName(s)
        keys = [c for c in out.columns if c in (self.group, self.number, "col", "value")]
        return out.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in out.columns if c not in keys))

    def column_name(self) -> Column:
        return F.element_at(F.array(*map(F.lit, self.columns)), F.col("col") + 1)

    def metrics(self, state: DataFrame, mode: bool = True) -> DataFrame:
        """(group, number, columnname, total, nulls, distincts, mode_n, v0, v1, ..., mode) from a state.

        Without ``mode`` all figures are numbers, which one hash aggregate adds up.
        """
        there = F.col("value").isNotNull()
        figures = [
            F.sum("n").alias("total"),
            F.sum(F.when(there, 0).otherwise(F.col("n"))).alias("nulls"),
            F.count("value").alias("distincts"),
            F.coalesce(F.max(F.when(there, F.col("n"))), F.lit(0)).alias("mode_n"),
            *(F.sum(f"v{j}").alias(f"v{j}") for j in range(len(self.kinds()))),
        ]
        if mode:
            figures.append(F.max(F.when(there, F.struct("n", "value")))["value"].alias("mode"))
        return state.groupBy(self.group, self.number, "col").agg(*figures).withColumn("columnname", self.column_name()).drop("col")

    def violations(self, metrics: DataFrame) -> DataFrame:
        """(group, number, columnname, finding, n) where n > 0."""
        each = F.array(*(F.struct(F.lit(k).alias("finding"), F.col(f"v{j}").alias("n")) for j, k in enumerate(self.kinds())))
        return metrics.select(self.group, self.number, "columnname", F.inline(each)).where("n > 0")

    def profile(self, df: DataFrame) -> DataFrame:
        """The whole profile of each load, a row a column.

        (group, number, columnname, total, nulls, distincts, mode, mode_n, minvalue, maxvalue, longest, lengthreached, patterns, outofrange)
        Values are in comparable form, as text; of several most common ones ``mode`` is the last in order. ``longest`` is
        without trailing spaces and null for columns that aren't strings, ``lengthreached`` for those without a declared
        length, and a count of violations for those without such a check.
        """
        types, checks = dict(df.dtypes), list(enumerate(self.all_checks()))
        aggs = [F.count_if(F.expr(c.violated)).alias(f"v{i}") for i, c in checks]
        each = []
        for i, c in enumerate(self.columns):
            text = types[c] == "string"
            shown = plain(c, types[c]) if text else F.col(c)
            aggs += [F.min(shown).cast("string").alias(f"min{i}"), F.max(shown).cast("string").alias(f"max{i}")]
            aggs += [(F.max(F.length(F.rtrim(F.col(c)))) if text else F.lit(None).cast("int")).alias(f"longest{i}")]
            counted = {k: [F.col(f"v{j}") for j, x in checks if (x.column, x.finding) == (c, k)] for k in ("pattern", "range")}
            number = lambda k, of=counted: sum(of[k][1:], of[k][0]) if of[k] else F.lit(None).cast("long")
            reached = (F.coalesce(F.col(f"longest{i}"), F.lit(0)) >= self.declared[c]).cast("int") if c in self.declared else F.lit(None).cast("int")
            values = {"rc": F.lit(c), "minvalue": F.col(f"min{i}"), "maxvalue": F.col(f"max{i}"), "longest": F.col(f"longest{i}"), "lengthreached": reached, "patterns": number("pattern"), "outofrange": number("range")}
            each.append(F.struct(*(v.alias(k) for k, v in values.items())))
        ranges = df.groupBy(F.col(self.group).alias("rg"), F.col(self.number).alias("rn")).agg(*aggs).select("rg", "rn", F.inline(F.array(*each)))
        metrics = self.metrics(self.state(df)).select(self.group, self.number, "columnname", "total", "nulls", "distincts", "mode", "mode_n")
        return metrics.join(ranges, F.expr(f"`{self.group}` <=> rg and `{self.number}` <=> rn and columnname = rc")).drop("rg", "rn", "rc")

    def drift(self, metrics: DataFrame, share: str = "0.107", part: str = "0.5") -> DataFrame:
        """(group, number, columnname, finding): nulls, mode or distinct against the previous load.

        Decimal arithmetic, so a difference equal to the bound is no finding.
        """
        w = Window.partitionBy(self.group, "columnname").orderBy(self.number)
        d = lambda c: F.col(c).cast("decimal(12,0)")
        before = metrics.withColumns({f"p_{c}": F.lag(c).over(w) for c in ("total", "nulls", "mode_n", "distincts")})
        shifted = lambda c: F.abs(d(c) * d("p_total") - d(f"p_{c}") * d("total")) > d("total") * d("p_total") * F.lit(share).cast("decimal(6,3)")
        kinds = {
            "nulls": shifted("nulls"),
            "mode": shifted("mode_n"),
            "distinct": F.abs(d("distincts") - d("p_distincts")) > d("p_distincts") * F.lit(part).cast("decimal(6,3)"),
        }
        each = F.array(*(F.struct(F.lit(k).alias("finding"), v.alias("hit")) for k, v in kinds.items()))
        return before.where("p_total is not null").select(self.group, self.number, "columnname", F.inline(each)).where("hit").drop("hit")

    def control_limits(self, metrics: DataFrame, loads: int = 5, sigmas: float = 3.0) -> DataFrame:
        """Loads whose null share, distinct share or mode share leaves mean +- sigmas * deviation of up to ``loads`` former loads.

        At least three former loads are asked for. (group, number, columnname, metric, value, mean, deviation)
        """
        w = Window.partitionBy(self.group, "columnname", "metric").orderBy(self.number).rowsBetween(-loads, -1)
        total = F.col("total")
        each = F.array(*(F.struct(F.lit(k).alias("metric"), (F.col(c) / total).alias("value")) for k, c in (("null_share", "nulls"), ("distinct_share", "distincts"), ("mode_share", "mode_n"))))
        long = metrics.select(self.group, self.number, "columnname", F.inline(each))
        limits = long.withColumns({"mean": F.avg("value").over(w), "deviation": F.stddev_pop("value").over(w), "former": F.count("value").over(w)})
        return limits.where((F.col("former") >= 3) & (F.abs(F.col("value") - F.col("mean")) > sigmas * F.col("deviation") + 1e-9)).drop("former")

    def misreported(self, metrics: DataFrame, violations: DataFrame, report: DataFrame) -> DataFrame:
        """(group, number, columnname) whose stored figures differ from the true ones."""
        reached = violations.where("finding = 'maxlength'").select(F.col(self.group).alias("vg"), F.col(self.number).alias("vn"), F.col("columnname").alias("vc"), F.lit(1).alias("hit"))
        true = metrics.join(reached, F.expr(f"`{self.group}` <=> vg and `{self.number}` <=> vn and columnname = vc"), "left")
        declared = F.col("columnname").isin(*self.declared) if self.declared else F.lit(False)
        true = true.select(F.col(self.group).alias("tg"), F.col(self.number).alias("tn"), F.col("columnname").alias("tc"), "nulls", "distincts", F.when(declared, F.coalesce("hit", F.lit(0))).alias("reached"))
        said = report.select(F.col(self.group), F.col(self.number), F.col("columnname"), "nullvalues", "distinctvalues", "maxlengthreached")
        wrong = ~(F.col("nullvalues").eqNullSafe(F.col("nulls")) & F.col("distinctvalues").eqNullSafe(F.col("distincts")) & F.col("maxlengthreached").eqNullSafe(F.col("reached")))
        return said.join(true, F.expr(f"`{self.group}` <=> tg and `{self.number}` <=> tn and columnname = tc")).where(wrong).select(self.group, self.number, "columnname").distinct()

    def findings(self, metrics: DataFrame, report: DataFrame) -> DataFrame:
        """All findings of all loads: (group, number, columnname, finding)."""
        keys = [self.group, self.number, "columnname", "finding"]
        violations = self.violations(metrics)
        return (
            violations.select(*keys)
            .union(self.drift(metrics).select(*keys))
            .union(self.misreported(metrics, violations, report).withColumn("finding", F.lit("misreported")).select(*keys))
        )


class ProfileStore:
    """States and metrics of the loads added so far; with ``path`` kept there, and opened again by a later session.

    Kinds of runs: ``state``, bucketed by load and value, one a slice; ``loads``, which slice has which load;
    ``metrics``, a row a load and column, of which the last slice's count.
    """

    def __init__(self, spark: SparkSession, profile: LoadProfile, path: str | None = None, buckets: int | None = None) -> None:
        self.spec = profile
        self.store = RunStore(spark, path, {"buckets": buckets or shuffle_partitions(spark), "columns": profile.columns, "kinds": profile.kinds()}, "profile")
        if (self.store.settings["columns"], self.store.settings["kinds"]) != (profile.columns, profile.kinds()):
            raise ValueError("the store profiles other columns or checks")
        self.buckets = self.store.settings["buckets"]

    def add(self, df: DataFrame, batch_id: str | None = None) -> None:
        """Add rows; whole loads or pieces of some. Reads these rows, and of the states those of the same loads.

        A batch of an id added before changes nothing.
        """
        if batch_id is not None and batch_id in self.store.batches:
            return
        spec, former, listed = self.spec, self.store.of("state"), self.store.of("loads")
        cells = [spec.group, spec.number, "col", "value"]
        # the aggregate has put its rows where the buckets are, if there are as many
        placed = self.buckets == shuffle_partitions(self.store.spark)
        new = self.store.add("state", spec.state(df), cells, self.buckets, placed=placed, sort=False).df()
        here = new.where("col = 0").select(F.col(spec.group).alias("lg"), F.col(spec.number).alias("ln")).distinct()
        loads = self.store.add("loads", here.withColumn("slice", F.lit(len(former))), "ln", self.buckets).df().drop("slice")
        if former:
            known = listed[0].df()
            for r in listed[1:]:
                known = known.unionByName(r.df())
            both = loads.select(F.col("lg").alias("g"), F.col("ln").alias("n"))
            slices = known.join(both, F.expr("lg <=> g and ln <=> n"), "left_semi").select("slice").distinct().collect()  # numbers of runs
            same = F.col(spec.group).eqNullSafe(F.col("lg")) & F.col(spec.number).eqNullSafe(F.col("ln"))
            if slices:
                new = spec.merge(new, *(former[s[0]].df().join(loads, same, "left_semi") for s in sorted(slices)))
        self.store.compact("loads", 2, lambda runs: runs[0].unionByName(runs[1]))
        version = F.lit(self.store.version).alias("version")
        self.store.add("metrics", spec.metrics(new, mode=False).select("*", version), "columnname", self.buckets)
        self.store.compact("metrics", 2, self._last)
        self.store.publish(batch_id)

    def _last(self, runs: list[DataFrame]) -> DataFrame:
        """The newest metrics of each load and column."""
        out = runs[0]
        for r in runs[1:]:
            out = out.unionByName(r)
        keys = [self.spec.group, self.spec.number, "columnname"]
        rest = [c for c in out.columns if c not in keys]
        return out.groupBy(*keys).agg(F.max(F.struct("version", *(c for c in rest if c != "version"))).alias("x")).select(*keys, *(F.col(f"x.{c}") for c in rest)).select(*out.columns)

    def state(self) -> DataFrame:
        """The state of all loads."""
        return self.spec.merge(*(r.df() for r in self.store.of("state")))

    def metrics(self) -> DataFrame:
        """The metrics of all loads, as of ``LoadProfile.metrics`` without the modes themselves."""
        runs = [r.df() for r in self.store.of("metrics")]
        return (self._last(runs) if len(runs) > 1 else runs[0]).drop("version")

    def findings(self, report: DataFrame) -> DataFrame:
        return self.spec.findings(self.metrics(), report)

    def control_limits(self, loads: int = 5, sigmas: float = 3.0) -> DataFrame:
        return self.spec.control_limits(self.metrics(), loads, sigmas)

    def close(self) -> None:
        self.store.close()


DIGIT_OR_CONTROL = r"regexp_like(`{0}`, '[\\p{{Nd}}\\x00-\\x1f]')"

CUSTOMER_LOADS = LoadProfile(
    group="feedcode",
    number="snapshotno",
    columns=["customerid", "dateofbirth", "firstname", "lastname", "email", "country", "age", "loyaltypoints"],
    declared={"firstname": 100, "lastname": 100, "country": 100, "email": 255},
    checks=[
        Check("email", "pattern", r"not regexp_like(trim(email), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')"),
        *(Check(c, "pattern", DIGIT_OR_CONTROL.format(c)) for c in ("firstname", "lastname", "country")),
        Check("age", "range", "age < 0 or age > 120"),
        Check("loyaltypoints", "range", "loyaltypoints < 0"),
        Check("dateofbirth", "range", "dateofbirth < date'1900-01-01' or dateofbirth > snapshotdate"),
    ],
)
