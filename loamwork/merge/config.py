"""Merge configurations: defaults, resolution, validation.

A configuration is checked in a fixed order; all failures are told at once.
Names of columns compare without regard to case.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The kinds of merges, and the columns of the target that each kind keeps.
SCD1, SCD2_VERSION, SCD2_DATE, SCD2_DATE_CURRENT, SCD4 = "SCD1", "SCD2Version", "SCD2Date", "SCD2DateAndCurrent", "SCD4"
USED = {
    SCD1: ("create", "modified"),
    SCD2_VERSION: ("create", "version", "is_current", "is_deleted"),
    SCD2_DATE: ("create", "modified", "is_deleted", "row_effective", "row_expiration"),
    SCD2_DATE_CURRENT: ("create", "modified", "is_current", "is_deleted", "row_effective", "row_expiration"),
    SCD4: ("create",),
}
EXPIRING = (SCD2_DATE, SCD2_DATE_CURRENT)
THREE_PARTS = re.compile(r"(?s).*\..*\..*")


class ValidationError(ValueError):
    """Raised with all failures of a configuration."""

    def __init__(self, failures: list[str]) -> None:
        super().__init__("Validation failed. See above for details.\n" + "\n".join(failures))
        self.failures = failures


@dataclass(frozen=True)
class MergeDefaults:
    """The one row of defaults."""

    create: str | None = "WH_CreateDateTime_UTC"
    modified: str | None = "WH_ModifiedDateTime_UTC"
    row_effective: str | None = "WH_RowEffectiveDateTime_UTC"
    row_expiration: str | None = "WH_RowExpirationDateTime_UTC"
    row_expiration_value: str | None = "9999-12-31"
    version: str | None = "WH_Version"
    is_current: str | None = "WH_isCurrent"
    is_deleted: str | None = "WH_isDeleted"
    utc_offset: int | None = 0


def defaults_table(spark: SparkSession, defaults: MergeDefaults) -> DataFrame:
    """The defaults as their table of one row."""
    names = [f.name for f in fields(MergeDefaults)]
    return spark.createDataFrame([tuple(getattr(defaults, n) for n in names)], ", ".join(f"{n} {'int' if n == 'utc_offset' else 'string'}" for n in names))


@dataclass(frozen=True)
class MergeConfig:
    """One configuration; ``None`` stands for the default."""

    name: str
    source: str
    target: str
    scd_type: str
    merge_on: str
    ignore: str | None = None
    history: str | None = None
    delete_if_not_matched: bool = False
    ignore_identity: bool = True
    create: str | None = None
    modified: str | None = None
    row_effective: str | None = None
    row_expiration: str | None = None
    row_expiration_value: str | None = None
    version: str | None = None
    is_current: str | None = None
    is_deleted: str | None = None
    utc_offset: int | None = None
    warnings: tuple[str, ...] = field(default=(), compare=False)

    def keys(self) -> list[str]:
        return csv(self.merge_on)

    def ignored(self) -> list[str]:
        return csv(self.ignore)

    def kept(self) -> dict[str, str | None]:
        """Columns of the target that the merge fills itself, by role."""
        return {role: getattr(self, role) for role in USED[self.scd_type]}

    def now(self, utc: dt.datetime) -> dt.datetime:
        return utc + dt.timedelta(minutes=self.utc_offset or 0)


def csv(text: str | None) -> list[str]:
    """Entries of a comma-separated list without outer spaces and empty ones."""
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def resolve(config: MergeConfig, defaults: MergeDefaults) -> MergeConfig:
    """Fill in defaults, blank what the kind doesn't use, and add the kept columns to the ignored ones."""
    if config.scd_type not in USED:
        raise ValidationError([f"SCDType [{config.scd_type}] is not one of {', '.join(USED)}."])
    if config.row_expiration_value is not None and config.scd_type not in EXPIRING:
        raise ValidationError([f"An expiration value is only for {' and '.join(EXPIRING)}."])
    roles = [f.name for f in fields(MergeDefaults) if f.name not in ("utc_offset", "row_expiration_value")]
    used = USED[config.scd_type]
    filled = {r: (getattr(config, r) or getattr(defaults, r)) if r in used else None for r in roles}
    value = (config.row_expiration_value or defaults.row_expiration_value) if config.scd_type in EXPIRING else None
    if config.scd_type in EXPIRING and not value:
        raise ValidationError(["An expiration value is required."])
    there = config.ignored()
    lowered = {c.lower() for c in there}
    missing = [c.lower() for c in filled.values() if c and c.lower() not in lowered]
    offset = config.utc_offset if config.utc_offset is not None else defaults.utc_offset or 0
    return replace(config, **filled, row_expiration_value=value, utc_offset=offset, ignore=",".join([*there, *missing]) or None)


def validate(config: MergeConfig, defaults: MergeDefaults, columns_of: Callable[[str], list[str] | None]) -> MergeConfig:
    """The resolved configuration, or a ``ValidationError``. ``columns_of`` gives a table's columns, or ``None`` if there is no such table."""
    out = resolve(config, defaults)
    failures = [f"{what} [{n}] needs database, schema and table." for what, n in (("Source", out.source), ("Target", out.target), ("History", out.history)) if n is not None and not THREE_PARTS.fullmatch(n)]
    found: dict[str, set[str]] = {}
    for what, name in (("Source", out.source), ("Target", out.target), ("History", out.history)):
        if name is None:
            continue
        columns = columns_of(name)
        if columns is None:
            failures.append(f"{what} does not exist: {name}")
        found[what] = {c.lower() for c in columns or ()}
    if not out.keys():
        failures.append("MergeOnColumns is empty.")
    for c in out.keys():
        failures += [f"MergeOn column [{c}] does not exist on {what.lower()}." for what in ("Source", "Target") if c.lower() not in found[what]]
    own = {c.lower() for c in out.kept().values() if c}
    warnings = []
    for c in out.ignored():
        if c.lower() not in found["Source"]:
            (warnings if c.lower() in own else failures).append(f"Ignore column [{c}] does not exist on source.")
    ignored = {c.lower() for c in out.ignored()}
    for role, c in out.kept().items():
        if not c:
            failures.append(f"No column name for {role}.")
            continue
        if c.lower() not in found["Target"]:
            failures.append(f"{role} column [{c}] does not exist on target: {out.target}")
        if c.lower() not in ignored:
            failures.append(f"{role} column [{c}] is not present in IgnoreColumns.")
    if failures:
        raise ValidationError(failures)
    return replace(out, warnings=tuple(warnings))


def upsert(stored: dict[str, MergeConfig], config: MergeConfig, defaults: MergeDefaults, columns_of: Callable[[str], list[str] | None]) -> dict[str, MergeConfig]:
    """The stored configurations with a validated one added or replaced; names are unique without regard to case."""
    return {n: c for n, c in stored.items() if n.lower() != config.name.lower()} | {config.name: validate(config, defaults, columns_of)}


def configuration_checks(configs: DataFrame) -> DataFrame:
    """(dynamicmergeconfigurationid, problem) of stored configuration rows that break a rule of their table.

    Rules: a known kind, three-part names, a unique name, and something to merge on.
    """
    part = lambda c: F.col(c).like("%.%.%")
    counts = configs.groupBy(F.lower("mergeconfigurationname").alias("n")).agg(F.count(F.lit(1)).alias("same"))
    rows = configs.withColumn("n", F.lower("mergeconfigurationname")).join(counts, "n", "left")
    rules = {
        "scdtype": ~F.coalesce(F.col("scdtype").isin(*USED), F.lit(False)),
        "qualifiedsourcename": ~F.coalesce(part("qualifiedsourcename"), F.lit(False)),
        "qualifiedtargetname": ~F.coalesce(part("qualifiedtargetname"), F.lit(False)),
        "qualifiedtargethistoryname": F.col("qualifiedtargethistoryname").isNotNull() & ~part("qualifiedtargethistoryname"),
        "mergeconfigurationname": F.col("n").isNull() | (F.col("same") > 1),
        "mergeoncolumns": F.length(F.trim(F.coalesce("mergeoncolumns", F.lit("")))) == 0,
    }
    problems = F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items())))
    return rows.select("dynamicmergeconfigurationid", F.explode(problems).alias("problem"))
