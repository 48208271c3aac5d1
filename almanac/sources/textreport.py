"""Tables from text reports described by regular expressions.

A report is read line by line. Each line rule owns the next columns of the header,
one per capture group and then one per extra column. The first rule found in a line
fills its columns. Columns marked to hold keep their value for the lines below, in
the same file, until their rule is found again; the others are empty again on the
next line. A matched line gives a row when the trigger column is then neither empty
nor zero.

Held values are carried in two steps, so one very large file is not one task: within
the blocks of a file, and from block to block over one small row per block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import bare_number
from .folders import TEXT_FILES, read_lines


@dataclass(frozen=True)
class LineRule:
    """A pattern, its number of capture groups, and extra columns computed from the groups."""

    pattern: str
    groups: int
    extra: Sequence[Callable[[list[Column]], Column]] = field(default=())

    @property
    def width(self) -> int:
        return self.groups + len(self.extra)

    def values(self, text: Column) -> list[Column]:
        raw = [F.regexp_extract(text, self.pattern, g) for g in range(1, self.groups + 1)]
        return [bare_number(c) for c in [*raw, *[f(raw) for f in self.extra]]]


# Empty, or a number that is zero.
UNSET = r"^([+-]?(0+\.?0*|\.0+)([eE][+-]?\d+)?)?$"


def _is_set(col: Column) -> Column:
    """Not empty and not the number zero; NULL for NULL."""
    return ~col.rlike(UNSET)


def parse_lines(
    lines: DataFrame,
    header: Sequence[tuple[str, bool]],
    rules: Sequence[LineRule],
    trigger: str | int,
    file: str = "file",
    block: str = "block",
    line: str = "line",
    text: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rows of the report in ``lines``, as text columns named by ``header``.

    ``header``: (name, hold) pairs. ``trigger``: name or position of the trigger
    column. ``block`` rises through a file and ``line`` within a block. ``keep`` are
    columns of ``lines`` to carry along, such as the file.
    """
    names = [n for n, _ in header]
    hold = [h for _, h in header]
    if sum(r.width for r in rules) != len(header):
        raise ValueError(f"rules give {sum(r.width for r in rules)} columns, the header has {len(header)}")
    at = trigger if isinstance(trigger, int) else names.index(trigger)

    kept = [f"k{i}" for i in range(len(keep))]
    source = lines.select(
        F.col(file).alias("file"),
        F.col(block).alias("block"),
        F.col(line).alias("line"),
        F.col(text).alias("text"),
        *[F.col(k).alias(a) for k, a in zip(keep, kept)],
    )
    first = [sum(r.width for r in rules[:i]) for i in range(len(rules))]
    holding = [i for i, r in enumerate(rules) if any(hold[first[i] : first[i] + r.width])]
    trigger_rule = max(i for i in range(len(rules)) if first[i] <= at)
    # with a trigger that is not held, lines of other rules change nothing: drop them before rows move
    useful = range(len(rules)) if hold[at] else sorted({*holding, trigger_rule})

    which = F.coalesce(*[F.when(F.col("text").rlike(r.pattern), F.lit(i)) for i, r in enumerate(rules)])
    matched = source.withColumn("rule", which).where(F.col("rule").isin(*useful))
    found = matched.select(
        "file",
        "block",
        "line",
        *kept,
        *[
            F.when(
                F.col("rule") == i,
                F.struct(*[v.alias(f"v{first[i] + j}") for j, v in enumerate(r.values(F.col("text")))]),
            ).alias(f"r{i}")
            for i, r in enumerate(rules)
            if r.width
        ],
    )

    def value(i: int, position: int) -> Column:
        return F.col(f"{'s' if hold[position] else 'r'}{i}.v{position}")

    state = found
    if holding:
        in_block = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
        # every block has a row here, also one that sets nothing itself
        ends = found.groupBy("file", "block").agg(
            *[F.max_by(f"r{i}", F.when(F.col(f"r{i}").isNotNull(), F.col("line"))).alias(f"e{i}") for i in holding]
        )
        earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(
            "file", "block", *[F.last(f"e{i}", ignorenulls=True).over(earlier).alias(f"c{i}") for i in holding]
        )
        local = found.select("*", *[F.last(f"r{i}", ignorenulls=True).over(in_block).alias(f"h{i}") for i in holding])
        state = local.join(carried, ["file", "block"]).select(
            *found.columns, *[F.coalesce(f"h{i}", f"c{i}").alias(f"s{i}") for i in holding]
        )

    columns = [
        F.nullif(value(i, first[i] + j), F.lit("")).alias(names[first[i] + j])
        for i, r in enumerate(rules)
        for j in range(r.width)
    ]
    return state.where(_is_set(value(trigger_rule, at))).select(
        *[F.col(a).alias(k) for k, a in zip(keep, kept)], *columns
    )


def read_report(
    spark: SparkSession,
    path: str,
    header: Sequence[tuple[str, bool]],
    rules: Sequence[LineRule],
    trigger: str | int,
    mode: str = "latest",
    file_rule: str = TEXT_FILES,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Parse the report files of the chosen folder."""
    return parse_lines(read_lines(spark, path, mode, file_rule), header, rules, trigger, keep=keep)


# Totals of a price report and their level.
TOTAL_LEVELS = {"department": 1, "category": 2, "zone": 3}
_TOTALS_LAST_FIRST = [(level, word) for word, level in reversed(TOTAL_LEVELS.items())]


def total_level(groups: list[Column]) -> Column:
    """Extra column: 1, 2, 3 for a department, category or zone total found in any group."""
    return F.coalesce(*[F.when(_any(groups, rf"(?i){w}\s+total"), F.lit(n)) for n, w in _TOTALS_LAST_FIRST]).cast("string")


def total_name(groups: list[Column]) -> Column:
    """Extra column: the name in ``<department|category|zone> total for <name>``."""
    names = [
        F.nullif(F.regexp_extract(g, rf"(?i){w}\s+total\s+for\s+([\s\w]+\w)", 1), F.lit(""))
        for _, w in _TOTALS_LAST_FIRST
        for g in reversed(groups)
    ]
    return F.coalesce(*names)


def _any(groups: list[Column], pattern: str) -> Column:
    test = F.lit(False)
    for g in groups:
        test = test | g.rlike(pattern)
    return test
