"""Cleaning recipes: ordered, column-scoped steps that mean the same on every table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions.numbers import PLAIN_NUMBER
from tallyloom.functions.strings import title_case, trim_space
from tallyloom.operators.formats import _plain_text, quoted

# The step types, in the order a recipe is built.
STEP_TYPES = ["empty_column", "whitespace", "inconsistent_case", "numeric_with_text", "missing_values", "duplicate_rows"]


@dataclass(frozen=True)
class Step:
    type: str
    column: str | None = None
    fill: object = None

    def problems(self) -> list[str]:
        out = []
        if self.type not in STEP_TYPES:
            out.append(f"{self.type} is not a cleaning step")
        elif (self.type == "duplicate_rows") != (self.column is None):
            out.append("every step but duplicate_rows names a column")
        if (self.type == "missing_values") != (self.fill is not None):
            out.append("missing_values, and only that, takes a fill value")
        return out

    def describe(self) -> str:
        return {
            "empty_column": f'Drop the empty column "{self.column}"',
            "whitespace": f'Trim spaces around values in "{self.column}"',
            "inconsistent_case": f'Normalise capitalisation in "{self.column}"',
            "numeric_with_text": f'Read "{self.column}" as numbers, stripping stray text',
            "missing_values": f'Fill blanks in "{self.column}" with {self.fill!r}',
            "duplicate_rows": "Remove exactly duplicated rows",
        }[self.type]


def validate(steps: list[Step]) -> list[str]:
    return [f"Step {i}: {p}" for i, s in enumerate(steps, 1) for p in s.problems()]


def build_recipe(accepted: list[str], issues: list[dict], columns: list[tuple[str, str]]) -> list[Step]:
    """The steps that carry out the accepted fixes on a table with these (name, type) columns.

    Trimming and filling apply to every column; the other fixes only where the issue was found.
    """
    steps, dropped = [], set()
    for kind in (t for t in STEP_TYPES if t in accepted):
        if kind == "duplicate_rows":
            steps.append(Step(kind))
            continue
        flagged = {i["column"] for i in issues if i["type"] == kind}
        for name, column_type in columns:
            everywhere = kind in ("whitespace", "missing_values")
            if name in dropped or not (everywhere or name in flagged):
                continue
            if kind == "empty_column":
                dropped.add(name)
            fill = None
            if kind == "missing_values":
                fill = 0 if column_type in ("number", "currency") else "Unknown"
            steps.append(Step(kind, name, fill))
    return steps


def _changed(step: Step, cell: Column) -> tuple[Column, Column]:
    """The cell after a step, and whether the step touched it."""
    if step.type == "missing_values":
        blank = cell.isNull() | (cell == "")
        return F.when(blank, F.lit(str(step.fill))).otherwise(cell), blank
    if step.type == "numeric_with_text":
        # Reading a cell as a number touches it even where its text was already one.
        kept = F.regexp_replace(cell, r"[^0-9.\-]", "")
        readable = F.coalesce(kept.rlike(PLAIN_NUMBER), F.lit(False))
        return F.when(readable, _plain_text(F.when(readable, kept).try_cast("double"))).otherwise(cell), readable
    after = trim_space(cell) if step.type == "whitespace" else title_case(cell)
    return after, ~after.eqNullSafe(cell)


def _run(df: DataFrame, steps: list[Step], flags: bool):
    """Apply steps one after the other; with `flags`, also mark what each one touched.

    Yields (frame, positions of the steps marked on it) whenever rows are about to be removed.
    """
    problems = validate(steps)
    if problems:
        raise ValueError("; ".join(problems))
    frame, marked = df, []
    for i, step in enumerate(steps):
        if step.type == "duplicate_rows":
            yield frame, marked, i
            kept = [F.col(quoted(c)) for c in frame.columns if not c.startswith("_step_")]
            frame, marked = frame.select(*kept).dropDuplicates(), []
            continue
        if step.column not in frame.columns:
            continue
        columns = {c: F.col(quoted(c)) for c in frame.columns}
        if step.type == "empty_column":
            del columns[step.column]
            touched = F.lit(True)
        else:
            after, touched = _changed(step, columns[step.column].cast("string"))
            columns[step.column] = after
        out = [e.alias(c) for c, e in columns.items()]
        if flags:
            out.append(touched.alias(f"_step_{i}"))
            marked.append(i)
        frame = frame.select(*out)
    yield frame, marked, None


def apply_recipe(df: DataFrame, steps: list[Step]) -> DataFrame:
    """The cleaned table; with no steps, the table itself."""
    frame = df
    for frame, _, _ in _run(df, steps, flags=False):
        pass
    return frame


def applied_log(df: DataFrame, steps: list[Step]) -> DataFrame:
    """What each step changed in these rows; steps that changed nothing are left out.

    All steps up to a de-duplication are counted in one pass over the rows.
    """
    out = df.sparkSession.createDataFrame([], "position int, type string, column string, affected_rows bigint")
    for frame, marked, removing in _run(df, steps, flags=True):
        if marked:
            one = frame.agg(*[F.count_if(f"_step_{i}").alias(str(i)) for i in marked])
            entries = F.array(*[
                F.struct(F.lit(i).alias("position"), F.lit(steps[i].type).alias("type"),
                         F.lit(steps[i].column).alias("column"), F.col(quoted(str(i))).alias("affected_rows"))
                for i in marked])
            out = out.unionByName(one.select(F.inline(entries)))
        if removing is not None:
            kept = [F.col(quoted(c)) for c in frame.columns if not c.startswith("_step_")]
            times = frame.select(*kept).groupBy(*kept).agg(F.count("*").alias("_times"))
            out = out.unionByName(times.agg(F.sum(F.col("_times") - 1).alias("affected_rows")).select(
                F.lit(removing).alias("position"), F.lit("duplicate_rows").alias("type"),
                F.lit(None).cast("string").alias("column"), "affected_rows"))
    return out.where("affected_rows > 0")


def quality_change(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Every issue found before or after cleaning, with both scores."""
    from tallyloom.operators.profile import quality_issues, quality_score
    from tallyloom.session import materialise

    # Issue tables have a handful of rows per column of the table.
    first, second = (materialise(quality_issues(df, columns), "issues") for df in (before, after))
    sides = first.select("type", "column", F.lit("before").alias("side"), "affected_rows").unionByName(
        second.select("type", "column", F.lit("after").alias("side"), "affected_rows"))
    rows = sides.groupBy("type", F.coalesce("column", F.lit("")).alias("column")).agg(*[
        e for side in ("before", "after") for e in (
            F.coalesce(F.sum(F.when(F.col("side") == side, F.col("affected_rows"))), F.lit(0)).alias(f"{side}_rows"),
            F.bool_or(F.col("side") == side).alias(side),
        )])
    return rows.select("*", quality_score(first).select("score").scalar().alias("before_score"),
                       quality_score(second).select("score").scalar().alias("after_score"))
