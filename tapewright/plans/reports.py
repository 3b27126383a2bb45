"""Text reports from one-row and few-row results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

#: Reports show at most so many rows; ask for more to see more.
ROWS = 50


def number(x: object) -> str:
    """Undefined statistics show as a dash."""
    if x is None:
        return "-"
    if isinstance(x, float):
        return f"{x:,.6g}"
    return f"{x:,}" if isinstance(x, int) and not isinstance(x, bool) else str(x)


def table(df: DataFrame, title: str, columns: Sequence[str] | None = None, rows: int = ROWS) -> str:
    """An aligned text table."""
    names = list(columns or df.columns)
    got = [[number(v) for v in r] for r in df.select(*names).limit(rows).collect()]
    width = [max(len(n), *(len(r[i]) for r in got)) if got else len(n) for i, n in enumerate(names)]
    line = lambda cells: "  ".join(c.rjust(w) for c, w in zip(cells, width))
    return "\n".join([title, line(names), line(["-" * w for w in width]), *map(line, got)])


def summary(df: DataFrame, title: str) -> str:
    """One row as lines of name and value."""
    row = df.first()
    if row is None:
        return f"{title}\n(no rows)"
    wide = max(map(len, df.columns))
    return "\n".join([title, *[f"  {n.ljust(wide)}  {number(row[n])}" for n in df.columns]])
