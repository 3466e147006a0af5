"""Read-only SQL over a frame."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def read_only_sql(df: DataFrame, sql: str, limit: int | None = None, view: str = "rows") -> DataFrame:
    """Run one SELECT or WITH statement on ``df``, seen as ``view``; anything else is refused."""
    text = sql.strip().rstrip(";").strip()
    if not re.match(r"(?i)(select|with)\b", text) or ";" in text:
        raise ValueError("only one SELECT or WITH statement is allowed")
    # the frame is bound to this one statement; no session-wide view is left behind
    out = df.sparkSession.sql(re.sub(rf"(?i)\b(from|join)\s+{view}\b", rf"\1 {{{view}}}", text), **{view: df})
    return out if limit is None else out.limit(limit)
