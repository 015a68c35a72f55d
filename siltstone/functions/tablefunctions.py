"""Table functions for SQL: lines of a text and hits of a pattern, by the rules of ``text.lines`` and ``text.hits``.

``register`` makes them known to a session: SELECT t.* FROM docs, LATERAL lines(docs.text) t.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

LINES = "line_no int, line string"
HITS = "line_no int, hit string"


class Lines:
    """One row a line; an empty text is one empty line, a null has none."""

    def eval(self, text: str | None) -> Iterator[tuple[int, str]]:
        if text is not None:
            yield from enumerate(re.split(r"\r?\n", text), 1)


class RegexHits:
    """One row a match that is not empty, with the line it starts on."""

    def eval(self, text: str | None, pattern: str | None) -> Iterator[tuple[int, str]]:
        if text is None or pattern is None:
            return
        at, line = 0, 1
        for m in re.finditer(pattern, text):
            if m[0]:
                line, at = line + text.count("\n", at, m.start()), m.start()
                yield line, m[0]


def register(spark: SparkSession) -> None:
    """Registers ``lines(text)`` and ``regex_hits(text, pattern)``."""
    from siltstone.session import ship

    ship(spark)
    spark.udtf.register("lines", F.udtf(Lines, returnType=LINES, useArrow=False))
    spark.udtf.register("regex_hits", F.udtf(RegexHits, returnType=HITS, useArrow=False))
