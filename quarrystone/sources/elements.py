"""Files as layout elements, through a parser provider.

A parser turns the bytes of a file into (text, page, box) rows. The default reads text files: a form feed is a change
of page, a blank line ends an element. A parser of another format is passed in; nothing else changes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

Parser = Callable[[bytes], list[tuple[str, int, list[float] | None]]]
ELEMENTS = "path string, element_idx int, text string, page_num int, box array<double>"


def text_parser(data: bytes) -> list[tuple[str, int, list[float] | None]]:
    out = []
    for page, part in enumerate(data.decode("utf-8", "replace").split("\f"), 1):
        out += [(x.strip(), page, None) for x in re.split(r"\n\s*\n", part) if x.strip()]
    return out


def read_elements(spark: SparkSession, path: str, parser: Parser = text_parser, glob: str = "*") -> DataFrame:
    """Elements of every file under a folder, numbered in order; blank ones never come out. A file that the parser
    cannot read gives no elements."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for p, data in zip(part["path"], part["content"]):
                try:
                    found = parser(bytes(data))
                except Exception:
                    found = []
                rows += [(p, i, *e) for i, e in enumerate(found)]
            yield pd.DataFrame(rows, columns=["path", "element_idx", "text", "page_num", "box"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, ELEMENTS)
