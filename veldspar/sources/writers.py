"""Sinks: ledgers, summaries, reports and bundles."""

from __future__ import annotations

import json
import shutil
import zipfile
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(parts: list[DataFrame], path: str) -> None:
    """Tables of different columns as one CSV table with all of them, in the order of their first appearance."""
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def json_summary(df: DataFrame) -> str:
    """The single row of ``df`` as JSON with sorted keys."""
    row = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).first()
    return json.dumps(json.loads(row.j) if row else {}, sort_keys=True, indent=2)


def _small(df: DataFrame, rows: int) -> list:
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"more than {rows} rows: name the limit that is meant")
    return got


def markdown_table(df: DataFrame, rows: int = 10_000) -> str:
    """A report's table, whole: more than ``rows`` rows are an error."""
    got = _small(df, rows)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in got)])


def console_table(df: DataFrame, rows: int = 10_000) -> str:
    """A table of whole values, in columns; more than ``rows`` rows are an error."""
    cells = [df.columns, *([("" if v is None else str(v)) for v in r] for r in _small(df, rows))]
    widths = [max(len(r[k]) for r in cells) for k in range(len(df.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in cells)


def zip_bundle(files: list[Path], path: Path) -> None:
    """Members in the order of their names, with a fixed date, so equal files give equal bundles; files are copied in pieces.

    Files of one name in different folders keep as much of their paths as tells them apart; one file given twice is an error.
    """
    names, depth = {f: f.name for f in files}, 1
    if len({f.resolve() for f in files}) < len(files):
        raise ValueError("a file is given twice")
    while len(set(names.values())) < len(files):
        depth += 1
        taken = Counter(names.values())
        names = {f: "/".join(f.resolve().parts[-depth:]).lstrip("/") if taken[n] > 1 else n for f, n in names.items()}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, compresslevel=9) as z:
        for f in sorted(files, key=names.get):
            entry = zipfile.ZipInfo(names[f])
            entry.compress_type = zipfile.ZIP_DEFLATED
            with f.open("rb") as source, z.open(entry, "w", force_zip64=f.stat().st_size >= 1 << 31) as out:
                shutil.copyfileobj(source, out, 1 << 20)
