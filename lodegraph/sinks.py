"""Rankings as text, and as files."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

FORMATS = ("table", "csv", "json")
HEADERS = ("Rank", "Component", "Weight")


def top(ranked: DataFrame, n: int | None) -> DataFrame:
    if n is not None and n < 0:
        raise ValueError("top must not be negative")
    return ranked if n is None else ranked.limit(n)


def render(rows: Sequence[tuple[int, str, float]], fmt: str = "table") -> str:
    """table: a grid, 8 decimals; csv: 10 decimals; json: weights rounded to 10."""
    if fmt == "table":
        return _grid([(str(r), n, f"{w:.8f}") for r, n, w in rows])
    if fmt == "csv":
        out = io.StringIO()
        csv.writer(out).writerows([("rank", "qualified_name", "weight"), *((r, n, f"{w:.10f}") for r, n, w in rows)])
        return out.getvalue()
    if fmt == "json":
        return json.dumps([{"rank": r, "qualified_name": n, "weight": round(w, 10)} for r, n, w in rows], indent=2)
    raise ValueError(f"no format is called '{fmt}'; there are: {', '.join(FORMATS)}")


def _grid(rows: list[tuple[str, str, str]]) -> str:
    widths = [max(len(x[k]) for x in [HEADERS, *rows]) for k in range(3)]

    def rule(mark: str) -> str:
        return "+" + "+".join(mark * (w + 2) for w in widths) + "+"

    def line(cells: Sequence[str], right: bool) -> str:
        return "|" + "|".join(f" {c:>{w}} " if right and k != 1 else f" {c:<{w}} " for k, (c, w) in enumerate(zip(cells, widths, strict=True))) + "|"

    out = [rule("-"), line(HEADERS, True), rule("=")]
    for r in rows:
        out += [line(r, True), rule("-")]
    return "\n".join(out)


def format_output(ranked: DataFrame, fmt: str = "table", n: int | None = None) -> str:
    """A ranking (rank, qualified_name, weight) in order, as text."""
    if fmt not in FORMATS:
        raise ValueError(f"no format is called '{fmt}'; there are: {', '.join(FORMATS)}")
    return render([(r.rank, r.qualified_name, r.weight) for r in top(ranked, n).toLocalIterator()], fmt)


def component_text(name: Column, uses: Column, cluster: Column) -> Column:
    """One line on a component: its name, how many others it refers to, its class if it has one."""
    return F.concat(name, F.format_string(" refers to %d", F.size(uses)), F.when(cluster.isNotNull(), F.format_string(", class %d", cluster)).otherwise(""))


def csv_weight(weight: Column) -> Column:
    return F.format_string("%.10f", weight)


def table_weight(weight: Column) -> Column:
    return F.format_string("%.8f", weight)


def json_number(weight: Column) -> Column:
    """A weight rounded to 10 decimals as json.dumps() writes it: no exponent from 0.0001 on, two digits of it below."""
    digits = F.round(F.abs(weight) * 1e10).cast("long").cast("string")
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", F.round(weight, 10)), "0+$", ""), r"\.$", ".0")
    places = F.regexp_replace(F.substring(digits, 2, 20), "0+$", "")
    small = F.concat(F.when(weight < 0, "-").otherwise(""), F.substring(digits, 1, 1), F.when(places != "", F.concat(F.lit("."), places)).otherwise(""), F.lit("e-"), F.lpad((11 - F.length(digits)).cast("string"), 2, "0"))
    return F.when((digits != "0") & (F.abs(F.round(weight, 10)) < 1e-4), small).otherwise(plain)


def json_row(rank: Column, name: Column, weight: Column) -> Column:
    own = F.to_json(F.struct(rank.alias("rank"), name.alias("qualified_name")))
    return F.concat(F.regexp_replace(own, r"\}$", ""), F.lit(',"weight":'), json_number(weight), F.lit("}"))


def write(ranked: DataFrame, path: str, fmt: str = "csv") -> None:
    """A ranking of any size as a folder of files."""
    own = ranked.select("rank", "qualified_name", csv_weight(F.col("weight")).alias("weight") if fmt == "csv" else F.round("weight", 10).alias("weight"))
    own.write.mode("overwrite").option("header", True).format(fmt).save(path)
