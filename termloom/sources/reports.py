"""Exports: HTML, LaTeX and fact lines made as columns, so that a report of any size is written by its tasks; and definitions of labelling tasks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def html_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One table row a row, as the column ``html`` beside the others."""
    cells = [F.concat(F.lit("<td>"), F.coalesce(escaped(F.col(c).cast("string")), F.lit("")), F.lit("</td>")) for c in columns]
    return rows.withColumn("html", F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")))


def html_document(title: str, body: list[str], style: str = "") -> str:
    """A page around lines of markup; for reports that fit the driver."""
    head = f"<head><meta charset='utf-8'><title>{title}</title>" + (f"<style>{style}</style>" if style else "") + "</head>"
    return "\n".join(["<!DOCTYPE html>", "<html>", head, "<body>", *body, "</body>", "</html>"])


def write_html(rows: DataFrame, columns: list[str], path: str) -> None:
    """The rows' markup as text files, one a task; pages are put together from them."""
    html_rows(rows, columns).select("html").write.mode("overwrite").text(path)


def fact_lines(rows: DataFrame, kind: str) -> DataFrame:
    """Stand-off lines ``KIND term="..." START=n END=n`` of found terms (doc, term, start, end)."""
    return rows.select("doc", F.concat(F.lit(f'{kind} term="'), F.replace("term", F.lit('"'), F.lit("'")), F.lit('" START='), F.col("start").cast("string"), F.lit(" END="), F.col("end").cast("string")).alias("line"))


def plot_points(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Coordinates of a plot, two decimals each."""
    return rows.select(F.format_string("(%.2f,%.2f)", F.col(x), F.col(y)).alias("point"), x)


def latex_plot(curves: dict[str, list[str]], labels: tuple[str, str]) -> str:
    """A LaTeX picture of curves given as coordinates."""
    lines = [r"\begin{tikzpicture}", rf"\begin{{axis}}[xlabel={labels[0]}, ylabel={labels[1]}]"]
    for name, points in curves.items():
        lines += [r"\addplot coordinates {" + " ".join(points) + "};", rf"\addlegendentry{{{name}}}"]
    return "\n".join([*lines, r"\end{axis}", r"\end{tikzpicture}"])


@dataclass(frozen=True)
class LabellingTask:
    """What a person is asked for, and the answers that are taken; sessions write (term, label) rows as any source of labels does."""

    name: str
    question: str
    answers: tuple[str, ...]

    def valid(self, label: Column) -> Column:
        return label.isin(*self.answers)

    def open_terms(self, terms: DataFrame, labels: DataFrame) -> DataFrame:
        """Terms that have no valid label yet."""
        return terms.join(labels.where(self.valid(F.col("label"))).select("term"), "term", "left_anti")


TASKS = {
    t.name: t
    for t in (
        LabellingTask("technology", "Is this term a technology?", ("y", "n", "?")),
        LabellingTask("category", "Which role does this term have?", ("a", "c", "t", "x")),
        LabellingTask("polarity", "Is more of this good, bad or neither?", ("p", "n", "o")),
        LabellingTask("maturity", "How mature is this technology?", ("0", "1", "2")),
    )
}
