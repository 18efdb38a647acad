"""Expressions over the typed blocks (nodes) of an extracted document."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NODES = "array<struct<type:string,level:int,text:string,language:string,tab_label:string,ordered:boolean,items:array<string>,rows:array<array<string>>>>"


def heading_path(nodes: Column, index: Column) -> Column:
    """Texts of the headings above the node at ``index``: a heading of level n keeps the first n - 1."""
    return F.aggregate(
        F.slice(nodes, 1, index),
        F.array().cast("array<string>"),
        lambda path, n: F.when((n["type"] == "heading") & n["text"].isNotNull(), F.concat(F.slice(path, 1, F.greatest(F.coalesce(n["level"], F.lit(1)) - 1, F.lit(0))), F.array(n["text"]))).otherwise(path),
    )


def table_text(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ", "")), "\n")


def node_units(node: Column, marks: bool = False) -> Column:
    """Units of a node: the text of a paragraph or code, each item of a list, a table as a whole.
    With ``marks`` list items carry their number or bullet."""
    none = F.array().cast("array<string>")
    items = F.coalesce(node["items"], none)
    if marks:
        items = F.transform(items, lambda x, i: F.concat(F.when(node["ordered"], F.concat((i + 1).cast("string"), F.lit(". "))).otherwise("• "), x))
    kind = node["type"]
    return (
        F.when(kind.isin("paragraph", "code"), F.array(node["text"]))
        .when(kind == "list", items)
        .when(kind == "table", F.array(table_text(node["rows"])))
        .otherwise(none)
    )


def markdown(nodes: Column) -> Column:
    """Nodes as markdown: headings, fenced code with its tab label, pipe tables, lists."""

    def row(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | ", ""), F.lit(" |"))

    def block(n: Column) -> Column:
        kind, table = n["type"], n["rows"]
        label = F.when(F.length(n["tab_label"]) > 0, F.concat(F.lit("**"), n["tab_label"], F.lit("**\n\n"))).otherwise("")
        ruled = F.concat(F.array(row(F.get(table, F.lit(0))), row(F.transform(F.get(table, F.lit(0)), lambda _: F.lit("---")))), F.transform(F.slice(table, 2, F.greatest(F.size(table) - 1, F.lit(0))), row))
        return (
            F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), n["level"]), F.lit(" "), n["text"]))
            .when(kind == "paragraph", n["text"])
            .when(kind == "code", F.concat(label, F.lit("```"), F.coalesce(n["language"], F.lit("")), F.lit("\n"), n["text"], F.lit("\n```")))
            .when((kind == "table") & (F.size(table) > 0), F.array_join(ruled, "\n"))
            .when(kind == "list", F.array_join(node_units(n, marks=True), "\n"))
        )

    shown = F.filter(F.transform(nodes, block), lambda x: x.isNotNull())
    return F.concat(F.trim(F.array_join(shown, "\n\n"), F.lit(" \n\t\r")), F.lit("\n"))
