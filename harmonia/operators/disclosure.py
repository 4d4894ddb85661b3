"""Small cells of published counts: hidden below a threshold, with others so that no margin gives them away."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harmonia.session import written

NO_NAME = "(none)"


def hide_small_cells(records: DataFrame, row: str, column: str, k: int) -> DataFrame:
    """``row_name, column_name, n, suppressed, reason`` for every cell of a table of counts whose margins are published.

    ``n`` is NULL where a cell is hidden: ``small`` for one to ``k - 1`` records,
    ``complementary`` for cells hidden with them.  Cells without records are 0.

    A hidden cell follows from the margins exactly if, with rows and columns as
    nodes and hidden cells as edges, its edge lies on no cycle.  So rows are taken
    together in groups of two or more, and all rows of a group hide the same two
    or more columns: every hidden cell is then a corner of a rectangle of hidden
    cells.

    1. Rows with the same small cells are a group.
    2. Of the rows left over, those with the same first small cell are one.
    3. What is left then, at most one row a column, is one group; a single row
       takes the other row with the fewest records as its partner.

    A group with one column also hides the column with the fewest records in its
    rows.  Ties go by name; NULL is named NO_NAME.  A table with small cells needs
    two rows and two columns.  Margins are published as they are: categories that
    are small altogether should be merged before.
    """

    def name(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(NO_NAME))

    held = written(records.groupBy(name(row).alias("r"), name(column).alias("c")).agg(F.count("*").alias("n")))
    rows, columns = held.groupBy("r").agg(F.sum("n").alias("total")), held.select("c").distinct()
    # A published table: every pair of categories is a row of the result.
    cells = written(
        rows.crossJoin(columns).join(held, ["r", "c"], "left").select("r", "c", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "total")
    )
    small = cells.where((F.col("n") > 0) & (F.col("n") < k))
    if not small.isEmpty() and min(rows.count(), columns.count()) < 2:
        raise ValueError("a table with small cells needs two rows and two columns")
    hidden = _hidden(_groups(small, rows), cells)
    is_small = (F.col("n") > 0) & (F.col("n") < k)
    marked = cells.join(hidden.withColumn("hides", F.lit(True)), ["r", "c"], "left")
    suppressed = F.coalesce("hides", F.lit(False))
    return marked.select(
        F.col("r").alias("row_name"), F.col("c").alias("column_name"), F.when(~suppressed, F.col("n")).alias("n"), suppressed.alias("suppressed"),
        F.when(is_small, "small").when(suppressed, "complementary").alias("reason"),
    )


def _groups(small: DataFrame, rows: DataFrame) -> DataFrame:
    """(group, r, columns): rows that hide their columns together; at least two rows a group."""
    patterns = written(small.groupBy("r").agg(F.array_sort(F.collect_set("c")).alias("columns")))
    alike = patterns.withColumn("same", F.count("*").over(Window.partitionBy("columns")))
    first = F.element_at("columns", 1)
    of_pattern = alike.where("same > 1").select(F.struct(F.lit(1).alias("step"), F.array_join("columns", "\u0001").alias("by")).alias("group"), "r", "columns")
    left = alike.where("same = 1").withColumn("same", F.count("*").over(Window.partitionBy(first)))
    of_first = left.where("same > 1").select(F.struct(F.lit(2).alias("step"), first.alias("by")).alias("group"), "r", "columns")
    rest = left.where("same = 1").select(F.struct(F.lit(3).alias("step"), F.lit("").alias("by")).alias("group"), "r", "columns")
    # At most one row a column is left; a single one takes a partner.
    alone = rest.agg(F.first("r").alias("alone"), F.count("*").alias("m")).where("m = 1")
    partner = rows.join(F.broadcast(alone), F.col("r") != F.col("alone")).agg(F.min(F.struct("total", "r")).alias("least")).where("least IS NOT NULL")
    partner = partner.select(
        F.struct(F.lit(3).alias("step"), F.lit("").alias("by")).alias("group"), F.col("least.r").alias("r"), F.array().cast("array<string>").alias("columns")
    )
    return of_pattern.unionByName(of_first).unionByName(rest).unionByName(partner)


def _hidden(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """(r, c) of every hidden cell."""
    groups = written(groups)
    shown = groups.select("group", F.explode("columns").alias("c")).distinct()
    narrow = shown.groupBy("group").agg(F.count("*").alias("m"), F.first("c").alias("own")).where("m = 1").select("group", "own")
    more = (
        groups.join(narrow, "group").join(cells, "r").where("c <> own").groupBy("group", "c").agg(F.sum("n").alias("n"))
        .groupBy("group").agg(F.min(F.struct("n", "c")).alias("least")).select("group", F.col("least.c").alias("c"))
    )
    return groups.select("group", "r").join(shown.unionByName(more), "group").select("r", "c").distinct()
