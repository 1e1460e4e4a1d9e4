"""Region tables: numbering, columns, dividers and sections of a page, as windows.

Regions: page, ord, label, minx, miny, maxx, maxy. One shuffle by page serves all windows of an operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.layout import label_rank



def _by():  # a window needs a session, so not at import
    return Window.partitionBy("page")


def numbered(regions: DataFrame) -> DataFrame:
    """regions with id: places from 0 in label groups; regions without a label leave."""
    known = regions.withColumn("__rank", label_rank(F.col("label"))).where("__rank IS NOT NULL")
    return known.withColumn("id", F.row_number().over(_by().orderBy("__rank", "ord")) - 1).drop("__rank")


def properties(regions: DataFrame) -> DataFrame:
    """numbered regions with width, height, meanx, meany."""
    out = numbered(regions)
    mid = lambda a, b: (F.col(a).cast("double") + F.col(b)) / 2
    size = lambda a, b: (F.col(b) - F.col(a)).cast("double")
    return out.withColumns({"width": size("minx", "maxx"), "height": size("miny", "maxy"), "meanx": mid("minx", "maxx"), "meany": mid("miny", "maxy")})


def in_columns(props: DataFrame) -> DataFrame:
    """props with x_median (the middle width of tables and paragraphs, else 1), n_columns and cols, the region's width in columns. Rounding is half to even."""
    median = F.coalesce(F.median(F.when(F.col("label").isin(2, 3), F.col("width"))).over(_by()), F.lit(1.0))
    out = props.withColumns({"x_median": median, "page_minx": F.min("minx").over(_by()), "page_maxx": F.max("maxx").over(_by())})
    per = lambda w: F.when(F.col("x_median") > 0, F.bround(w / F.col("x_median"))).otherwise(F.lit(0.0))
    return out.withColumns({"n_columns": per(F.col("page_maxx") - F.col("page_minx")).cast("int"), "cols": per(F.col("maxx").cast("double") - F.col("minx")).cast("int")})


def global_divider() -> Column:
    return (F.col("label") == 7) & (F.col("cols") >= F.col("n_columns"))


def local_divider() -> Column:
    return F.col("label").isin(4, 7) & (F.col("cols") > 1) & (F.col("cols") < F.col("n_columns"))


def with_dividers(cols: DataFrame) -> DataFrame:
    return cols.withColumns({"is_global": global_divider(), "is_local": local_divider() & ~global_divider()})


def sectioned(divided: DataFrame) -> DataFrame:
    """divided with section: how many global dividers lie strictly above. A divider follows the section it ends; equal ones in falling order of place."""
    here = F.col("is_global").cast("int")
    upto = F.sum(here).over(_by().orderBy("meany").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.sum(here).over(Window.partitionBy("page", "meany"))
    return divided.withColumn("section", (upto - same).cast("int"))
