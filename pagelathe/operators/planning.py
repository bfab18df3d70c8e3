"""Section contracts, the order in which sections are put together, and the imports that join them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelathe.functions.text import pascal
from pagelathe.operators.logs import lookup

# Places of section types on a page; others stand in the middle.
TYPE_ORDER = {"header": 0, "navigation": 1, "hero": 2, "features": 3, "about": 4, "footer": 10}
OTHER = 5


def namespace(name: Column) -> Column:
    """A section's namespace: lower case, blanks and dashes to underscores."""
    return F.lower(F.regexp_replace(F.trim(name), r"[\s-]+", "_"))


def component(name: Column) -> Column:
    """A section's component name."""
    return F.concat(pascal(name), F.lit("Section"))


def contracts(sections: DataFrame) -> DataFrame:
    """What each section (page_id, section_id, name, type, n_images, n_links) must deliver; unknown types are generic."""
    kind = F.when(F.col("type").isin(*TYPE_ORDER), F.col("type")).otherwise("generic")
    return sections.select("page_id", "section_id", namespace(F.col("name")).alias("namespace"), component(F.col("name")).alias("component"), kind.alias("type"), F.coalesce("n_images", F.lit(0)).alias("min_images"), F.coalesce("n_links", F.lit(0)).alias("min_links"))


def integration_plan(made: DataFrame) -> DataFrame:
    """Contracts in the order of a page, each after the one before it."""
    w = Window.partitionBy("page_id").orderBy(lookup(F.col("type"), TYPE_ORDER, OTHER), "section_id")
    before = F.lag("namespace").over(w)
    return made.select("page_id", "section_id", "component", F.row_number().over(w).alias("place"), F.when(before.isNull(), "start").otherwise(F.concat(F.lit("after:"), before)).alias("position"))


def imports(files: DataFrame) -> DataFrame:
    """Import lines of the section components among the files, by namespace, the part of the path after 'sections'."""
    name = F.regexp_extract("path", r"([^/]+Section)\.jsx$", 1)
    parts = F.split("path", "/")
    at = F.try_element_at(parts, (F.array_position(parts, "sections") + 1).cast("int"))
    rows = files.where(F.col("path").rlike(r"Section\.jsx$")).select(at.alias("namespace"), name.alias("component"), "path")
    line = F.concat(F.lit("import "), F.col("component"), F.lit(" from '."), F.regexp_replace("path", r"^/?src", ""), F.lit("';"))
    return rows.select("namespace", "component", line.alias("line"))


def matched(wanted: DataFrame, layout: DataFrame) -> DataFrame:
    """Each wanted section with the layout section of the same name: exact, else lower case, else with blanks as underscores; only empty fields are filled."""
    keys = (F.col("name"), F.lower("name"), F.lower(F.replace("name", F.lit(" "), F.lit("_"))))
    out = wanted.withColumns({f"_k{i}": k for i, k in enumerate(keys)})
    for i in range(3):
        side = layout.select(F.col("name").alias(f"_k{i}"), F.col("y").alias(f"_y{i}"))
        out = out.join(side, f"_k{i}", "left")
    return out.withColumn("y", F.coalesce("y", "_y0", "_y1", "_y2")).drop(*(f"_{c}{i}" for c in "ky" for i in range(3)))


def accepted(code: Column, min_images: Column, min_links: Column) -> Column:
    """Whether code has the images, the links and the export that its contract asks for."""
    return (F.regexp_count(code, F.lit('src="http')) >= min_images) & (F.regexp_count(code, F.lit('href="')) >= min_links) & code.contains("export default")
