"""Classes, reading-order indices and labels of regions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EVAL_ALIASES, LABEL_NAMES, LABEL_RANK, LABELS, REDUCED

# Fixed patterns of the page format's `custom` attribute.
ORDER_AND_CLASS = r"readingOrder \{index:(.+?);\} structure \{type:(.+?);\}"
CLASS = r"structure \{type:(.+?);\}"
GREEDY_CLASS = r"\{type:(.*);\}"
ORDER = r"readingOrder\s*\{index:(\d+);\}"


def _map(of: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in of.items() for x in kv])


def region_class(custom: Column, kind: Column) -> Column:
    """The class where order and structure are both given; else image for image elements and UnknownRegion for others."""
    found = F.regexp_extract(custom, ORDER_AND_CLASS, 2)
    other = F.when(kind.isin("ImageRegion", "GraphicRegion"), "image").otherwise("UnknownRegion")
    return F.when(F.coalesce(found, F.lit("")) != "", found).otherwise(other)


def class_tag(custom: Column) -> Column:
    """The class alone, null where there is none."""
    return F.nullif(F.regexp_extract(custom, CLASS, 1), F.lit(""))


def eval_tag(custom: Column) -> Column:
    """The class up to the last `;}`, articles as paragraphs."""
    tag = F.nullif(F.regexp_extract(custom, GREEDY_CLASS, 1), F.lit(""))
    return F.when(tag.isin("article", "article_"), "paragraph").otherwise(tag)


def order_index(custom: Column) -> Column:
    """The reading-order index, -1 where there is none."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(custom, F.lit(ORDER), F.lit(1)), F.lit(1)).cast("int"), F.lit(-1))


def label_of(name: Column) -> Column:
    """A class's label; unknown classes share label 1."""
    return F.coalesce(F.try_element_at(_map(LABELS), name), F.lit(1))


def label_rank(label: Column) -> Column:
    return F.try_element_at(_map(LABEL_RANK), label)


def draw_rank(label: Column) -> Column:
    """In which order labels are drawn: as they first appear in the vocabulary; 0 for no label."""
    return F.array_position(F.array(*[F.lit(v) for v in dict.fromkeys(LABELS.values()) if v]), label)


def label_name(label: Column) -> Column:
    return F.when(label == 0, "UnknownRegion").otherwise(F.get(F.array(*[F.lit(x) for x in LABEL_NAMES]), label - 1))


def alias_of(name: Column) -> Column:
    return F.try_element_at(_map(EVAL_ALIASES), name)


def reduced(label: Column) -> Column:
    """Labels with merged classes."""
    out = label
    for to, of in REDUCED.items():
        out = F.when(label.isin(of), F.lit(to)).otherwise(out)
    return out


def reduced_scores(scores: Column, classes: int = 10) -> Column:
    """Class scores with the merged classes' added to their target's and set to 0."""
    gone = {c: to for to, of in REDUCED.items() for c in of}
    at = lambda i: F.get(scores, F.lit(i)).cast("double")
    out = []
    for i in range(classes):
        total = F.lit(0.0) if i in gone else at(i)
        for c, to in gone.items():
            if to == i:
                total = total + at(c)
        out.append(total)
    return F.array(*out)


def decided(scores: Column, threshold: float) -> Column:
    """The first highest class; 0 where its score is below the threshold."""
    top = F.array_max(scores)
    return F.when(top < threshold, F.lit(0)).otherwise((F.array_position(scores, top) - 1).cast("int"))


def uncertain(scores: Column, target: Column, threshold: float) -> Column:
    """1 where the target class's score is below the threshold."""
    return (F.get(scores, target) < threshold).cast("int")


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, v: a + v))


def without_scaling_errors(label: Column, most: int = 9, padding: int = 255) -> Column:
    return F.when(label > most, F.lit(padding)).otherwise(label)
