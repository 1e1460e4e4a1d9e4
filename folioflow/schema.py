"""Fixed vocabularies of page annotations."""

from __future__ import annotations

# Class names, their labels in drawing order, element names and thresholds of the page format.
LABELS = {
    "TextLine": 0,
    "advertisement": 0,
    "UnknownRegion": 0,
    "image": 8,
    "Image": 8,
    "inverted_text": 9,
    "caption": 1,
    "table": 2,
    "article": 3,
    "article_": 3,
    "paragraph": 3,
    "heading": 4,
    "header": 5,
    "separator_vertical": 6,
    "separator_short": 7,
    "separator_horizontal": 7,
}
LABEL_NAMES = ["caption", "table", "paragraph", "heading", "header", "separator_vertical", "separator_horizontal", "image", "inverted_text"]
ELEMENTS = {
    "UnknownRegion": "UnknownRegion",
    "caption": "TextRegion",
    "table": "TableRegion",
    "paragraph": "TextRegion",
    "heading": "TextRegion",
    "header": "TextRegion",
    "separator_vertical": "SeparatorRegion",
    "separator_horizontal": "SeparatorRegion",
    "image": "GraphicRegion",
    "inverted_text": "TextRegion",
}
VALID_TAGS = ["paragraph", "caption", "heading", "header", "image", "table", "inverted_text", "separator_vertical", "separator_horizontal", "UnknownRegion"]
TEXT_CLASSES = ["heading", "header", "article_", "caption", "paragraph", "inverted_text"]
REDUCED = {3: [1, 5], 0: [8, 9]}
PADDING_LABEL = 255
YOLO_LABELS = {"caption": 0, "table": 1, "article": 2, "article_": 2, "paragraph": 2, "heading": 3, "header": 4, "image": 5, "Image": 5, "inverted_text": 6}
YOLO_NAMES = ["caption", "table", "article", "heading", "header", "image", "inverted_text"]
EVAL_ALIASES = {
    "article": "paragraph",
    "inverted_text": "inverted_text",
    "paragraph": "paragraph",
    "caption": "caption",
    "heading": "heading",
    "header": "header",
    "Image": "image",
    "image": "image",
    "newspaper_header": "header",
    "headline": "heading",
    "table": "table",
}
REGION_KINDS = ["TextRegion", "SeparatorRegion", "ImageRegion", "GraphicRegion", "TableRegion"]
SPECIALS = ["<PAD>", "<START>", "<NAN>", "<END>"]
#: Order in which a page's regions are numbered: label 1 first, then the labels as they appear above.
LABEL_RANK = {label: rank for rank, label in enumerate(dict.fromkeys([1, *(v for v in LABELS.values() if v)]))}
