"""The text functions under names that SQL can call: temporary functions whose bodies are SQL, without Python."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import html, text

#: Name: parameters with their types, the type of the result, and the Column of the parameters that it is.
FUNCTIONS: dict[str, tuple[str, str, Callable[..., Column]]] = {
    "normalize_text": ("text STRING", "STRING", text.normalize_text),
    "normalize_name": ("name STRING", "STRING", text.normalize_name),
    "normalize_address": ("address STRING", "STRING", text.normalize_address),
    "normalize_tel": ("tel STRING", "STRING", text.normalize_tel),
    "extract_pref": ("text STRING", "STRING", text.extract_pref),
    "extract_city": ("address STRING, pref STRING", "STRING", text.extract_city),
    "clean_address": ("address STRING", "STRING", text.clean_address),
    "extract_address": ("text STRING, pref STRING", "STRING", text.extract_address),
    "extract_tel": ("text STRING", "STRING", text.extract_tel),
    "extract_open_date": ("text STRING, year INT", "STRING", text.extract_open_date),
    "extract_genre": ("text STRING, title STRING", "STRING", text.extract_genre),
    "extract_store_name": ("title STRING", "STRING", text.extract_store_name),
    "extract_station": ("text STRING", "STRING", text.extract_station),
    "is_opening_article": ("title STRING, content STRING", "BOOLEAN", text.is_opening_article),
    "is_food_opening": ("title STRING, content STRING", "BOOLEAN", text.is_food_opening),
    "is_chain_store": ("name STRING", "BOOLEAN", text.is_chain),
    "strip_html": ("html STRING", "STRING", html.strip_html),
    "first_image": ("html STRING", "STRING", html.first_image),
}

_QUOTED = re.compile(r"('(?:\\.|[^'\\])*')", re.DOTALL)
_OPERATOR = re.compile(r"(?<![\w`])(<=>|>=|<=|==|!=|[-+*/%!<>=&|^~]|and|or|not)\(")


def body(column: Column) -> str:
    """A Column as SQL that parses. Operators come as calls of functions with their names, which SQL wants quoted."""
    parts = _QUOTED.split(column._jc.node().sql())
    return "".join(p if k % 2 else _OPERATOR.sub(r"`\1`(", p) for k, p in enumerate(parts))


def register(spark: SparkSession) -> list[str]:
    """Make FUNCTIONS known to ``spark.sql`` for this session, in place of functions of these names; their names."""
    for name, (parameters, result, function) in FUNCTIONS.items():
        given = [F.col(p.split()[0]) for p in parameters.split(", ")]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body(function(*given))}")
    return list(FUNCTIONS)
