"""The functions most used in SQL text, as temporary SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..schema import SCRIPTS
from .base import SPACE
from .names import _ONE, DIGRAPHS, INITIALISM, PLAIN_LETTERS
from .variants import ENTITY_TOKENS


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _replaced(column: str, table: dict[str, str]) -> str:
    for a, b in table.items():
        column = f"replace({column}, {_quoted(a)}, {_quoted(b)})"
    return column


def _functions() -> dict[str, tuple[str, str, str]]:
    strip = lambda x: f"regexp_replace({x}, {_quoted(f'(?U)^{SPACE}+|{SPACE}+$')}, '')"
    words = lambda x: f"filter(split({strip(x)}, {_quoted(f'(?U){SPACE}+')}), t -> t <> '')"
    initial = lambda x: f"({strip(x)} rlike {_quoted('^\\p{L}$')} OR {strip(x)} rlike {_quoted(INITIALISM)})"
    marks = f"translate(x, {_quoted(''.join(_ONE))}, {_quoted(''.join(_ONE.values()))})"
    marks = _replaced(f"regexp_replace({marks}, {_quoted('\\p{Mn}')}, '')", PLAIN_LETTERS)
    entity = ", ".join(map(_quoted, ENTITY_TOKENS))
    cell = _quoted("(?s)^(?:" + "|".join(SCRIPTS) + r")\{.+\}$")
    return {
        "canonical_key": ("x STRING", "STRING", f"array_join(filter(split(regexp_replace(lower(x), '[^a-z0-9]+', ' '), ' '), t -> t <> '' AND t NOT IN ({entity})), ' ')"),
        "name_words": ("x STRING", "ARRAY<STRING>", words("x")),
        "is_initial": ("x STRING", "BOOLEAN", initial("x")),
        "is_usable_name": ("given STRING, family STRING", "BOOLEAN", f"exists({words('given')}, w -> NOT {initial('w')}) AND exists({words('family')}, w -> NOT {initial('w')})"),
        "strip_diacritics": ("x STRING", "STRING", marks),
        "written_out": ("x STRING", "STRING", f"strip_diacritics({_replaced('x', DIGRAPHS)})"),
        "cluster_is_valid": ("line STRING", "BOOLEAN", f"forall(split(line, '\\t'), c -> c rlike {cell}) AND exists(split(line, '\\t'), c -> startswith(c, 'la'))"),
    }


def register(spark: SparkSession) -> list[str]:
    """Create the functions; their names."""
    made = _functions()
    for name, (arguments, kind, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return list(made)
