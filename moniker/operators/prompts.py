"""What a model is asked: the text by stage as a column, and the tools it may call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import lookup
from ..functions.toolcalls import WITH_ALTERNATIVES
from ..schema import SCRIPTS

SCRIPT_NAMES = {
    "la": "Latin", "cy": "Cyrillic", "gk": "Greek", "ab": "Arabic", "cn": "Chinese", "jp": "Japanese", "kr": "Korean",
    "dv": "Devanagari", "hb": "Hebrew", "th": "Thai", "gg": "Georgian", "am": "Armenian",
}

_TASKS = {
    "extract": "Take the given and family name of one person out of the text, or say that it names no person.",
    "transliterate": "Write the name as it sounds in each script asked for.",
    "alternatives": "List other established Latin spellings of the name, if there are any.",
    "judge": "Name the scripts in which this company name is likely to be written.",
    "audit": "Say whether the name is clean, give the corrected one, or say that it cannot be recovered.",
}
#: Task by the first word of a stage.
_OF = {"transliterate": "transliterate", "transcribe": "transliterate", "company": "transliterate"} | {s: s for s in _TASKS}


def prompt(stage: Column, label: Column, tags: Column, attempt: Column, rejected: Column | None = None) -> Column:
    """Text of a request; scripts asked for (array) and forms that were rejected (map of tag to texts) are listed."""
    task = lookup({k: _TASKS[v] for k, v in _OF.items()}, F.substring_index(stage, "_", 1))
    listed = F.array_join(F.transform(tags, lambda t: F.concat(t, F.lit(" ("), lookup(SCRIPT_NAMES, t), F.lit(")"))), ", ")
    parts = [F.coalesce(task, F.lit("")), F.concat(F.lit("Name: "), label), F.when(F.size(tags) > 0, F.concat(F.lit("Scripts: "), listed))]
    if rejected is not None:
        bad = F.filter(F.flatten(F.transform(tags, lambda t: F.coalesce(rejected[t], F.array().cast("array<string>")))), lambda v: v != "")
        parts.append(F.when(F.size(bad) > 0, F.concat(F.lit("Not usable, in another script or of another name: "), F.array_join(bad, ", "))))
    parts.append(F.when(attempt > 0, F.lit("Answer with one tool call and nothing else.")))
    return F.concat_ws("\n", *parts)


def prompted(asks: DataFrame) -> DataFrame:
    """``asks`` (stage, key, attempt and, where known, label, tags, rejected) with prompt."""
    has = set(asks.columns)
    label = F.col("label") if "label" in has else F.col("key")
    tags = F.col("tags") if "tags" in has else F.array().cast("array<string>")
    return asks.withColumn("prompt", prompt(F.col("stage"), label, tags, F.col("attempt"), F.col("rejected") if "rejected" in has else None))


def script_tool(tags: tuple[str, ...] = SCRIPTS[1:], alternatives: int = 2) -> dict:
    """Schema of the call that gives forms by script: the tags are required, second forms are optional."""
    properties: dict[str, dict] = {t: {"type": "string", "description": f"The name in {SCRIPT_NAMES[t]} script"} for t in tags}
    if "jp" in tags:
        properties["jp_kana"] = {"type": "string", "description": "A second Japanese form in kana, or empty"}
    for t in tags:
        if t in WITH_ALTERNATIVES:
            properties[f"{t}_alt"] = {"type": "array", "items": {"type": "string"}, "description": f"At most {alternatives} other spellings in use"}
    return {"type": "function", "function": {"name": "emit_scripts", "description": _TASKS["transliterate"], "parameters": {"type": "object", "properties": properties, "required": list(tags)}}}
