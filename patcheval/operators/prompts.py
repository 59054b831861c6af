"""Prompts for model calls, as columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patcheval import constants as C

STYLES = ("default", "minimal", "detailed", "chat")


@dataclass(frozen=True)
class PromptTexts:
    """The wording of the prompts; pass your own to change it. ``{problem}`` and ``{context}`` in
    ``user`` and ``minimal`` are where the texts of an instance go, once each, in this order."""

    system: str = (
        "You fix defects and add features in a large code base.\n"
        "Read the problem, find its cause, and answer with one unified diff that `git apply` takes.\n"
        "Keep the change small, keep the style of the file, and use the paths of the repository.\n"
        "Put the diff into a ```diff block and write nothing outside of it.\n"
    )
    user: str = (
        "## Problem Statement\n\n{problem}\n\n## Relevant Code Context\n\n{context}\n\n"
        "## Instructions\n\nAnswer with a unified diff in a ```diff block.\n"
    )
    minimal: str = (
        "## Problem Statement\n\n{problem}\n\n## Instructions\n\nAnswer with a unified diff in a ```diff block.\n"
    )
    example: str = (
        "```diff\n--- a/src/area.ts\n+++ b/src/area.ts\n@@ -1,1 +1,1 @@\n"
        "-export const area = (w, h) => w + h;\n+export const area = (w, h) => w * h;\n```"
    )
    example_heading: str = "\n\n## Example Patch Format\n\n"
    extra_heading: str = "\n\n## Additional Instructions\n\n"
    chat_separator: str = "\n\n---\n\n"
    no_context: str = field(default=C.NO_CONTEXT)


def _filled(template: str, problem: Column, context: Column) -> Column:
    """The template with its two places filled. Inserted text is never looked at again, so it may
    itself contain braces."""
    before, rest = template.split("{problem}", 1)
    middle, sep, after = rest.partition("{context}")
    parts = [F.lit(before), problem, F.lit(middle)]
    return F.concat(*parts, context, F.lit(after)) if sep else F.concat(*parts)


def build_prompts(
    instances: DataFrame,
    style: str | Column = "default",
    problem: str = "problem_statement",
    context: str | None = "code_context",
    extra: str | None = None,
    texts: PromptTexts = PromptTexts(),
) -> DataFrame:
    """Adds ``system`` and ``user``. ``style`` is one of STYLES or a column of them; an unknown
    style is an error. Style chat has no system text and takes no extra instructions."""
    if isinstance(style, str):
        if style not in STYLES:
            raise ValueError(f"Unknown prompt style: {style}. Use one of {', '.join(STYLES)}.")
        style = F.lit(style)
    statement = F.coalesce(F.col(problem), F.lit(""))
    given = F.col(context) if context else F.lit(None).cast("string")
    shown = F.when(F.length(given) > 0, given).otherwise(F.lit(texts.no_context))
    user = _filled(texts.user, statement, shown)
    more = F.lit("")
    if extra:
        more = F.when(F.length(extra) > 0, F.concat(F.lit(texts.extra_heading), F.col(extra))).otherwise(more)
    system_text = F.lit(texts.system)
    return instances.withColumns(
        {
            "user": F.when(style == "default", F.concat(user, more))
            .when(style == "minimal", F.concat(_filled(texts.minimal, statement, shown), more))
            .when(style == "detailed", F.concat(user, F.lit(texts.example_heading + texts.example), more))
            .when(style == "chat", F.concat(system_text, F.lit(texts.chat_separator), user))
            .otherwise(F.raise_error(F.concat(F.lit("Unknown prompt style: "), style))),
            "system": F.when(style == "chat", F.lit("")).otherwise(system_text),
        }
    )


def as_messages(prompts: DataFrame) -> DataFrame:
    """Adds ``messages`` array<struct<role, content>>; an empty system text is left out."""

    def message(role, content):
        return F.struct(F.lit(role).alias("role"), F.col(content).alias("content"))

    parts = F.array(F.when(F.length("system") > 0, message("system", "system")), message("user", "user"))
    return prompts.withColumn("messages", F.filter(parts, lambda m: m.isNotNull()))


def as_system_and_messages(prompts: DataFrame) -> DataFrame:
    """Adds ``request`` struct<system, messages>, with the system text kept apart even if empty."""
    user = F.struct(F.lit("user").alias("role"), F.col("user").alias("content"))
    return prompts.withColumn("request", F.struct(F.col("system"), F.array(user).alias("messages")))
