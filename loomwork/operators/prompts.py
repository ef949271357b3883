"""Prompts as Columns."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import MultipleSpec, NestedSpec, Spec, variables_text

TEMPLATE = """Read the passage below and report what it says about these fields:

{variables}

Passage:
{text}

Give a value for a field only if the passage states it; leave every other field empty."""
SYSTEM = "You turn passages into structured records and never invent values."
_SLOT = re.compile(r"\{(text|variables|context)\}")


def prompt(text: Column, spec: Spec, template: str = TEMPLATE, context: Mapping[str, object] | None = None) -> Column:
    """The prompt for each text. Slots are found in the template alone, so braces in texts and other braces in templates are just text."""
    if isinstance(spec, MultipleSpec):
        parts = [F.concat(F.lit(f"## {n.upper()}\n"), prompt(text, s, template, context)) for n, s in spec.specs]
        return F.concat_ws("\n\n", *parts)
    if isinstance(spec, NestedSpec):
        extra = "\n".join(": ".join(map(str, pair)) for pair in (context or {}).items())
    else:
        extra = str(dict(context)) if context else ""
    fill = {"variables": F.lit(variables_text(spec)), "context": F.lit(extra), "text": text}
    pieces = _SLOT.split(template)
    return F.concat(*[fill[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces) if i % 2 or p])
