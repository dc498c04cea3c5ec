"""Metadata as one text of tagged lines, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tag of each field, in order of the lines.
TAGS = (("t", "title"), ("a", "artist"), ("r", "release"), ("y", "year"))


def encode_metadata(metadata: Column | str) -> Column:
    """A line 'tag=text' for each field that is neither null nor empty; null for null metadata."""
    m = F.col(metadata) if isinstance(metadata, str) else metadata
    lines = [F.when(F.coalesce(m[field], F.lit("")) != "", F.concat(F.lit(f"{tag}="), m[field], F.lit("\n"))).otherwise("") for tag, field in TAGS]
    return F.when(m.isNotNull(), F.concat(*lines))


def parse_metadata(text: Column | str) -> Column:
    """The fields of the tagged lines: unknown lines are skipped, the last of equal tags counts, missing ones are empty."""
    s = F.col(text) if isinstance(text, str) else text
    lines = F.split(s, "\n", -1)

    def field(tag: str) -> Column:
        own = F.filter(lines, lambda x: F.substring(x, 1, 2) == f"{tag}=")
        return F.when(F.size(own) > 0, F.substring(F.element_at(own, -1), 3, 2147483647)).otherwise("")

    return F.when(s.isNotNull(), F.struct(*(field(tag).alias(name) for tag, name in TAGS)))
