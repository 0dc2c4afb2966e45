"""Names: datasets, models, files, tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed


def last_part(name: Column, separator: str = "/") -> Column:
    """What follows the last separator; the whole name when there is none."""
    return F.substring_index(name, separator, -1)


def dataset_dir(name: Column) -> Column:
    """Local directory name of a dataset."""
    return last_part(name)


def formatted_name(name: Column, union: bool = False) -> Column:
    """Output directory name of a prepared dataset, or of its union output."""
    flat = F.concat(F.replace(name, F.lit("/"), F.lit("_")), F.lit(fixed.FORMATTED_SUFFIX))
    return F.concat(F.lit(fixed.UNION_PREFIX), flat) if union else flat


def formatted_path(root: str, name: str, union: bool = False) -> str:
    """The same rule for one name known on the driver."""
    prefix = fixed.UNION_PREFIX if union else ""
    return f"{root.rstrip('/')}/{prefix}{name.replace('/', '_')}{fixed.FORMATTED_SUFFIX}"


def checkpoint_name(model: Column) -> Column:
    """Directory name of a model: own models lose their path, others are flattened."""
    own = F.array_contains(F.split(model, "/"), "custom_models")
    name = F.when(own, last_part(model)).otherwise(model)
    name = F.when(name.contains("custom_models"), last_part(name, "\\")).otherwise(name)
    return F.replace(name, F.lit("/"), F.lit("_"))


def media_kind(path: Column) -> Column:
    """image, audio, or null, by the file extension."""
    extension = F.lower(last_part(path, "."))
    return F.when(extension.isin(*fixed.IMAGE_EXTENSIONS), "image").when(
        extension.isin(*fixed.AUDIO_EXTENSIONS), "audio"
    )


def route_task(columns: Column, substring: bool = False) -> Column:
    """Training task for a dataset's recorded columns; images win over text.

    ``columns`` is ARRAY<STRING>; with ``substring`` it is the column set written
    as one text and any occurrence of the words counts.
    """
    if substring:
        vision, text = columns.contains("image"), columns.contains("conversations")
    else:
        vision = F.arrays_overlap(columns, F.array(F.lit("image"), F.lit("images")))
        text = F.array_contains(columns, "conversations")
    return F.when(vision, fixed.VISION_TASK).when(text, fixed.TEXT_TASK)
