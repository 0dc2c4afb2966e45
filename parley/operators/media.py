"""Media: from the references in a table to files in a listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import media_kind
from .skew import splittable

# Where a file of the wanted name is looked for, in order.
PLACES = ("top", "folder", "zip")


def _references(df: DataFrame, media_col: str) -> Column:
    """ARRAY<STRUCT<ref, inside>> of a media column: where each medium is.

    A column holds one medium or a list of them. A medium is a reference, its bytes, or a
    struct with bytes and path; with bytes it is in the table (``inside``) and needs no file.
    """
    kind = df.schema[media_col].dataType
    column = F.col(f"`{media_col}`")
    if not isinstance(kind, T.ArrayType):
        kind, column = T.ArrayType(kind), F.when(column.isNotNull(), F.array(column))
    element = kind.elementType

    def place(medium: Column) -> Column:
        if isinstance(element, T.BinaryType):
            ref, inside = F.lit(None).cast("string"), medium.isNotNull()
        elif isinstance(element, T.StructType):
            names = element.fieldNames()
            ref = medium["path"] if "path" in names else F.lit(None).cast("string")
            inside = medium["bytes"].isNotNull() if "bytes" in names else F.lit(False)
            ref = F.when(~inside, ref)
        else:
            ref, inside = medium.cast("string"), F.lit(False)
        return F.struct(ref.alias("ref"), inside.alias("inside"))

    return F.transform(column, place)


def has_media(df: DataFrame, media_col: str) -> Column:
    """Whether a media column names or holds anything."""
    there = F.filter(_references(df, media_col), lambda m: m["inside"] | m["ref"].isNotNull())
    return F.coalesce(F.size(there) > 0, F.lit(False))


def explode_media(df: DataFrame, id_cols: str | list[str], media_col: str) -> DataFrame:
    """(ids, pos, ref): one row per reference; the column holds one or a list.

    Media whose bytes are in the table refer to no file and have no row.
    """
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    refs = df.select(*ids, F.posexplode(_references(df, media_col)).alias("pos", "_medium"))
    return refs.select(*ids, "pos", F.col("_medium.ref").alias("ref")).where(F.col("ref").isNotNull())


def resolve_media(refs: DataFrame, listing: DataFrame, how: str = "inner") -> DataFrame:
    """Add (place, path, kind) of the file each ``ref`` names.

    ``listing`` has (place, path, name). Of several files of one name the first
    place wins, then the first path. The listing is reduced to one row per name
    before the join, so the join never multiplies rows, and a name that many rows
    refer to is split by adaptive execution.
    """
    order = F.lit(len(PLACES))
    for i, place in enumerate(PLACES):
        order = F.when(F.col("place") == place, i).otherwise(order)
    best = (
        listing.where(F.col("place").isin(*PLACES))
        .groupBy(F.col("name").alias("ref"), splittable("name"))
        .agg(F.min(F.struct(order.alias("order"), "path", "place")).alias("_file"))
    )
    return refs.join(best, "ref", how).select(
        *refs.columns,
        F.col("_file.place").alias("place"),
        F.col("_file.path").alias("path"),
        media_kind(F.col("_file.path")).alias("kind"),
    )


def pair_media(df: DataFrame, id_cols: str | list[str], resolved: DataFrame) -> DataFrame:
    """Conversations next to their readable images, one row per image, matched by id."""
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    images = resolved.where(F.col("kind") == "image").select(
        *ids, "pos", F.col("path").alias("image")
    )
    return df.join(images, ids)


def pair_media_grouped(
    df: DataFrame,
    id_cols: str | list[str],
    resolved: DataFrame,
    message_col: str | None = None,
    messages: str = "conversations",
) -> DataFrame:
    """Conversations next to their readable images, one row per conversation.

    ``images`` has one array for each message, in order of ``pos``: what ``render_chat``
    takes. ``message_col`` of ``resolved`` names the message (from 0) an image belongs to;
    without it, where it is null and where there is no such message, that is the first
    message of the user, or the first one. Images come together before the join, so a
    conversation moves once; all that meet in a row came out of one row. Conversations
    without a readable image are dropped, as by ``pair_media``.
    """
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    message = F.lit(None) if message_col is None else F.col(f"`{message_col}`")
    images = resolved.where(F.col("kind") == "image").select(
        *ids, message.cast("int").alias("_message"), F.struct("pos", F.col("path").alias("image")).alias("_image")
    )
    of_message = images.groupBy(*ids, "_message").agg(F.collect_list("_image").alias("_images"))
    grouped = of_message.groupBy(*ids, splittable(*ids)).agg(
        F.collect_list(F.struct("_message", "_images")).alias("_media")
    )
    talk = F.col(f"`{messages}`")
    user = F.array_position(F.transform(talk, lambda m: m["role"]), "user").cast("int") - 1
    asked = F.when(user >= 0, user).otherwise(0)

    def of(position: Column) -> Column:
        there = F.col("_media._message")
        own = F.filter(
            "_media",
            lambda g: F.when(g["_message"].between(0, F.size(talk) - 1), g["_message"]).otherwise(F.col("_asked"))
            == position,
        )
        some = F.array_contains(F.transform(there, lambda m: F.coalesce(m, F.lit(-1))), position)
        listed = F.transform(F.array_sort(F.flatten(own["_images"])), lambda i: i["image"])
        return F.when(some | (position == F.col("_asked")), listed).otherwise(F.array().cast("array<string>"))

    joined = df.join(grouped.drop("_follows"), ids).withColumn("_asked", asked)
    return joined.withColumn("images", F.transform(talk, lambda m, i: of(i))).drop("_media", "_asked")


def keep_readable(
    df: DataFrame,
    id_cols: str | list[str],
    media_cols: list[str],
    listing: DataFrame,
    require: str = "all",
) -> DataFrame:
    """Rows with a media column that can be read.

    A column can be read when ``require`` ("all" or "any") of its media are in the table or
    name an image file of the listing. Whether a file exists does not depend on which of
    several is taken, so names are enough here. A single column of single references is
    one semi join; otherwise the media of all columns are looked up together, in one pass
    over ids and references, and decided per row.
    """
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    names = (
        listing.where(F.col("place").isin(*PLACES))
        .select(F.col("name").alias("ref"), splittable("name"))
        .distinct()
        .select("ref")
    )
    if len(media_cols) == 1 and isinstance(df.schema[media_cols[0]].dataType, T.StringType):
        column = F.col(f"`{media_cols[0]}`")
        images = df.where(media_kind(column) == "image")
        return images.join(names, column == F.col("ref"), "left_semi")

    def of_column(name: str) -> Column:
        return F.transform(
            F.coalesce(_references(df, name), F.array()),
            lambda m: F.struct(F.lit(name).alias("column"), m["ref"].alias("ref"), m["inside"].alias("inside")),
        )

    media = F.flatten(F.array(*[of_column(c) for c in media_cols]))
    refs = df.select(*ids, F.explode(media).alias("_medium")).select(*ids, "_medium.*")
    found = refs.join(names.withColumn("_found", F.lit(True)), "ref", "left")
    is_image = F.col("_found").isNotNull() & (media_kind(F.col("ref")) == "image")
    good = F.col("inside") | F.coalesce(is_image, F.lit(False))
    agree = F.bool_and if require == "all" else F.bool_or
    decided = [F.coalesce(agree(F.when(F.col("column") == c, good)), F.lit(False)) for c in media_cols]
    readable = found.groupBy(*ids).agg(F.array_contains(F.array(*decided), True).alias("_readable"))
    return df.join(readable.where("_readable"), ids, "left_semi")
