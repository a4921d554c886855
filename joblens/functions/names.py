"""Store names, file names and download headers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: characters that may not appear in a store name.
UNSAFE_CHARACTERS = '/\\?%*:|"<>'


def store_name(provider: Column, video_id: Column) -> Column:
    """Dedup key of a video. Null when either part is null."""
    name = F.concat(provider, F.lit("-"), video_id)
    return F.translate(name, UNSAFE_CHARACTERS, "_" * len(UNSAFE_CHARACTERS))


def strip_id(file_name: Column, video_id: Column) -> Column:
    """Remove every literal '-<id>' from a file name."""
    return F.replace(file_name, F.concat(F.lit("-"), video_id), F.lit(""))


def content_disposition(file_name: Column) -> Column:
    """Download header: plain for ASCII names, otherwise both the plain and the UTF-8 form."""
    encoded = F.replace(F.url_encode(file_name), F.lit("+"), F.lit("%20"))
    is_ascii = F.octet_length(file_name) == F.char_length(file_name)
    return F.when(
        is_ascii, F.concat(F.lit('attachment; filename="'), file_name, F.lit('"'))
    ).otherwise(
        F.concat(
            F.lit('attachment; filename="'), encoded, F.lit("\"; filename*=utf8''"), encoded
        )
    )


def hex16(number: Column) -> Column:
    return F.lpad(F.lower(F.hex(number)), 16, "0")


def utf8(raw: Column) -> Column:
    """Bytes or text as valid UTF-8, malformed bytes replaced."""
    return F.make_valid_utf8(raw.cast("string"))
