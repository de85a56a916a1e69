"""Keys and object paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def docset_key(document_ids: Column) -> Column:
    """Key of a document set that does not depend on the order of its ids."""
    texts = F.array_sort(F.transform(document_ids, lambda x: x.cast("string")))
    return F.substring(F.sha2(F.array_join(texts, "|"), 256), 1, 12)


def document_part(document_ids: Column, document_id: Column) -> Column:
    """The document part of a cache key: set key, else the single id, else ``none``."""
    return (
        F.when(F.size(document_ids) > 0, docset_key(document_ids))
        .otherwise(F.coalesce(document_id.cast("string"), F.lit("none")))
    )


def cache_key(user_id: Column, doc_part: Column, style: Column, question: Column) -> Column:
    digest = F.sha2(strip(F.lower(question)), 256)
    return F.concat_ws(":", F.lit("cache"), user_id.cast("string"), doc_part, style, digest)


def content_hash(content: Column) -> Column:
    return F.md5(content)


def chunk_key(document_id: Column, position: Column, content: Column) -> Column:
    """Id of a passage that is the same in every replay of its document."""
    return F.sha2(F.concat_ws("|", document_id.cast("string"), position.cast("string"), F.md5(content)), 256)


def object_key(user_id: Column, document_id: Column, filename: Column) -> Column:
    return F.concat_ws("/", F.lit("uploads"), user_id.cast("string"), document_id.cast("string"), filename)


def object_key_parts(key: Column) -> dict[str, Column]:
    parts = F.split(key, "/")
    return {
        "user_id": F.get(parts, 1),
        "document_id": F.get(parts, 2),
        "filename": F.get(parts, 3),
    }


def audio_key(url: Column) -> Column:
    """Object key of an audio URL, NULL for any other URL."""
    path = F.regexp_replace(F.try_parse_url(url, F.lit("PATH")), "^/+", "")
    return F.when(path.startswith("audio/"), path)
