"""Work identifiers, paths and slugs.

A canonical identifier is collection letters, volume, ``n`` and number (``T48n2005``); a
published one is publisher, dot and slug (``ws.some-work``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions.text import encoded

# Publishers of the second corpus, and the two forms of identifiers.
PUBLISHERS = ("ws", "pd", "ce", "mit")
CANONICAL = r"^[A-Za-z]{1,3}\d{1,4}n[A-Za-z]?\d{1,5}[A-Za-z]?$"
PUBLISHED = r"(?i)^(?:ws|pd|ce|mit)\.[A-Za-z0-9][A-Za-z0-9-]*$"

#: Names of the corpora in results.
KINDS = ("canonical", "published", "unknown")


def _slashes(path: Column) -> Column:
    return F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))


def _parts(path: Column) -> Column:
    return F.filter(F.split(_slashes(path), "/"), lambda x: x != "")


def corpus_of_id(file_id: Column) -> Column:
    return F.when(file_id.rlike(PUBLISHED), F.lit(KINDS[1])).when(file_id.rlike(CANONICAL), F.lit(KINDS[0])).otherwise(F.lit(KINDS[2]))


def corpus_of_path(path: Column) -> Column:
    """By publisher folder, else by the form of the file name."""
    parts = _parts(path)
    stem = F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")), r"^(.+)\.[^.]*$", "$1")
    first = F.lower(F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("")))
    return F.when(first.isin(*PUBLISHERS), F.lit(KINDS[1])).when(stem.rlike(CANONICAL), F.lit(KINDS[0])).otherwise(F.lit(KINDS[2]))


def id_of_path(path: Column) -> Column:
    """publisher.slug in the second corpus, else the file name without .xml."""
    parts = _parts(path)
    name = F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")), r"(?i)\.xml$", "")
    return F.when((corpus_of_path(path) == KINDS[1]) & (F.size(parts) >= 2), F.concat_ws(".", F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2)))).otherwise(name)


def stem_of_path(path: Column) -> Column:
    """The file name without .xml, whatever the corpus."""
    return F.regexp_replace(F.coalesce(F.try_element_at(F.split(_slashes(path), "/"), F.lit(-1)), F.lit("")), r"(?i)\.xml$", "")


def path_of_id(file_id: Column) -> Column:
    """collection/volume/id.xml or publisher/slug/slug.xml; null for other identifiers."""
    volume = F.regexp_extract(file_id, r"^([^n]+)n", 1)
    letters = F.regexp_replace(volume, "[0-9]", "")
    slug = F.regexp_extract(file_id, r"^[^.]+\.(.+)$", 1)
    publisher = F.regexp_extract(file_id, r"^([^.]+)\.", 1)
    return (
        F.when(corpus_of_id(file_id) == KINDS[1], F.concat(publisher, F.lit("/"), slug, F.lit("/"), slug, F.lit(".xml")))
        .when((corpus_of_id(file_id) == KINDS[0]) & (letters != ""), F.concat(letters, F.lit("/"), volume, F.lit("/"), file_id, F.lit(".xml")))
    )


def joined_url(base: str, path: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(path, "^/+", ""))


def same_work(path: Column, file_id: Column) -> Column:
    """Whether a path, however much of it is written, names the work's file."""
    low = F.lower(_slashes(path))
    name = F.concat(F.lower(file_id), F.lit(".xml"))
    short = F.concat(F.lower(F.regexp_extract(file_id, r"^[^.]+\.(.+)$", 1)), F.lit(".xml"))
    slug = F.when(corpus_of_id(file_id) == KINDS[1], (low == short) | low.endswith(F.concat(F.lit("/"), short))).otherwise(F.lit(False))
    return F.coalesce((low == name) | low.endswith(F.concat(F.lit("/"), name)) | slug, F.lit(False))


def slug(name: Column, form: str = "spaces") -> Column:
    """Slugs of names. ``spaces``: blanks as _. ``shard``: also lower case, no quotes. ``page``: no apostrophe, runs of blanks as one _."""
    if form == "spaces":
        return F.replace(name, F.lit(" "), F.lit("_"))
    if form == "shard":
        return F.regexp_replace(F.lower(F.replace(name, F.lit(" "), F.lit("_"))), "['\"’]", "")
    return F.regexp_replace(F.replace(name, F.lit("'"), F.lit("")), r"\s+", "_")


def first_codepoint_bucket(c: Column, buckets: int = 201) -> Column:
    """Bucket of the first character, by code point."""
    return F.ascii(F.substring(c, 1, 1)) % buckets


def work_url(file_id: Column, bases: dict[str, str], user: Column | None = None) -> Column:
    """Address of a work's file under the base of its corpus (by KINDS), in a user's folder if one is given.

    Null where the identifier has no path, the corpus no base, or the user is empty.
    """
    base = F.lit(None).cast("string")
    for kind, b in bases.items():
        base = F.when(corpus_of_id(file_id) == kind, F.lit(b.rstrip("/") + "/")).otherwise(base)
    folder = F.lit("") if user is None else F.when(user != "", F.concat(encoded(user), F.lit("/")))
    return F.concat(base, folder, path_of_id(file_id))
