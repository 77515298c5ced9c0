"""Sets of outputs that are published as one: readers see the whole former set or the whole new one.

Below a root, ``versions`` holds a folder for each attempt and ``published`` an empty file for each version that is
complete.  That file is made last, by one operation that is atomic in any store, and the version that is current is the last
one that has it.  An attempt that dies leaves a folder that nothing names.  No folder is ever written twice, so a job
that reads a version goes on reading it while the next one is published.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from ..functions.files import mark, names_in, remove


def published_versions(spark: SparkSession, root: str) -> list[str]:
    """Names of all complete versions, the current one last."""
    return names_in(spark, f"{root.rstrip('/')}/published")


def version_folder(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/versions/{name}"


def current_version(spark: SparkSession, root: str) -> str:
    """Folder of the current version."""
    names = published_versions(spark, root)
    if not names:
        raise FileNotFoundError(f"nothing is published in {root}")
    return version_folder(root, names[-1])


def publish_version(spark: SparkSession, root: str, write: Callable[[str], None]) -> str:
    """Let ``write`` fill a new folder and then make it the current version; returns the folder.

    If ``write`` raises, the former version stays current.  Of two writers at a time, the one that started later has
    the last word.
    """
    top = root.rstrip("/")
    taken = [*names_in(spark, f"{top}/versions"), *published_versions(spark, root)]
    number = 1 + max((int(n.partition("-")[0]) for n in taken), default=0)
    name = f"{number:010d}-{uuid.uuid4().hex}"
    write(version_folder(root, name))
    mark(spark, f"{top}/published/{name}")
    return version_folder(root, name)


def drop_versions(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove all but the last ``keep`` versions, and what failed attempts before those have left; the names removed."""
    if keep < 1:
        raise ValueError("the current version stays")
    names = published_versions(spark, root)
    if not names:
        return []
    kept = names[-keep:]
    # a version is no longer published before its files go
    for name in names[:-keep]:
        remove(spark, f"{root.rstrip('/')}/published/{name}")
    gone = [n for n in names_in(spark, f"{root.rstrip('/')}/versions") if n < kept[0]]
    for name in gone:
        remove(spark, version_folder(root, name))
    return gone
