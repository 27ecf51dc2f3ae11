"""Numbers that exactly one of several writers gets, from nothing but a shared folder.

A claim is a folder with one file, put in place by a rename.  Of two renames to one
name the second either fails or lands inside the first one's folder, so whoever
finds its own file at the top has the number.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from zealmark.sources.files import filesystem, hadoop_path

FILE, DIGITS = "claim.json", 12


def _folder(root: str, number: int) -> str:
    return f"{root}/{number:0{DIGITS}d}"


def _read(spark: SparkSession, folder: str) -> dict:
    stream = filesystem(spark, folder).open(hadoop_path(spark, f"{folder}/{FILE}"))
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def claim(spark: SparkSession, root: str, number: int, text: str = "") -> bool:
    """Put ``text`` in place as ``number`` under ``root`` unless somebody has; whether it was us."""
    fs, owner = filesystem(spark, root), uuid.uuid4().hex
    draft = f"{root}/_draft-{owner}"
    fs.mkdirs(hadoop_path(spark, draft))
    stream = fs.create(hadoop_path(spark, f"{draft}/{FILE}"), True)
    try:
        stream.write(bytearray(json.dumps({"owner": owner, "text": text}).encode()))
    finally:
        stream.close()
    place = _folder(root, number)
    if not fs.exists(hadoop_path(spark, place)):
        fs.rename(hadoop_path(spark, draft), hadoop_path(spark, place))
    won = _read(spark, place)["owner"] == owner
    if not won:
        # where the rename found the folder of another writer
        for lost in (draft, f"{place}/_draft-{owner}"):
            fs.delete(hadoop_path(spark, lost), True)
    return won


def claimed(spark: SparkSession, root: str) -> list[int]:
    """Numbers that are taken."""
    fs, folder = filesystem(spark, root), hadoop_path(spark, root)
    if not fs.exists(folder):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return [int(name) for name in names if name.isdigit()]


def read_text(spark: SparkSession, root: str, number: int) -> str:
    return _read(spark, _folder(root, number))["text"]


def claim_next(spark: SparkSession, root: str, first: int = 1, text: str = "") -> int:
    """The least number above all claimed ones that nobody else gets."""
    number = max(claimed(spark, root), default=first - 1) + 1
    while not claim(spark, root, number, text):
        number += 1
    return number


def drop_claims(spark: SparkSession, root: str, upto: int) -> None:
    """Delete the claims up to ``upto``; the newest must stay, as new numbers follow from it."""
    for number in claimed(spark, root):
        if number <= upto:
            filesystem(spark, root).delete(hadoop_path(spark, _folder(root, number)), True)
