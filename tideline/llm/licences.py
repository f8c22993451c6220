"""Operator 5: licence scans by canonical digests.

A text is normalised (lower case, copyright and title lines left out, everything but letters and digits
as one space, equivalent spellings made one) and its digest joined to those of known licences.
The whole text is looked up, and every line of it as a text of its own, since documents carry
one-line notices.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.licence_texts import LICENCES, NOTICES, OPENING, SPELLINGS, more_licences, more_notices

#: Lines of this form name a holder and a year and differ from copy to copy. A body line that a wrap
#: starts with "copyright holder", "copyright notice" or "(c) You must" is none of them.
COPYRIGHT_LINE = (
    r"^[^\p{L}\p{N}]*(copyright[^\p{L}\p{N}]*(\(c\)|©|<year>|\[?yyyy|(19|20)\d\d|by )"
    r"|copyright (?!treaty).*\b(19|20)\d\d\b|\(c\)[^\p{L}\p{N}]*(copyright|(19|20)\d\d)|©).*"
    r"|^[^\p{L}\p{N}]*all rights reserved[^\p{L}\p{N}]*$"
)
#: Lines that are a title of one of the short licences, which copies have or lack.
TITLE_LINE = (
    r"^[^\p{L}\p{N}]*(the )?(mit|expat|isc|zlib|zlib/libpng|(new |modified |simplified )?bsd"
    r"|bsd[- ][23][- ]clause)([^\p{L}\p{N}]*(new|revised|simplified|or))*[^\p{L}\p{N}]*licen[cs]e"
    r"([^\p{L}\p{N}]*(mit|isc|zlib|bsd[- ][23][- ]clause))?[^\p{L}\p{N}]*$"
)


def canonical(text: Column) -> Column:
    """The normalised form; null for null."""
    left_out = F.lit(f"{COPYRIGHT_LINE}|{TITLE_LINE}")
    lines = F.filter(F.split(F.lower(text), "\n"), lambda line: ~F.rlike(line, left_out))
    plain = F.concat(F.lit(" "), F.regexp_replace(F.array_join(lines, " "), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for found, one in SPELLINGS:
        plain = F.replace(plain, F.lit(f" {found} "), F.lit(f" {one} "))
    return F.trim(F.regexp_replace(plain, " +", " "))


def _key(plain: Column) -> Column:
    """The digest by which a normalised text or line is looked up: openings of notices are made one."""
    return F.md5(F.regexp_replace(plain, OPENING, "licensed under ").cast("binary"))


def all_licences() -> tuple[tuple[str, str], ...]:
    """(identifier, text) of every licence and notice that the package knows."""
    return (*LICENCES, *NOTICES, *more_licences(), *more_notices())


def known_licences(spark: SparkSession, texts: tuple[tuple[str, str], ...] = LICENCES + NOTICES) -> DataFrame:
    """(digest, licence): one row per distinct normalised text, the smallest name for equal ones."""
    names, bodies = zip(*texts, strict=True) if texts else ((), ())
    # From Arrow the rows are part of the plan; a list of rows would start Python on every executor.
    rows = spark.createDataFrame(pa.table({"licence": pa.array(names, pa.string()), "text": pa.array(bodies, pa.string())}))
    digests = rows.select(_key(canonical(F.col("text"))).alias("digest"), "licence")
    return digests.groupBy("digest").agg(F.min("licence").alias("licence"))


def scan_licences(
    docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, digest, licence, notices, notice_lines) for every row.

    ``licence`` is that of the whole text or null, ``notices`` the sorted distinct licences
    of its lines, ``notice_lines`` how many lines matched. Null texts have no digest;
    texts and lines that normalise to nothing match nothing. Null ids and repeated rows are
    scanned like others, each row for itself; an empty table gives no rows; other columns
    are not read. Only digests leave a task, and rows of a document are combined there.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        canonical(text).alias("plain"),
        text.alias("text"),
    )
    rows = rows.select("row", "id", "text", F.md5(F.col("plain").cast("binary")).alias("whole"), _key(F.col("plain")).alias("key"))
    lines = F.split("text", "\n")
    rows = rows.select("row", "id", "whole", "key", F.posexplode_outer(F.concat(F.array("text"), lines)).alias("at", "part"))
    digest = F.when(F.col("at") == 0, F.col("key")).otherwise(_key(canonical(F.col("part"))))
    nothing = F.md5(F.lit("").cast("binary"))
    parts = rows.select("row", "id", "whole", "at", F.when(digest != nothing, digest).alias("digest"))
    found = parts.join(known, "digest", "left")
    line = F.when((F.col("at") > 0), F.col("licence"))
    grouped = found.groupBy("row", "id", "whole").agg(
        F.max(F.when(F.col("at") == 0, F.col("licence"))).alias("licence"),
        F.sort_array(F.collect_set(line)).alias("notices"),
        F.count(line).alias("notice_lines"),
    )
    return grouped.select(F.col("id").alias(id_col), F.col("whole").alias("digest"), "licence", "notices", "notice_lines")
