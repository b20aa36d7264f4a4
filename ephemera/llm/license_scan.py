"""License scans: sparse TF-IDF cosine of headers and licence files to templates, nearest-ancestor inheritance.

Lines are compared with short statements; whole files and windows of them with licence texts and standard notices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ephemera.llm.common import checkpointed, lower_ascii, spread_left_join, stored
from ephemera.llm.license_texts import TIERS, Windows, license_texts

#: Short statements by which texts name their licence; parameters of the scan.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use are permitted under the 3-Clause BSD License.",
    "MPL-2.0": "This file is subject to the terms of the Mozilla Public License, version 2.0.",
    "CC-BY-4.0": "Licensed under a Creative Commons Attribution licence, CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}
_HEADER = "(?i)licen[sc]e|copyright|public domain|all rights reserved|redistribution"
THRESHOLD = 0.6
WHOLE = 0.9  # cosine from which on a text is a licence statement and little else
MAX_HEADER = 400  # characters; longer lines, and statements that go over lines, are searched in windows
_SEARCHED = _HEADER + "|permission"  # texts searched in windows


def _tokens(c: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(c), "[^a-z0-9]+"), "")


def _weights(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, token, weight): unit TF-IDF vectors of the templates; as many rows as the templates have words."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    tf = rows.select("license", F.explode(_tokens(F.col("text"))).alias("token")).groupBy("license", "token").agg(F.count("*").alias("tf"))
    idf = tf.groupBy("token").agg((F.log((1.0 + len(templates)) / (1.0 + F.count("*"))) + 1.0).alias("idf"))
    w = tf.join(idf, "token").withColumn("w", F.col("tf") * F.col("idf"))
    norm = w.groupBy("license").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "license").select("license", "token", "idf", (F.col("w") / F.col("norm")).alias("weight"))


def template_cosines(lines: DataFrame, key: list[str], text_col: str, templates: dict[str, str]) -> DataFrame:
    """``key``, license and cosine of each text with each template that shares a token with it.

    Tokens outside the templates only lengthen a text's vector, with the weight of a token in no template.
    """
    weights = checkpointed(_weights(lines.sparkSession, templates))
    rare = math.log(1.0 + len(templates)) + 1.0
    tf = lines.select(*key, F.explode(_tokens(F.col(text_col))).alias("token")).groupBy(*key, "token").agg(F.count("*").alias("tf"))
    idf = weights.select("token", "idf").distinct()
    tf = tf.join(F.broadcast(idf), "token", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(rare)))  # the templates' words
    norm = tf.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = tf.join(F.broadcast(weights.drop("idf")), "token").groupBy(*key, "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    return dots.join(norm, key).select(*key, "license", (F.col("dot") / F.col("norm")).alias("cosine"))


def _search(shared):
    """Licence texts and notices in the whole text and its windows, else statements in windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, statements = shared.value
        for b in batches:
            out = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                hit = texts.best(text) or statements.best(text)
                if hit:
                    out.append((key, hit[0] != "statement", hit[1], hit[2], hit[2] >= WHOLE and hit[3] >= WHOLE))
            columns = [[x[k] for x in out] for k in range(5)]
            kinds = (pa.int64(), pa.bool_(), pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "full", "named", "score", "all"])

    return run


def scan_licenses(
    files: DataFrame, path: Column, text_col: str = "text", id_col: str = "doc_id", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """(doc_id, path, license, cosine, origin) for every row of ``files``.

    Header lines (with a word such as "licence" or "copyright") are compared with the templates; the best cosine of
    ``threshold`` or more names the licence (origin 'header').  A licence text or standard notice (``license_texts``)
    anywhere in a text of any length comes before that; a statement in a longer line, or over several, after it.  A file whose whole text reaches WHOLE, or
    whose base name is LICENSE, LICENCE or COPYING and that has a licence, is a licence file of its directory.
    Files without a licence take that of the nearest ancestor directory that has a licence file (origin
    'inherited'; of several the most frequent, then the first by name), else license is null and origin 'none'.

    Null text has no licence of its own; a null path inherits nothing; repeated rows are scanned alike; ties in
    cosine go to the first licence by name; an empty table gives an empty result.
    """
    key = F.xxhash64(F.col(id_col).cast("string"), path, F.col(text_col))
    rows = files.select(F.col(id_col).alias("doc_id"), path.alias("path"), F.col(text_col).alias("text"), key.alias("key"))
    # one row for each different row: a key's copies have one result
    lines = rows.where(F.col("text").rlike(_HEADER)).select("key", "text").dropDuplicates(["key"])
    headers = lines.select("key", F.explode(F.filter(F.split("text", "\n"), lambda x: x.rlike(_HEADER) & (F.char_length(x) <= MAX_HEADER))).alias("line"))
    headers = headers.dropDuplicates(["key", "line"]).withColumn("part", F.xxhash64("line"))
    found = template_cosines(headers, ["key", "part"], "line", templates)
    best = found.groupBy("key").agg(F.max(F.struct(F.round("cosine", 9).alias("c"), _before("license"))).alias("b"))
    own = best.where(F.col("b.c") >= threshold).select("key", _name("b").alias("license"), F.col("b.c").alias("cosine"))
    # a text is a licence file on its own if little else is in it: only texts as short as headers can be
    short = lines.join(own.select("key"), "key", "left_semi").where(F.char_length("text") <= 10 * MAX_HEADER)
    whole = template_cosines(short, ["key"], "text", templates).where(F.col("cosine") >= WHOLE).select("key").distinct().withColumn("whole", F.lit(True))
    own = own.join(whole, "key", "left").withColumn("whole", F.coalesce("whole", F.lit(False)))
    shared = rows.sparkSession.sparkContext.broadcast((Windows(license_texts(), TIERS), Windows([("statement", *x) for x in sorted(templates.items())], {"statement": threshold})))
    searched = rows.where(F.col("text").rlike(_SEARCHED)).select("key", "text").dropDuplicates(["key"])
    searched = searched.mapInArrow(_search(shared), "key long, full boolean, named string, score double, all boolean")
    first = F.coalesce("full", F.lit(False)) | F.col("license").isNull()
    own = own.join(searched, "key", "full_outer").select(
        "key",
        F.when(first, F.col("named")).otherwise(F.col("license")).alias("license"),
        F.when(first, F.col("score")).otherwise(F.col("cosine")).alias("cosine"),
        (F.coalesce("whole", F.lit(False)) | F.coalesce(first & F.col("all"), F.lit(False))).alias("whole"),
    )
    own = checkpointed(own)
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    named = stored(rows.select("doc_id", "path", "key").join(own, "key", "left").withColumn("own", folder))
    is_file = F.col("whole") | F.col("path").rlike("(?i)(^|/)(licen[sc]e|copying)(\\.[a-z]+)?$")
    of_folder = named.where(F.col("license").isNotNull() & F.coalesce(is_file, F.lit(False))).groupBy(folder.alias("folder"), "license").agg(F.count("*").alias("n"))
    of_folder = of_folder.groupBy("folder").agg(F.max(F.struct("n", _before("license"))).alias("b")).select("folder", _name("b").alias("theirs"))
    # a folder and its ancestors, nearest first
    folders = named.where(F.col("license").isNull() & F.col("path").isNotNull()).select("own").distinct()
    up = folders.select("own", F.split("own", "/").alias("p")).select("own", F.explode(F.sequence(F.lit(0), F.size("p"))).alias("depth"), "p")
    up = up.select("own", "depth", F.when(F.col("depth") == 0, "").otherwise(F.array_join(F.slice("p", F.lit(1), F.col("depth")), "/")).alias("folder"))
    nearest = checkpointed(up.join(of_folder, "folder").groupBy("own").agg(F.max_by("theirs", "depth").alias("theirs")))
    out = spread_left_join(named, nearest, "own")
    inherits = F.col("license").isNull() & F.col("theirs").isNotNull()
    return out.select(
        "doc_id",
        "path",
        F.coalesce("license", "theirs").alias("license"),
        "cosine",
        F.when(F.col("license").isNotNull(), "header").when(inherits, "inherited").otherwise("none").alias("origin"),
    )


#: Licence names are ASCII; in this reversed alphabet the first name is the largest, so one max() settles ties.
_UP = "".join(chr(c) for c in range(33, 127))
_DOWN = _UP[::-1]


def _before(c: str) -> Column:
    return F.translate(F.col(c), _UP, _DOWN).alias("before")


def _name(b: str) -> Column:
    return F.translate(F.col(f"{b}.before"), _DOWN, _UP)
