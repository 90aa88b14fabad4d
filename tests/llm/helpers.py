"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, score double, fp bigint, kept boolean, root bigint, copies int"


def rows(*texts, start=0):
    return [(start + i, t, "en", f"s{i % 3}", 1, 7, 0.5, 3, True, 9, 4) for i, t in enumerate(texts)]


def odd(spark, extra=()):
    """Documents with everything odd at once; columns clash with names that operators use."""
    long = "word " * 60000 + "end"
    data = rows("Plain text here.", None, "", "   ", "Plain text here.", long, long, "\u0001\u0000 x", "ÀÉ ßtraße 日本 \U0001F642 ok", "123 456 ...")
    data += [(4, "Plain text here.", "en", "s1", 1, 7, 0.5, 3, True, 9, 4)] * 2
    data += [(None, "no id", None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    data += list(extra)
    return spark.createDataFrame(data, SCHEMA), data


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
