"""Licence notices in documents, by Dice coefficient over word bigrams; DataFrame operations only.

Every line of a text, and the whole of a text of several lines, is normalised (A-Z lowered, all but
letters and digits of ASCII become spaces) and compared with normalised templates: twice the bigrams
both have, by the bigrams of each. A coefficient of t allows sizes of t / (2 - t) to (2 - t) / t times
the template's only, so a table of sizes and templates decides by an equality join which templates a
line meets; a line of any other size costs a count of its words.

Before that, texts and lines are looked through for anchors: words of a template that touch so many of
its bigrams that the others are too few for a match. What has no anchor of any template matches none.

Defined cases: null texts and lines of fewer than two words have no bigrams and match nothing;
repeated bigrams count once; equal templates each match; repeated rows give their rows each.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Short notices of common licences.
NOTICES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may'
    " not use this file except in compliance with the License.",
    "bsd-3-clause": "Use of this source code is governed by a BSD-style license that can be found"
    " in the LICENSE file.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International"
    " License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License,"
    " v. 2.0.",
}
PERCENT = 80

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _normal(text: str) -> str:
    return f"trim(regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' '))"


def _bigrams(words: str) -> str:
    """Distinct bigrams of an array of two words or more, which is evaluated once."""
    pairs = "transform(sequence(0, size(w) - 2), i -> concat(w[i], ' ', w[i + 1]))"
    return f"transform(array({words}), w -> array_distinct({pairs}))[0]"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def templates(spark: SparkSession, notices: dict[str, str], percent: int) -> DataFrame:
    """(n, licence, own, own_n): templates by the numbers of bigrams they can match."""
    rows = ", ".join(f"struct({_quoted(k)} as licence, {_quoted(v)} as t)" for k, v in notices.items())
    least = f"cast(ceil(own_n * {percent} / (200 - {percent})) as int)"
    most = f"cast(floor(own_n * (200 - {percent}) / {percent}) as int)"
    return (
        spark.range(1)
        .selectExpr(f"inline(array({rows}))")
        .selectExpr("licence", f"split({_normal('t')}, ' ') as w")
        .where("size(w) > 1")
        .selectExpr("licence", f"{_bigrams('w')} as own")
        .selectExpr("licence", "own", "size(own) as own_n")
        .selectExpr("*", f"explode(sequence({least}, {most})) as n")
    )


def anchors(notice: str, percent: int) -> set[str]:
    """Words, longest first, of which any text that matches ``notice`` has one."""
    low = notice.translate(str.maketrans(UPPER, LOWER))
    words = re.sub("[^a-z0-9]+", " ", low).strip().split(" ")
    left = set(zip(words, words[1:], strict=False))
    fewest = -(-len(left) * percent // (200 - percent))
    needed = -(-percent * (fewest + len(left)) // 200)
    found: set[str] = set()
    for word in sorted(set(words), key=lambda w: (-len(w), w)):
        if len(left) < needed:
            break
        found.add(word)
        left = {pair for pair in left if word not in pair}
    return found


def notices_found(
    documents: DataFrame, notices: dict[str, str] | None = None, percent: int = PERCENT
) -> DataFrame:
    """Per line of ``documents`` (doc_id, text) and licence it matches: doc_id, line (from 1; 0 is
    the whole text), licence, dice."""
    spark, notices = documents.sparkSession, NOTICES if notices is None else notices
    if not notices:
        return spark.sql(
            "select 0L as doc_id, 0 as line, '' as licence, 0D as dice where false"
        )
    table = templates(spark, notices, percent)
    # Words of a line that can match: repeated bigrams may make it longer, so only least is known.
    least = table.selectExpr("coalesce(min(n), 2147483647) as n").first().n
    words = sorted(set().union(*(anchors(notice, percent) for notice in notices.values())))
    has_anchor = f"rlike '(?i){'|'.join(words)}'"
    units = (
        documents.where(f"text {has_anchor}")
        .selectExpr("doc_id", "split(text, '\\\\n') as lines")
        .selectExpr(
            "doc_id",
            "posexplode(concat(array(if(size(lines) > 1, array_join(lines, ' '), '')), lines))"
            " as (line, t)",
        )
        .where(f"t {has_anchor}")
        .selectExpr("doc_id", "line", f"split({_normal('t')}, ' ') as w")
        .where(f"size(w) > {least}")
        .selectExpr("doc_id", "line", f"{_bigrams('w')} as found")
        .selectExpr("doc_id", "line", "found", "size(found) as n")
    )
    # Templates are a parameter of a few dozen short texts; Spark broadcasts such a table by itself.
    return (
        units.join(table, "n")
        .selectExpr("doc_id", "line", "licence", "n", "own_n", "size(array_intersect(found, own)) as b")
        .where(f"200 * b >= {percent} * (n + own_n)")
        .selectExpr("doc_id", "line", "licence", "2D * b / (n + own_n) as dice")
    )


def oracle_sql(notices: dict[str, str] | None = None, percent: int = PERCENT) -> str:
    """DuckDB's statement of the same, without the table of sizes."""

    def normal(text: str) -> str:
        low = f"translate({text}, '{UPPER}', '{LOWER}')"
        return f"trim(regexp_replace({low}, '[^a-z0-9]+', ' ', 'g'))"

    def bigrams(words: str) -> str:
        pairs = f"list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1])"
        return f"list_distinct({pairs})"

    rows = ", ".join(
        "('{}', '{}')".format(k, v.replace("'", "''")) for k, v in (notices or NOTICES).items()
    )
    return f"""
    with notices as (
      select licence, {bigrams("w")} as own
      from (select licence, string_split({normal("t")}, ' ') as w
            from (values {rows}) as v(licence, t))
    ), split as (
      select doc_id, string_split(text, chr(10)) as lines from documents where text is not null
    ), units as (
      select doc_id, i as line, lines[i] as t
      from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from split)
      union all
      select doc_id, 0, array_to_string(lines, ' ') from split where len(lines) > 1
    ), parts as (
      select doc_id, line, {bigrams("w")} as found
      from (select doc_id, line, string_split({normal("t")}, ' ') as w from units)
      where len(w) > 1
    ), met as (
      select doc_id, line, licence, len(found) + len(own) as n,
        len(list_intersect(found, own)) as b
      from parts, notices
      where {200 - percent} * len(found) >= {percent} * len(own)
        and {200 - percent} * len(own) >= {percent} * len(found)
    )
    select doc_id, cast(line as int) as line, licence, cast(2 * b as double) / n as dice
    from met where 200 * b >= {percent} * n
    """
