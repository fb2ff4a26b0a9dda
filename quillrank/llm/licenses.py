"""Licence scans by canonical digests: normalise, digest, and hash-join with the digests of known texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from ..sizing import lookup_join

# Known licence notices and texts.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        'IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
        "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",
    ),
]
# Spellings that count as equal, after lower-casing and removal of punctuation.
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"),
]
# Fixed value: what begins a copyright line, after lower-casing, in SQL.
COPYRIGHT_LINE = r"^[^a-z0-9]*(copyright|\(c\)|©)"
# Fixed values, after lower-casing: words after "copyright" in wrapped text of licences, where the line is none of a holder; titles.
WRAPPED_LINE = (
    r"^[^a-z0-9]*copyright[\x20\t]+(notices?|owners?|holders?|licen[cs]es?|law|laws|disclaimer|interest|treaty|statement|permission|and|or|on|in|is|as|to|"
    r"the[\x20\t]+(program|software|library|work))([^a-z0-9]|$)(?!.*[0-9]{4})"
)
TITLE_LINE = r"^[^a-z0-9]*(the[\x20\t]+)?(mit|expat|isc)[\x20\t]+licen[cs]e([\x20\t]*\((mit|expat|isc)\))?[^a-z0-9]*$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical_line(line: Column) -> Column:
    """Lower-cased words of a line with one space between them, in canonical spelling."""
    words = F.concat(F.lit(" "), F.regexp_replace(line, "[^a-z0-9]+", " "), F.lit(" "))
    for other, usual in SPELLINGS:
        words = F.replace(words, F.lit(f" {other} "), F.lit(f" {usual} "))
    return F.trim(F.regexp_replace(words, " +", " "))


def canonical_lines(text: Column) -> Column:
    """Canonical lines of a text without its copyright lines, titles and empty lines.

    A line that a wrapped licence goes on in, after the word copyright, is no copyright line.
    """
    lines = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "\n")
    kept = F.filter(lines, lambda x: (~x.rlike(COPYRIGHT_LINE) | x.rlike(WRAPPED_LINE)) & ~x.rlike(TITLE_LINE))
    return F.filter(F.transform(kept, canonical_line), lambda x: x != "")


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """``(digest, license)`` of the known texts."""
    texts = spark.createDataFrame(known, "license string, text string")
    whole = F.array_join(canonical_lines(F.col("text")), " ")
    return texts.select(F.sha2(whole, 256).alias("digest"), "license", F.length(whole).alias("size")).dropDuplicates(["digest"])


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, license, n_license_lines, line_licenses)``, one row per row of ``docs``.

    ``license`` is the licence that the entire text is, after normalisation. Lines that are an entire known
    notice are counted, and the licences they name are listed in order, joined by commas. A line that is longer
    than every known text can't be one and is not digested.

    Null and empty texts have no licence. Null ids and repeated rows are documents like others. An empty table
    gives no rows; other columns are not looked at.
    """
    known = materialize(known or known_digests(docs.sparkSession), "licences")
    longest = known.agg(F.max("size")).first()[0] or 0
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("key"), canonical_lines(F.col(text_col)).alias("lines"))
    short = F.filter("lines", lambda x: F.length(x) <= longest)
    whole = F.when(F.aggregate("lines", F.lit(0), lambda n, x: n + F.length(x) + 1) <= longest + 1, F.array_join("lines", " "))
    units = F.concat(F.transform(short, lambda x: F.struct(x.alias("text"), F.lit(False).alias("whole"))), F.when(whole.isNotNull() & (whole != ""), F.array(F.struct(whole.alias("text"), F.lit(True).alias("whole")))).otherwise(F.array().cast("array<struct<text:string,whole:boolean>>")))
    units = rows.select("key", F.posexplode(units).alias("at", "unit")).select("key", "at", F.sha2("unit.text", 256).alias("digest"), "unit.whole")
    hits = lookup_join(units, known.drop("size"), "digest", spread_on="key")
    line = ~F.col("whole")
    found = hits.groupBy("key").agg(  # the places are a set, as rows may be repeated
        F.max(F.when(F.col("whole"), F.col("license"))).alias("license"),
        F.size(F.collect_set(F.when(line, F.col("at")))).alias("n_license_lines"),
        F.array_join(F.array_sort(F.collect_set(F.when(line, F.col("license")))), ",").alias("line_licenses"),
    )
    ids = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("key"))
    out = lookup_join(ids, materialize(found, "found"), "key", "left", spread_on="doc_id")
    return out.select("doc_id", "license", F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"), F.coalesce("line_licenses", F.lit("")).alias("line_licenses"))


def scan_sql(table: str, known: list[tuple[str, str]] = KNOWN) -> str:
    """The scan as SQL of another engine, over a table whose ``doc_id`` is unique."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    line = "' ' || regexp_replace(x, '[^a-z0-9]+', ' ', 'g') || ' '"
    for other, usual in SPELLINGS:
        line = f"replace({line}, ' {other} ', ' {usual} ')"
    line = f"trim(regexp_replace({line}, ' +', ' ', 'g'))"
    split = f"string_split(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), chr(10))"
    kept = f"list_filter({split}, lambda x: NOT regexp_matches(x, {quoted(COPYRIGHT_LINE)}))"
    lines = f"list_filter(list_transform({kept}, lambda x: {line}), lambda x: x != '')"
    values = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in known)
    return f"""
        WITH known AS (SELECT license, array_to_string({lines}, ' ') AS body FROM (VALUES {values}) AS k(license, text)),
        docs AS (SELECT doc_id, {lines} AS lines FROM {table}),
        per_line AS (
            SELECT d.doc_id, count(*) AS n, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS names
            FROM (SELECT doc_id, unnest(lines) AS body FROM docs) d JOIN known k USING (body) GROUP BY d.doc_id)
        SELECT d.doc_id, k.license, coalesce(p.n, 0) AS n_license_lines, coalesce(p.names, '') AS line_licenses
        FROM docs d LEFT JOIN known k ON array_to_string(d.lines, ' ') = k.body LEFT JOIN per_line p ON p.doc_id = d.doc_id"""
