"""Licence scan by canonical digest lookup, in DataFrame functions only (operator 4).

Method.  A text's canonical form is lower-cased, without copyright lines, with punctuation and white space as single spaces and with one
spelling for equivalent words.  The canonical whole text's SHA-256 is hash-joined to the digests of the known licences.  The known
digests are one row per licence text; Spark broadcasts them if they are as small as the built-in list, and shuffles (with split
skew) if a caller brings more.

Defined results: each row gives one row; ``license_id`` is null if the text is no known licence.  A null or empty text, or one without letters and
digits, has the empty canonical form and is no licence.  Repeated rows are scanned each.  Null ids are kept.  Licences with the same canonical
form count as the one with the smallest id.  Other columns are not read, whatever their names.  An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from replaylab.llm.license_texts import LICENSES

#: Lines that only say who holds the copyright, and the phrase that all rights are reserved.  (Clauses also begin with "(c)".)
COPYRIGHT_LINE = (r"(?:^|\n)[^a-z0-9\n]*(?:(?:portions )?copyright(?:[^a-z0-9\n]*[<\[{©]|[^a-z0-9\n]+(?:c\)|by |year|yyyy|[0-9]{4}))[^\n]*"
                  r"|©[^\n]*|\(c\)[^a-z0-9\n]+[0-9]{4}[^\n]*|all rights reserved[^a-z0-9\n]*)")
#: What isn't a letter or digit.
BETWEEN = r"[^\p{L}\p{N}]+"
#: Equivalent spellings, each with the one kept; they apply to lower-cased text with single spaces.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("cancelled", "canceled"), ("centre", "center"), ("copyright owner", "copyright holder"), ("emphasise", "emphasize"),
    ("favour", "favor"), ("fulfilment", "fulfillment"), ("honour", "honor"), ("https", "http"), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labelled", "labeled"), ("labour", "labor"), ("licence", "license"), ("licencing", "licensing"), ("merchantibility", "merchantability"),
    ("modelled", "modeled"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("organisation", "organization"),
    ("per cent", "percent"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("sub license", "sublicense"),
    ("utilisation", "utilization"), ("whilst", "while"),
)


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "\n")
    out = F.trim(F.regexp_replace(out, BETWEEN, " "))
    for other, kept in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(kept))
    return out


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license_id, text) of the built-in texts."""
    rows = F.array(*(F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in LICENSES))
    return spark.range(1).select(F.inline(rows))


def digests(known: DataFrame) -> DataFrame:
    """(digest, license_id) of licence texts (license_id, text), one row per canonical form."""
    forms = known.select(canonical(F.col("text")).alias("form"), "license_id").where("form != ''")
    return forms.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(df: DataFrame, known: DataFrame | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(``key``, canonical_digest, license_id) for every row."""
    table = digests(known if known is not None else known_licenses(df.sparkSession))
    rows = df.select(key, F.sha2(canonical(F.col(text)), 256).alias("canonical_digest"))
    return rows.join(table, rows.canonical_digest == table.digest, "left").select(key, "canonical_digest", "license_id")


def canonical_sql(text: str) -> str:
    """The same canonical form in DuckDB SQL."""
    out = f"regexp_replace(lower(coalesce({text}, '')), '{COPYRIGHT_LINE}', chr(10), 'g')"
    out = f"trim(regexp_replace({out}, '{BETWEEN}', ' ', 'g'))"
    for other, kept in SPELLINGS:
        out = f"replace({out}, '{other}', '{kept}')"
    return out


def scan_sql() -> str:
    """DuckDB SQL for ``scan`` of ``documents`` with the built-in texts."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in LICENSES)
    return f"""
WITH known AS (SELECT license_id, {canonical_sql('text')} AS form FROM (VALUES {values}) AS v(license_id, text)),
digests AS (SELECT sha256(form) AS digest, min(license_id) AS license_id FROM known WHERE form <> '' GROUP BY 1),
scanned AS (SELECT doc_id, sha256({canonical_sql('text')}) AS canonical_digest FROM documents)
SELECT s.doc_id, s.canonical_digest, d.license_id FROM scanned s LEFT JOIN digests d ON s.canonical_digest = d.digest"""
