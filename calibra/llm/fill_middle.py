"""Fill-in-middle transformation by lookaround splitting.

A unit grammar says between which neighbouring characters a unit ends. It is translated to a regular expression that matches
nothing but places (zero width): a look behind at one class, a look ahead at another. Spark's split at these places
gives the units, which joined give the text again. Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.llm.common import documents

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ANY = r"[\s\S]"


@dataclass(frozen=True)
class Grammar:
    """Units end between a character of ``left`` and one of ``right``, for every pair (left, right) of character classes."""

    name: str
    ends: tuple[tuple[str, str], ...]

    def boundary(self) -> str:
        return "|".join(f"(?<={left})(?={right})" for left, right in self.ends)


#: A code point; a run of white space or of anything else; a line with its line feed; a sentence with the white space after it.
GRAMMARS = {
    g.name: g
    for g in (
        Grammar("code_point", ((ANY, ANY),)),
        Grammar("word", ((r"\s", r"\S"), (r"\S", r"\s"))),
        Grammar("line", ((r"\n", ANY),)),
        Grammar("sentence", ((r"[.!?。！？]\s", r"\S"),)),
    )
}


def units(text: Column, grammar: Grammar) -> Column:
    """The units of a text, in order; none for an empty text, which split would make one empty unit of."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, grammar.boundary()))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """The first four 32-bit numbers of the SHA-256 of "<seed>:<doc_id>"; a null doc_id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def joined(pieces: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(pieces, start + 1, end - start), "")


def fill_in_middle(docs: DataFrame, grammar: str = "code_point", seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """(doc_id, text, n, form, prefix_units, middle_units, output) of every row: its text cut at two drawn places into prefix, middle, suffix.

    form: plain (the text itself; h3 mod 100 >= plain_from, and texts that are empty or hold a marker), else spm
    (h4 mod 100 < spm_below: suffix, prefix, middle) or psm (prefix, suffix, middle); prefix_units and middle_units are null
    if plain. h1 mod (n + 1) and h2 mod (n + 1) are the places, so that pieces may be empty. A null text counts as empty.
    Null doc_ids share their draws; repeated rows give equal rows; an empty table gives none; extra columns stay behind. A
    row is worked on whole: a long text takes some 20 bytes a unit, in the one task that has its row.
    """
    cut = documents(docs).select("doc_id", "text", units(F.col("text"), GRAMMARS[grammar]).alias("pieces"))
    drawn = cut.select("*", F.size("pieces").alias("n"), *draws(F.col("doc_id"), seed))
    one, two = (F.col(h) % (F.col("n") + 1) for h in ("h1", "h2"))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= plain_from)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_below, "spm").otherwise("psm")
    placed = drawn.select("doc_id", "text", "pieces", "n", form.alias("form"), F.least(one, two).cast("int").alias("lo"), F.greatest(one, two).cast("int").alias("hi"))
    prefix, middle, suffix = joined(F.col("pieces"), F.lit(0), F.col("lo")), joined(F.col("pieces"), F.col("lo"), F.col("hi")), joined(F.col("pieces"), F.col("hi"), F.col("n"))
    parts = placed.withColumn("parts", F.when(F.col("form") != "plain", F.struct(prefix.alias("prefix"), middle.alias("middle"), suffix.alias("suffix"))))
    psm = F.concat(F.lit(PREFIX), "parts.prefix", F.lit(SUFFIX), "parts.suffix", F.lit(MIDDLE), "parts.middle")
    spm = F.concat(F.lit(SUFFIX), "parts.suffix", F.lit(PREFIX), "parts.prefix", F.lit(MIDDLE), "parts.middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", spm).otherwise(psm)
    whole = F.col("form") != "plain"
    return parts.select("doc_id", "text", F.col("n").cast("long").alias("n"), "form", F.when(whole, F.col("lo").cast("long")).alias("prefix_units"), F.when(whole, (F.col("hi") - F.col("lo")).cast("long")).alias("middle_units"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the form came from. No piece holds a marker, and a marker can't begin in a piece and end
    in the marker after it, so cutting at the markers gives the pieces back."""
    parts = F.split(output, "<[PSM]>")  # empty, then the pieces in the form's order
    at = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "plain", output).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(F.concat(at(1), at(3), at(2)))


def op12(spark, sf_dir: str) -> DataFrame:
    """Digests of the outputs over code points: prefix_chars and middle_chars are the units of that grammar."""
    from calibra.llm.common import table

    made = fill_in_middle(table(spark, sf_dir, "documents")).select("doc_id", "n", "form", "prefix_units", "middle_units", "output")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = """
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (
  SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM d),
p AS (
  SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '<P>' || substr(text, 1, lo) || '<S>' || substr(text, hi + 1) || '<M>' || substr(text, lo + 1, hi - lo)
    ELSE '<S>' || substr(text, hi + 1) || '<P>' || substr(text, 1, lo) || '<M>' || substr(text, lo + 1, hi - lo) END AS output FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM o
"""
