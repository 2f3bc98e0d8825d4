"""Fill-in-middle transformation over relational units.

A text is a row of units, which a pattern matches from left to right (anything
it does not match is a unit of one code point).  A document asks for two cuts,
each before a unit of some ordinal.  Offsets come from tables:

1. ``posexplode`` gives the runs of up to ``RUN`` units of each document, and
   window running sums of their lengths give where each begins;
2. the cut requests meet the runs by document and ordinal;
3. ``posexplode`` gives the units of those runs, and the lengths of the ones
   before each cut, added to the run's offset, aggregate to one row per
   document;
4. ``substring`` cuts the text there.

Two levels keep the tables near the square root of the number of units.  Rows
travel once, by a row number of their own: runs, requests and offsets of a
document are already where its text is, and both readers of that exchange
share it.

Null is an empty text, and an empty text stays plain.  A null id draws as the
empty string; repeated rows give equal results; an empty table gives none.  A
very long text is many runs, each a row of the window, which spills.  Other
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._work import text_rows

#: Units of one run.
RUN = 48
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CODE_POINT = "(?s:.)"


def draws(id_col: str, salt: str = "1:", how_many: int = 4) -> list[Column]:
    """Unsigned 32-bit numbers from the hex digest of ``salt`` and the id in decimal."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(how_many)]


def _each(pattern: str) -> str:
    return pattern if pattern == CODE_POINT else f"(?:{pattern})|{CODE_POINT}"


def n_units(text: Column, unit: str) -> Column:
    """How many units a text has."""
    return (F.char_length(text) if unit == CODE_POINT else F.regexp_count(text, F.lit(_each(unit)))).cast("long")


def cut_offsets(rows: DataFrame, unit: str, cuts: Column) -> DataFrame:
    """``(row, first, second)``: offsets in code points of the two cuts of each text of ``rows(row, doc_id, text)``, which lie there by ``row``.

    ``cuts`` is an array of two ordinals of units to cut before, the number of
    units standing for the end, or null for texts that are not cut and give no
    row.
    """
    each = _each(unit)
    run = "(?:%s){1,%d}+" % (each, RUN)
    whole = Window.partitionBy("row", "doc_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    # All readers use all columns of the rows and filter behind the explode, so that they share one exchange.
    runs = rows.select("row", "doc_id", F.posexplode_outer(F.regexp_extract_all("text", F.lit(f"({run})"), F.lit(1))).alias("run", "piece"))
    runs = runs.select("row", "run", "piece", F.coalesce(F.sum(F.length("piece")).over(whole), F.lit(0)).alias("at"))
    # The end is behind the last unit of the last run.
    asked = rows.select("row", (n_units(F.col("text"), unit) - 1).alias("end"), F.posexplode_outer(cuts).alias("which", "unit"))
    asked = asked.where("unit IS NOT NULL").select("row", "which", "unit", F.least("unit", "end").alias("held"))
    since = F.col("held") - F.col("run") * RUN
    hit = runs.join(asked, "row").where((since >= 0) & (since < RUN))
    before = F.slice(F.regexp_extract_all("piece", F.lit(f"({each})"), F.lit(1)), F.lit(1), (F.col("unit") - F.col("run") * RUN).cast("int"))
    units = hit.select("row", "which", "at", F.explode_outer(before).alias("u"))

    def offset(which: int) -> Column:
        mine = F.col("which") == which
        return F.max(F.when(mine, F.col("at"))) + F.coalesce(F.sum(F.when(mine, F.length("u"))), F.lit(0))

    return units.groupBy("row").agg(offset(0).alias("first"), offset(1).alias("second"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    second, third = F.when(form == "psm", F.instr(output, SUFFIX)).otherwise(F.instr(output, PREFIX)), F.instr(output, MIDDLE)
    a, b, c = (output.substr(x + 3, y - x - 3) for x, y in ((F.lit(1), second), (second, third), (third, F.length(output) + 1)))
    return F.when(form == "plain", output).when(form == "psm", F.concat(a, c, b)).otherwise(F.concat(b, c, a))


def fill_in_middle(docs: DataFrame, unit: str = CODE_POINT, plain_percent: int = 10, spm_percent: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, n, form, first, second, output)``: each text with its middle moved to the end.

    ``form`` is ``plain`` (the text as it is), ``psm`` (prefix, suffix, middle)
    or ``spm`` (suffix, prefix, middle); texts that hold a marker are plain.
    ``first`` and ``second`` are the offsets of the cuts.
    """
    text = F.col("text")
    rows = text_rows(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("row")
    h1, h2, h3, h4 = draws("doc_id")
    n = n_units(text, unit)
    plain = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (h3 % 100 >= 100 - plain_percent)
    form = F.when(plain, F.lit("plain")).when(h4 % 100 < spm_percent, F.lit("spm")).otherwise(F.lit("psm"))
    cuts = F.when(~plain, F.array_sort(F.array(h1 % (n + 1), h2 % (n + 1))))
    found = rows.join(cut_offsets(rows, unit, cuts), "row", "left").select("doc_id", "text", n.alias("n"), form.alias("form"), "first", "second")
    prefix, middle, suffix = text.substr(F.lit(1), F.col("first")), text.substr(F.col("first") + 1, F.col("second") - F.col("first")), text.substr(F.col("second") + 1, F.length("text"))
    psm, spm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle), F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return found.withColumn("output", F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", psm).otherwise(spm))


def fill_in_middle_digest(docs: DataFrame) -> DataFrame:
    """Lengths and digests of the outputs of ``fill_in_middle`` and of the texts rebuilt from them."""
    rows = fill_in_middle(docs)
    made = rows.select("doc_id", "n", "form", F.col("first").alias("prefix_chars"), (F.col("second") - F.col("first")).alias("middle_chars"), "output", restore(F.col("output"), F.col("form")).alias("restored"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
