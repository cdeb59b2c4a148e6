r"""Fill-in-the-middle transformation by one counted-quantifier match per text. DataFrame functions only.

``regexp_count`` gives the number n of units (lines, unless told otherwise) of a text. Two numbers drawn from the id place the
cuts: the smaller of them, a, ends the prefix, the larger, b, the middle. A pattern made for the row,
``\A((?:unit){a}+)((?:unit){b-a}+)(.*)\z`` with possessive counts, captures prefix, middle and suffix in one match, and its replacement
puts them in the order of the form. Possessive counts run in a loop without a stack or a way back, so a text of a
million lines is one pass.

Forms: "psm" is prefix, suffix, middle, each behind its marker; "spm" is suffix, prefix, middle; "plain" is the text itself.

Defined results: a null text is an empty one; an empty text is plain, and so is one that contains a marker, as its output
could not be read back; a null id draws as an empty string does. Rows of one id have the same draws. Repeated rows come
back as often as they occur, other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LINES = r"[^\n]*\n|[^\n]+"
MARKERS = ("<P>", "<S>", "<M>")


def _quoted(marker: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in marker)


def draws(id_col: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32: the first 8-digit groups of the hex SHA-256 of ``seed:id``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    digest = F.sha2(F.encode(text, "UTF-8"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(
    docs: DataFrame, id_col: str, text_col: str, seed: int = 7, percent: int = 100, spm_percent: int = 50, unit: str = LINES, markers: tuple[str, str, str] = MARKERS,
) -> DataFrame:
    """``(id, n, form, output)`` of every text.

    Of 100 texts about ``percent`` are transformed, and of those about ``spm_percent`` to "spm". ``unit`` is a pattern whose matches,
    one after the other, make up any text; ``markers`` stand for prefix, suffix and middle. No marker may be part of another one or begin as
    another one ends.
    """
    for m in markers:
        if not m or any(m in o or any(m.endswith(o[:k]) for k in range(1, len(o))) for o in markers if o is not m):
            raise ValueError(f"markers {markers} cannot be told apart")
    p, s, m = markers
    text = F.coalesce(F.col(text_col), F.lit(""))
    h1, h2, h3, h4 = draws(F.col(id_col), seed)
    rows = docs.select(F.col(id_col), text.alias("_text"), h1.alias("_1"), h2.alias("_2"), h3.alias("_3"), h4.alias("_4"))
    rows = rows.withColumn("n", F.regexp_count("_text", F.lit(unit)).cast("long"))
    one, two = F.col("_1") % (F.col("n") + 1), F.col("_2") % (F.col("n") + 1)
    rows = rows.withColumns({"_a": F.least(one, two), "_b": F.greatest(one, two)})
    marked = F.lit(False)
    for x in markers:
        marked = marked | F.contains("_text", F.lit(x))
    plain = (F.col("_text") == "") | marked | (F.col("_3") % 100 >= percent)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("_4") % 100 < spm_percent, "spm").otherwise("psm"))
    counted = lambda k: F.concat(F.lit(f"((?:{unit}){{"), k.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"(?s)\A"), counted(F.col("_a")), counted(F.col("_b") - F.col("_a")), F.lit(r"(.*)\z"))
    literal = lambda x: x.replace("\\", "\\\\").replace("$", "\\$")
    order = F.when(F.col("form") == "psm", f"{literal(p)}$1{literal(s)}$3{literal(m)}$2").otherwise(f"{literal(s)}$3{literal(p)}$1{literal(m)}$2")
    output = F.when(F.col("form") == "plain", F.col("_text")).otherwise(F.regexp_replace("_text", pattern, order))
    return rows.select(id_col, "n", "form", output.alias("output"))


def parts(form: Column, output: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The struct (prefix, middle, suffix) of an output; null for plain ones."""
    cut = F.split(output, "|".join(map(_quoted, markers)), -1)  # "", then two parts in the order of the form, then the middle
    at = lambda c, i: F.get(c, F.lit(i))
    made = F.transform(
        F.array(cut),
        lambda c: F.struct(
            F.when(form == "psm", at(c, 1)).otherwise(at(c, 2)).alias("prefix"), at(c, 3).alias("middle"), F.when(form == "psm", at(c, 2)).otherwise(at(c, 1)).alias("suffix")
        ),
    )
    return F.when(form != "plain", F.get(made, F.lit(0)))


def restored(output: Column, cut: Column) -> Column:
    """The text of an output, from its parts."""
    return F.when(cut.isNull(), output).otherwise(F.concat(cut["prefix"], cut["middle"], cut["suffix"]))
