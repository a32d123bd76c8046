"""Fill-in-the-middle transformation by escaped marker injection, with built-in functions only.

A text's units are runs of ASCII letters and single other characters. A
delimiter is escaped where the text holds it, appended after every unit by one
regexp_replace and counted; substring_index then cuts the text before and after
ranked units, and the parts are unescaped and put together. Each row is worked
on where it lies: there is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import settled

#: The delimiter, and the sign that escapes both: ESCAPE 0 stands for itself, ESCAPE 1 for the delimiter.
DELIMITER, ESCAPE = "\u001e", "\u001b"
#: An escaped sign is one unit, as the sign itself is.
UNIT = rf"[A-Za-z]+|{ESCAPE}[01]|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _swap(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def marked(text: Column) -> Column:
    """``text`` with a delimiter after every unit, its own delimiters escaped."""
    escaped = _swap(_swap(text, ESCAPE, ESCAPE + "0"), DELIMITER, ESCAPE + "1")
    return F.regexp_replace(escaped, UNIT, f"$0{DELIMITER}")


def unmarked(part: Column) -> Column:
    """The text that a part of a marked text stands for."""
    return _swap(_swap(_swap(part, DELIMITER, ""), ESCAPE + "1", DELIMITER), ESCAPE + "0", ESCAPE)


def _cut(c: Column, count: Column) -> Column:
    return F.call_function("substring_index", c, F.lit(DELIMITER), count.cast("int"))


def drawn(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned numbers of 32 bits: the first groups of eight digits of sha256 of ``seed:id``."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """doc_id, n, form, prefix, middle, suffix, output of every row; parts are null where the form is plain.

    Cuts and form come from hashes of the id: plain if the hash's remainder is
    ``plain_from`` or more, suffix first if another's is below ``spm_below``. A
    null text counts as empty, a null id as empty text in the hash; empty texts
    and those that hold a marker stay plain, so every output can be undone.
    Repeated rows come out alike, once each; other columns don't matter.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = settled(docs.select("doc_id", text.alias("text")), {"m": marked(F.col("text")), "h": F.array(*drawn(F.col("doc_id"), seed))})
    rows = settled(rows, {"n": F.length("m") - F.length(_swap(F.col("m"), DELIMITER, ""))})
    first, second = F.col("h")[0] % (F.col("n") + 1), F.col("h")[1] % (F.col("n") + 1)
    holds = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | holds | (F.col("h")[2] % 100 >= plain_from)
    form = F.when(plain, "plain").when(F.col("h")[3] % 100 < spm_below, "spm").otherwise("psm")
    rows = settled(rows, {"a": F.least(first, second), "b": F.greatest(first, second), "form": form})
    part = lambda c: F.when(F.col("form") != "plain", unmarked(c))
    rows = settled(rows, {
        "prefix": part(_cut(F.col("m"), F.col("a"))),
        "middle": part(_cut(_cut(F.col("m"), F.col("b")), F.col("a") - F.col("b"))),
        "suffix": part(_cut(F.col("m"), F.col("b") - F.col("n") - 1)),
    })
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n"), "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of, from the output and its form alone."""
    cut = lambda c, sign, count: F.substring_index(c, sign, count)
    head, middle = cut(output, MIDDLE, 1), cut(output, MIDDLE, -1)
    whole = lambda sign: F.substr(cut(head, sign, 1), F.lit(len(sign) + 1))
    psm = F.concat(whole(SUFFIX), middle, cut(head, SUFFIX, -1))
    spm = F.concat(cut(head, PREFIX, -1), middle, whole(PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
