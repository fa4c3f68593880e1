"""Fill-in-the-middle by relational units.

1. A text's tokens (a word with the white space before it; white space at the end) are its units: `posexplode` gives a row for each
   with its ordinal and its length.
2. A running sum over a text's units gives the code point at which each unit ends.
3. Each text that is rearranged asks for two cuts, by unit ordinal. The requests are joined to the units, and the two offsets are
   aggregated for each text.
4. The text is cut by `substring` at these offsets, and its parts are put together with their marks.

Only texts that are rearranged take that way. They are dealt out once, by a digest of doc_id and text, with equal rows counted into one
before that; units, requests and offsets then have the same key, so none of them moves again. Plain texts don't move at all.

Null texts are empty, hence plain. A null doc_id counts as the word `null` where cuts are drawn. Repeated rows are answered each;
rows that share only the doc_id are drawn alike and cut by their own tokens. An empty table gives no rows. Columns besides doc_id and
text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A token, and the marks before prefix, suffix and middle.
TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """Four 32-bit numbers from a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def restored(output: Column, form: Column) -> Column:
    """The text from an output and its form."""
    part = lambda x, mark, i: F.split_part(x, F.lit(mark), F.lit(i))
    end = F.lit(2**31 - 1)
    middle = part(output, MIDDLE, 2)
    psm = F.concat(F.substring(part(output, SUFFIX, 1), F.lit(len(PREFIX) + 1), end), middle, part(part(output, SUFFIX, 2), MIDDLE, 1))
    spm = F.concat(part(part(output, PREFIX, 2), MIDDLE, 1), middle, F.substring(part(output, PREFIX, 1), F.lit(len(SUFFIX) + 1), end))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def cut(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """For each distinct (doc_id, text) that is rearranged, and each row that is not: doc_id, n, form, prefix_chars, middle_chars,
    output, copies (how many equal rows it stands for)."""
    plain_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    h = _draws(F.col("doc_id"), seed)
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    stays = (F.col("text") == "") | (h[2] % 100 >= percent) | marked
    none = F.lit(None).cast("long")
    plain = plain_docs.where(stays).select(
        "doc_id", F.size(_tokens(F.col("text"))).cast("long").alias("n"), F.lit("plain").alias("form"), none.alias("prefix_chars"), none.alias("middle_chars"), F.col("text").alias("output"), F.lit(1).cast("long").alias("copies")
    )

    key = F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("text")), 256)).alias("key")
    moved = plain_docs.where(~stays).groupBy(key).agg(F.first(F.struct("doc_id", "text")).alias("d"), F.count("*").alias("copies"))
    moved = moved.where("copies > 0")  # so that every use below needs the same columns, and all read one exchange
    text, doc_id = F.col("d.text"), F.col("d.doc_id")

    units = moved.select("key", F.posexplode(_tokens(text)).alias("at", "unit")).select("key", (F.col("at") + 1).alias("ordinal"), F.length("unit").alias("chars"))
    ends = units.select("key", "ordinal", F.expr("sum(chars) over (partition by key order by ordinal)").alias("stop"))
    counted = moved.select("key", doc_id.alias("doc_id"), F.size(_tokens(text)).cast("long").alias("n"))
    one, two = (x % (F.col("n") + 1) for x in _draws(F.col("doc_id"), seed)[:2])
    requests = counted.select("key", "n", F.least(one, two).alias("first"), F.greatest(one, two).alias("second"))
    asked = requests.withColumnRenamed("key", "of")
    hit = ends.join(asked, (F.col("key") == F.col("of")) & ((F.col("ordinal") == F.col("first")) | (F.col("ordinal") == F.col("second"))))
    at = lambda which: F.max(F.when(F.col("ordinal") == F.col(which), F.col("stop")))
    offsets = hit.groupBy("key").agg(at("first").alias("p"), at("second").alias("m"))  # a cut before the first unit has no row

    whole = moved.join(requests.select("key", "n"), "key").join(offsets, "key", "left")
    p, m = F.coalesce("p", F.lit(0)), F.coalesce("m", F.lit(0))
    end = F.lit(2**31 - 1)
    whole = whole.select(
        doc_id.alias("doc_id"), "n", "copies", F.when(_draws(doc_id, seed)[3] % 100 < spm_percent, "spm").otherwise("psm").alias("form"), p.alias("prefix_chars"), (m - p).alias("middle_chars"),
        F.substring(text, F.lit(1), p.cast("int")).alias("a"), F.substring(text, (p + 1).cast("int"), (m - p).cast("int")).alias("b"), F.substring(text, (m + 1).cast("int"), end).alias("c"),
    )
    psm = F.concat(F.lit(PREFIX), "a", F.lit(SUFFIX), "c", F.lit(MIDDLE), "b")
    spm = F.concat(F.lit(SUFFIX), "c", F.lit(PREFIX), "a", F.lit(MIDDLE), "b")
    return plain.unionByName(whole.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.when(F.col("form") == "psm", psm).otherwise(spm).alias("output"), "copies"))


def _each(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("col")


def transform(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """Per row: doc_id, n, form, prefix_chars, middle_chars, output."""
    return _each(cut(docs, seed, percent, spm_percent), "doc_id", "n", "form", "prefix_chars", "middle_chars", "output")


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    made = cut(docs).withColumns({"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored(F.col("output"), F.col("form")), 256)})
    return _each(made, "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
