"""Quality rules, line first. The main path is DataFrame functions only.

Each line with a word is held against three rules: punctuation (marks and symbols outweigh words, or no letter at all),
navigation (a row of separators) and boilerplate (stock phrases of four languages that make up the line: at most `AROUND` words for
each phrase, so that a long line which mentions one stays). Lines that fail are removed; a document is rejected if the base rules fail
it (fewer than 10 words, or over a fifth of the words in repeated 5-word windows), if the removed lines of all three rules hold more
than `most_lost` per cent of the characters of its lines, or if no word is left.

Words are runs of characters other than space and U+0009-000D. Null and empty texts have no words and are not kept. Rows are judged
each on its own: repeated rows, a null doc_id and columns with other names change nothing. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.llm._shared import free_name, let

#: Fixed values of the contract: blank characters, symbols.
BLANK, WORD, SYMBOLS = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]", "[#*$%&|<>]"
#: Stock phrases of page furniture, in English, German, French and Spanish, lower-cased.
PHRASES = (
    "cookie policy|privacy policy|terms of use|terms of service|all rights reserved|enable javascript|lorem ipsum|click here|subscribe to our|sign up for|share this|licensed under|"
    "alle rechte vorbehalten|datenschutzerklärung|cookie-richtlinie|nutzungsbedingungen|hier klicken|klicken sie hier|newsletter abonnieren|javascript aktivieren|"
    "tous droits réservés|politique de confidentialité|mentions légales|conditions d'utilisation|cliquez ici|abonnez-vous|activer javascript|"
    "todos los derechos reservados|política de privacidad|aviso legal|términos de uso|haga clic aquí|suscríbete a|habilite javascript"
)
SEPARATORS = r"[|»›•·]"
WINDOW = 5
#: A line with more words than this for each stock phrase is text.
AROUND = 12


def line_is_junk(line: Column) -> Column:
    words = F.regexp_count(line, F.lit(WORD + "+"))
    marks = F.regexp_count(line, F.lit(r"[#*$%&|<>{}\[\]~^=_\\]|!!|\?\?"))
    punctuation = (F.rlike(line, F.lit(WORD)) & ~F.rlike(line, F.lit(r"\p{L}"))) | ((marks >= 3) & (10 * marks > 3 * words))
    bars = F.regexp_count(line, F.lit(SEPARATORS))
    navigation = (bars >= 3) & (10 * bars > 2 * words)
    return F.coalesce(punctuation | navigation, F.lit(False))


def names_stock(text: Column) -> Column:
    """Whether any stock phrase stands in the text; only then are its lines searched one by one."""
    return let(F.lower(text), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in PHRASES.split("|")]))


def line_is_stock(line: Column) -> Column:
    mentions = F.regexp_count(F.lower(line), F.lit(f"(?:{PHRASES})"))
    return (mentions > 0) & (F.regexp_count(line, F.lit(WORD + "+")) <= AROUND * mentions)


def repeated_words(words: Column) -> Column:
    """Words that lie in 5-word windows found twice or more."""

    def covered(windows: Column) -> Column:
        order = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        same = lambda a, b: F.coalesce(a["x"] == b["x"], F.lit(False))
        twice = let(order, lambda s: F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1))))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).cast("long").alias("n")), lambda a: a["n"])

    def of_codes(codes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(codes) - WINDOW), lambda i: F.xxhash64(*[F.get(codes, i + k) for k in range(WINDOW)]))
        return F.when(F.size(codes) > WINDOW, let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0).cast("long")))).otherwise(F.lit(0).cast("long"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_codes)


def judgement(text: Column, most_lost: int = 20) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and cleaned_text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, BLANK), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    step1 = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, BLANK, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"),
        let(names_stock(text), lambda some: F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), (line_is_junk(x) | (some & line_is_stock(x))).alias("fails")))).alias("lines"),
    )

    def verdict(q: Column) -> Column:
        failed = (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])
        chars = lambda rows: F.aggregate(rows, F.lit(0).cast("long"), lambda a, x: a + F.length(x["line"]))
        good = F.array_join(F.transform(F.filter(q["lines"], lambda x: ~x["fails"]), lambda x: x["line"]), "\n")
        few = 100 * chars(F.filter(q["lines"], lambda x: x["fails"])) <= most_lost * chars(q["lines"])
        kept = ~failed & few & F.rlike(good, F.lit(WORD))
        return F.struct(*[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], failed.alias("base_failed"), kept.alias("kept"), good.alias("cleaned_text"))

    return let(step1, verdict)


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    q = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    judged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array(judgement(F.col("text")))).alias("quality"))
    return judged.select("doc_id", *[f"quality.{c}" for c in q])


def clean(docs: DataFrame) -> DataFrame:
    """Documents that are kept, without their failing lines; n_chars, if there, follows. Columns stay as they are."""
    name = free_name(docs, "quality")
    # exploded, so that the plan can't move the judgement into a filter and make it twice
    out = docs.select("*", F.explode(F.filter(F.array(judgement(F.col("text"))), lambda q: q["kept"])).alias(name)).withColumn("text", F.col(f"{name}.cleaned_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
