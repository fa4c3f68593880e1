"""Deterministic scores: confidence of labels, attack score, language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confidence(scores: Column) -> Column:
    """map<label, score> -> struct(label, confidence): by the lead over the second and the share of the total."""
    order = F.sort_array(F.transform(F.map_entries(scores), lambda e: F.struct(e["value"].alias("s"), e["key"].alias("k"))), asc=False)
    total = F.aggregate(F.map_values(scores), F.lit(0.0), lambda a, x: a + x)
    top, second = F.get(order, F.lit(0)), F.get(order, F.lit(1))
    share, lead = F.try_divide(top["s"], total), F.coalesce(F.try_divide(top["s"], second["s"]), F.lit(float("inf")))
    level = F.when((lead >= 2.0) & (share >= 0.30), "high").when(lead >= 1.2, "medium").otherwise("low")
    return F.struct(top["k"].alias("label"), level.alias("confidence"))


def level_of(score: Column) -> Column:
    return F.when(score >= 0.90, "high").when(score >= 0.50, "medium").when(score >= 0.15, "low")


def attack_score(matched: Column, auth_failed: Column, new_sender: Column, bulk: Column) -> Column:
    """struct(score, verdict): a decision list, strongest sign first."""
    score = F.when(matched & auth_failed, 0.95).when(matched & new_sender, 0.9).when(matched, 0.75).when(bulk, 0.1).when(auth_failed & new_sender, 0.6).when(auth_failed | new_sender, 0.3).otherwise(0.05)
    return F.struct(score.alias("score"), F.when(score >= 0.9, "malicious").when(score >= 0.5, "suspicious").when(score >= 0.15, "unknown").otherwise("likely_benign").alias("verdict"))


#: Frequent words by language.
STOPWORDS = {
    "de": "der die das und ist von mit den ein eine zu im".split(),
    "en": "the of and to in is that it was for on are".split(),
    "es": "el la de que y en los un por con una las".split(),
    "fr": "le la les de et un une est des que pour dans".split(),
}


def language(text: Column) -> Column:
    """Code of the language whose frequent words are most common, by share of words; ties by code; null without any."""
    words = F.split(F.lower(text), r"[^\p{L}]+")
    counts = F.array(*[F.struct(F.size(F.filter(words, lambda w: w.isin(*ws))).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, ws) in enumerate(_stopwords())])
    best = F.array_max(counts)
    return F.when(best["n"] > 0, best["k"])


def _stopwords():
    return sorted(STOPWORDS.items())


#: Languages that their script tells, by Unicode's names of scripts.
SCRIPTS = {"korean": "Hangul", "chinese": "Han", "russian": "Cyrillic", "greek": "Greek", "arabic": "Arabic", "hebrew": "Hebrew", "thai": "Thai", "hindi": "Devanagari"}
NAMES = {"de": "german", "en": "english", "es": "spanish", "fr": "french"}


def detected(text: Column, words: dict[str, list[str]] | None = None) -> Column:
    """struct(language, confidence) by script, then among Latin texts by words. A tenth of kana (counted three times) makes a text Japanese, more than
    half of the letters of another script its language. Latin texts of three words or more are told by the share of each language's words
    (`words`, by language) that occur; the lead over the second is the confidence, and a lead of 0.05 or less tells nothing. Null where
    nothing is told, or for text without letters."""
    lists = words or {NAMES[k]: w for k, w in STOPWORDS.items()}
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    other = F.rlike(text, F.lit(r"[\p{L}&&[^\p{IsLatin}]]"))  # most texts need no further count
    of = lambda *scripts: F.when(other, F.regexp_count(text, F.lit("[\\p{L}&&[" + "".join(rf"\p{{Is{x}}}" for x in scripts) + "]]"))).otherwise(0)
    latin = F.when(other, F.regexp_count(text, F.lit(r"[\p{L}&&[\p{IsLatin}]]"))).otherwise(letters)
    told = lambda language, confidence: F.struct(F.lit(language).alias("language"), F.lit(confidence).cast("double").alias("confidence"))
    kana = of("Hiragana", "Katakana")
    out = F.when((kana > 0) & (30 * kana >= letters), told("japanese", 0.95))
    for language, script in SCRIPTS.items():
        out = out.when(of(script) * (6 if script == "Hangul" else 2) > letters, told(language, 0.85))

    def by_words(found: Column) -> Column:
        present = F.array_distinct(found)
        shares = F.array(*[F.struct((-F.size(F.array_intersect(present, F.array(*map(F.lit, ws)))) / F.lit(len(ws))).alias("less"), F.lit(name).alias("language")) for name, ws in sorted(lists.items())])

        def lead(ordered: Column) -> Column:
            first, second = F.get(ordered, F.lit(0)), F.get(ordered, F.lit(1))
            apart = F.coalesce(second["less"], F.lit(0.0)) - first["less"]
            return F.when((first["less"] < 0) & (apart > 0.05), F.struct(first["language"].alias("language"), F.least(apart, F.lit(1.0)).alias("confidence")))

        return F.when(F.size(found) >= 3, F.get(F.transform(F.array(F.array_sort(shares)), lead), F.lit(0)))

    tokens = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")
    latin_told = F.get(F.transform(F.array(tokens), by_words), F.lit(0))
    return out.when((letters > 0) & (2 * latin > letters), latin_told)


#: Words behind the entities of a text.
ENTITIES = {
    "urgency": r"(?i)\b(urgent(?:ly)?|immediately|as soon as possible|right away|within 24 hours|final notice|act now)\b",
    "financial": r"(?i)\b(invoice|payment|wire transfer|bank account|remittance|payroll|gift cards?|refund)\b|[$\x{20ac}\x{a3}] ?\d[\d.,]*",
    "request": r"(?i)\b(please (?:review|confirm|send|reply|call)|kindly|can you|could you|let me know)\b",
    "greeting": r"(?im)^\s*(?:hi|hello|dear|hey)\b[^\n,]{0,40}",
}


def entities(text: Column) -> Column:
    """Distinct struct(name, text) in order of name and text; null for null."""

    def named(name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.struct(F.lit(name).alias("name"), F.lower(F.trim(x)).alias("text")))

    return F.array_sort(F.array_distinct(F.concat(*[named(*item) for item in ENTITIES.items()])))


def entities_by_line(text: Column) -> Column:
    """array of struct(line, entities) of the lines with any, counted from 0. No entity goes on beyond its line."""
    found = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line"), entities(x).alias("entities")))
    return F.filter(found, lambda x: F.size(x["entities"]) > 0)


def understood(text: Column) -> Column:
    """struct(language, entities, intents, topics, tags, unavailable): what can be told by rules; intents, topics and tags need a model and
    are named as unavailable one by one (see logic.part). entities: distinct (name, text) in order of name and text."""
    text = F.coalesce(text, F.lit(""))
    scored = F.lit(None).cast("array<struct<name:string,confidence:string>>")
    return F.struct(
        language(text).alias("language"), entities(text).alias("entities"), scored.alias("intents"), scored.alias("topics"),
        F.lit(None).cast("array<string>").alias("tags"), F.array(*map(F.lit, ("intents", "topics", "tags"))).alias("unavailable"),
    )


def absolute_confidence(score: Column, suppressive: Column) -> Column:
    """Level of one label's score by itself; a label that only suppresses others is never more than medium."""
    level = level_of(score)
    return F.when(suppressive & (level == "high"), "medium").otherwise(level)


def calibration(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """scored(score, label 0/1) -> precision, recall, f1 at each threshold. Every row is counted once for each threshold, in one pass."""
    sums = []
    for i, t in enumerate(thresholds):
        hit = F.col("score") >= t
        sums += [F.count_if(hit & (F.col("label") == 1)).alias(f"tp{i}"), F.count_if(hit & (F.col("label") == 0)).alias(f"fp{i}"), F.count_if(~hit & (F.col("label") == 1)).alias(f"fn{i}")]
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn")) for i, t in enumerate(thresholds)])
    out = scored.agg(*sums).select(F.explode(rows).alias("r")).select("r.*")
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.withColumns({"precision": p, "recall": r, "f1": F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})
