"""Analytics over stored messages and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parapet.functions.logic import Answer, answer
from parapet.sources.shared import stored


def window_of(messages: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """Whole days, both ends included; the comparison with dates prunes partitions by day."""
    return messages.where(F.col("day").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date")))


def search(messages: DataFrame, column: str, text: str) -> DataFrame:
    """Case-insensitive substring; % and _ are ordinary characters."""
    return messages.where(F.contains(F.lower(column), F.lit(text.lower())))


def page(df: DataFrame, order: list[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(max(offset, 0)).limit(min(max(limit, 1), 500))


def latest(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The latest row of each key, by at, then tie."""
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc(), F.col(tie).desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def by_day(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("day").agg(F.count("*").alias("messages"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("malicious", "indeterminate", "clean")])


def top_items(df: DataFrame, items: Column, name: str, k: int = 10) -> DataFrame:
    """The k most frequent values of an array column; ties by name."""
    counted = df.select(F.explode(items).alias(name)).groupBy(name).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), name).limit(k)


def top_values(df: DataFrame, column: Column, name: str, k: int = 10) -> DataFrame:
    return df.groupBy(column.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(k)


def rerunnable(verdicts: DataFrame, capability: str) -> DataFrame:
    return verdicts.where(F.array_contains("missing", capability))


def effectiveness(verdicts: DataFrame, triage: DataFrame, dispositions: DataFrame | None = None, least: int = 5) -> DataFrame:
    """Per rule that fired: hits, confirmed, benign, ignored, unreviewed, false_positive, accepted_risk, reviewed, precision (from `least`
    reviews on). triage: message_id, triage; dispositions: message_id, disposition. A disposition goes before triage; an accepted risk
    speaks for the rule; what is ignored counts neither way."""
    fired = verdicts.select("message_id", F.explode("matched").alias("rule")).join(triage, "message_id", "left")
    if dispositions is None:
        fired = fired.withColumn("disposition", F.lit(None).cast("string"))
    else:
        fired = fired.join(dispositions, "message_id", "left")
    said = F.when(F.col("disposition").isin("false_positive", "accepted_risk"), F.col("disposition")).otherwise(F.coalesce("triage", F.lit("unreviewed")))
    count = lambda *states: F.count_if(said.isin(*states))
    counts = fired.groupBy("rule").agg(
        F.count("*").alias("hits"), count("needs_remediation", "remediated").alias("confirmed"), count("benign").alias("benign"), count("ignored").alias("ignored"),
        count("unreviewed").alias("unreviewed"), count("false_positive").alias("false_positive"), count("accepted_risk").alias("accepted_risk"),
    )
    reviewed = F.col("confirmed") + F.col("benign") + F.col("false_positive") + F.col("accepted_risk")
    return counts.withColumn("reviewed", reviewed).withColumn("precision", F.when(F.col("reviewed") >= least, (F.col("confirmed") + F.col("accepted_risk")) / F.col("reviewed")))


def dormant(rules: DataFrame, verdicts: DataFrame) -> DataFrame:
    return rules.join(verdicts.select(F.explode("matched").alias("rule")).distinct(), "rule", "left_anti")


def triage_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy(F.coalesce("triage", F.lit("unreviewed")).alias("state")).agg(F.count("*").alias("n"))


def training_labels(messages: DataFrame, dispositions: DataFrame) -> DataFrame:
    """One label for each reviewed message: a disposition overrides triage; what is ignored counts as negative."""
    said = F.coalesce("disposition", F.when(F.col("triage") != "unreviewed", F.col("triage")))
    both = messages.join(dispositions, "message_id", "left").select("message_id", said.alias("said")).where("said is not null")
    return both.select("message_id", F.when(F.col("said").isin("needs_remediation", "malicious"), 1).otherwise(0).alias("label"))


def hunt(messages: DataFrame, test: Answer | Column) -> DataFrame:
    """One row: scanned, matched, undecided, and how often each kind of evidence was missing (sorted array of name, n).

    One pass: messages are counted by verdict and set of missing names first, of which there are few."""
    a = answer(test)
    sets = messages.select(a.verdict.alias("v"), a.names.alias("m")).groupBy("v", "m").agg(F.count("*").alias("n"))
    gap = F.when(F.col("v") == "indeterminate", F.transform("m", lambda x: F.struct(x.alias("name"), F.col("n").alias("n"))))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    one = sets.agg(total(F.col("n")).alias("scanned"), total(F.when(F.col("v") == "match", F.col("n"))).alias("matched"), total(F.when(F.col("v") == "indeterminate", F.col("n"))).alias("undecided"), F.flatten(F.collect_list(gap)).alias("gaps"))
    names = F.array_sort(F.array_distinct(F.transform("gaps", lambda g: g["name"])))
    summed = F.transform(names, lambda x: F.struct(x.alias("name"), F.aggregate(F.filter("gaps", lambda g: g["name"] == x), F.lit(0).cast("long"), lambda s, g: s + g["n"]).alias("n")))
    return one.select("scanned", "matched", "undecided", summed.alias("missing"))


def hits(messages: DataFrame, test: Answer | Column, limit: int | None = None) -> DataFrame:
    """Ids of matches, newest first; `limit` is for reports."""
    found = messages.where(answer(test).verdict == "match").select("message_id", "received_at")
    return found.orderBy(F.desc("received_at"), F.desc("message_id")).limit(limit) if limit else found


def backtest(messages: DataFrame, test: Answer | Column, least: int = 5) -> DataFrame:
    """One row over all hits: matched, reviewed, benign, confirmed, precision. Whoever reviewed a hit and didn't call it benign confirmed it,
    whether it was remediated, is to be, or was ignored."""
    found = messages.where(answer(test).verdict == "match").select(F.coalesce("triage", F.lit("unreviewed")).alias("t"))
    out = found.agg(F.count("*").alias("matched"), F.count_if(F.col("t") != "unreviewed").alias("reviewed"), F.count_if(F.col("t") == "benign").alias("benign"), F.count_if(~F.col("t").isin("unreviewed", "benign")).alias("confirmed"))
    return out.withColumn("precision", F.when(F.col("reviewed") >= least, F.col("confirmed") / F.col("reviewed")))


def retro(messages: DataFrame, verdicts: DataFrame, test: Answer | Column, rule: str, known: DataFrame, days: int = 30) -> DataFrame:
    """New findings of a rule over the last days: not on messages already malicious, and not found (or dismissed) before.
    known: message_id, kind, source."""
    last = messages.agg(F.max("day").alias("_last"))
    recent = messages.join(F.broadcast(last), F.col("day") > F.date_sub("_last", days)).drop("_last")  # one row
    bad = verdicts.where("verdict = 'malicious'").select("message_id")
    found = recent.where(answer(test).verdict == "match").select("message_id").join(bad, "message_id", "left_anti")
    found = found.select("message_id", F.lit("rule").alias("kind"), F.lit(rule).alias("source"))
    return found.join(known, ["message_id", "kind", "source"], "left_anti")


BUCKETS = 256


def index_values(values: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Append (message_id, value) to an index that later looks for values: partitioned by a bucket of the lower-cased value."""
    low = F.lower("value")
    rows = values.where("value is not null").select("message_id", low.alias("value"), F.pmod(F.xxhash64(low), F.lit(buckets)).cast("int").alias("bucket"))
    rows.repartition("bucket", F.pmod(F.xxhash64("message_id"), F.lit(4))).write.mode("append").partitionBy("bucket").parquet(path)


def grown_list(spark: SparkSession, path: str, before: DataFrame, after: DataFrame, known: DataFrame, name: str, buckets: int = BUCKETS) -> DataFrame:
    """message_id, kind, source, value: what a list finds among indexed messages by the values that it gained (`before` and `after`: value), and that
    isn't known (message_id, kind, source) yet. Only the new values' buckets of the index are read: what the list had before was found
    then. One finding for each message and value."""
    low = lambda df: df.select(F.lower("value").alias("value")).where("value != ''").distinct()
    delta = stored(low(after).join(low(before), "value", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("value"), F.lit(buckets)).cast("int")), "delta")
    touched = [r.bucket for r in delta.select("bucket").distinct().collect()]  # `buckets` at most
    index = spark.read.schema("message_id long, value string, bucket int").parquet(path).where(F.col("bucket").isin(touched) if touched else F.lit(False))
    found = index.join(delta, ["bucket", "value"], "left_semi").select("message_id", F.lit("list").alias("kind"), F.lit(name).alias("source"), "value").distinct()
    return found.join(known, ["message_id", "kind", "source"], "left_anti")


def link_digest(url: Column, retrieved: Column, length: Column) -> Column:
    """Changes when a link's target, outcome or size class changes."""
    return F.substring(F.sha2(F.concat_ws("|", url, retrieved.cast("string"), F.floor(F.log10(F.greatest(length, F.lit(1)))).cast("string")), 256), 1, 16)


def auth_badge(passed: Column) -> Column:
    return F.when(passed.isNull(), "absent").when(passed, "pass").otherwise("fail")


def heads(messages: DataFrame, ids: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """The thin rows behind a list of findings, the latest one of each id, with its verdict if verdicts are given. ids: message_id (repeated or
    unknown ones change nothing)."""
    found = messages.join(ids.select("message_id").distinct(), "message_id", "left_semi").select("message_id", "received_at", "sender_email", "subject")
    rows = latest(found, ["message_id"], "received_at", "subject")
    return rows if verdicts is None else rows.join(verdicts.select("message_id", "verdict"), "message_id", "left")


def flagged(messages: DataFrame, verdicts: DataFrame, state: str | None = None, most: int | None = 5000) -> DataFrame:
    """Ids of malicious messages, newest first, at most `most` of them (None: all); with `state`, only those in that state of triage."""
    bad = messages.join(verdicts.where("verdict = 'malicious'").select("message_id"), "message_id", "left_semi")
    own = F.coalesce("triage", F.lit("unreviewed"))
    found = (bad.where(own == state) if state else bad).select("message_id", "received_at", own.alias("state")).orderBy(F.desc("received_at"), F.desc("message_id"))
    return found if most is None else found.limit(most)


def people(messages: DataFrame, recipients: str | None = None, domains: bool = False) -> DataFrame:
    """value: distinct lower-cased senders of what isn't outbound, or with an array column `recipients` the recipients of what is known
    not to be outbound: whom the organisation writes to is none of its own. With `domains` only what follows the @."""
    if recipients:
        found = messages.where("direction != 'outbound'").select(F.explode(recipients).alias("v"))
    else:
        found = messages.where("direction is null or direction != 'outbound'").select(F.col("sender_email").alias("v"))
    value = F.lower(F.get(F.split("v", "@"), F.lit(1)) if domains else F.col("v"))
    return found.select(value.alias("value")).where("value != ''").distinct()


def appeared(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rules (name, source) of `after` that are new, or whose source changed; nothing if there was no rule before."""
    new = after.join(before.select("name", "source"), ["name", "source"], "left_anti")
    return new.where(F.lit(not before.isEmpty())).select("name")


def distinct_values(values: Column) -> Column:
    """What a wildcard path yields: distinct values without nulls, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))))
