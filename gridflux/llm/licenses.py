"""License scans by ordered signature rules.

A text is lower-cased (A-Z), cut into words and joined again by single spaces. Rules are regular expressions over that
form, each gated by a keyword, a word that stands in every text the rule matches: one cheap alternation decides whether a
text has any keyword at all, then the keywords found select the rules that run. Detections are word intervals with their rule's priority; sorted by start and
length, one pass suppresses every detection whose interval lies within one of equal or higher priority. Base phrases are
reported at all their places, suppressed or not.

Only DataFrame functions are used, row by row, without a shuffle. Edge cases: null, empty and wordless texts have no
words and no labels; repeated rows give repeated results; a text of any length is scanned whole, in time linear in its
words for each rule that matches; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridflux.llm.common import lower_az, only, table
from gridflux.llm.license_rules import BASE, Rule, gate, rules

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def rule_table(known: list[Rule]) -> Column:
    """A constant map: keyword, with a space before it, to its rules. Written as SQL, which is parsed at once."""
    by_key: dict[str, list[str]] = {}
    for n, (label, key, rx, level, score) in enumerate(known):
        rule = f"named_struct('n', {n}, 'label', '{label}', 'rx', r'(?<= ){rx}(?= )', 'level', {level}, 'score', {score}D, 'base', {n < len(BASE)})"
        by_key.setdefault(key, []).append(rule)
    return F.expr("map(" + ", ".join(f"' {k}', array({', '.join(v)})" for k, v in by_key.items()) + ")")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and the kept detections with their word spans."""
    known = rules()
    kinds = sorted({k for _, k, _, _, _ in known})
    table_ = rule_table(known)
    form = F.concat(F.lit(" "), F.btrim(F.regexp_replace(lower_az(F.coalesce("text", F.lit(""))), GAPS, " ")), F.lit(" "))
    rows = docs.select("doc_id", form.alias("form")).withColumn("gate", F.col("form").rlike(gate(kinds)))

    def spans(r: Column) -> Column:
        marked = F.split(F.regexp_replace(F.col("form"), r["rx"], F.lit("\x01$0\x02")), " ")
        edges = F.transform(marked, lambda w, i: F.struct((i - 1).alias("at"), w.startswith("\x01").alias("a"), w.endswith("\x02").alias("b")))
        return F.transform(
            F.arrays_zip(F.transform(F.filter(edges, lambda e: e["a"]), lambda e: e["at"]).alias("a"), F.transform(F.filter(edges, lambda e: e["b"]), lambda e: e["at"]).alias("b")),
            lambda z: F.struct(z["a"].alias("start"), (-z["b"] - 1).alias("back"), (-r["level"]).alias("rank"), r["n"].alias("n"), r["label"].alias("label"), r["score"].alias("score"), r["base"].alias("base")),
        )

    keys = F.filter(F.array(*(F.lit(f" {k}") for k in kinds)), lambda k: F.contains(F.col("form"), k))
    rows = rows.withColumn("keys", F.when(F.col("gate"), keys))
    # keys stand outside every lambda: the optimiser may move them here, and they are still found once per text
    chosen = F.flatten(F.transform("keys", lambda k: F.element_at(table_, k)))
    hits = F.array_sort(F.flatten(F.transform(F.filter(chosen, lambda r: F.regexp_like(F.col("form"), r["rx"])), spans)))
    rows = rows.withColumn("hits", F.when(F.col("gate"), hits))
    none = F.lit(-1).cast("int")
    start = F.struct(none.alias("e1"), none.alias("e2"), none.alias("e3"), F.lit("").alias("flags"))

    def step(acc: Column, h: Column) -> Column:
        """Adds a flag a detection: an aggregate copies its state at every step, and flags are the least that can be copied."""
        end, level = -h["back"], -h["rank"]
        bar = F.when(level >= 3, acc["e3"]).when(level == 2, acc["e2"]).otherwise(acc["e1"])
        return F.struct(
            F.greatest(acc["e1"], end).alias("e1"),
            F.when(level >= 2, F.greatest(acc["e2"], end)).otherwise(acc["e2"]).alias("e2"),
            F.when(level >= 3, F.greatest(acc["e3"], end)).otherwise(acc["e3"]).alias("e3"),
            F.concat(acc["flags"], F.when(bar >= end, F.lit("0")).otherwise(F.lit("1"))).alias("flags"),
        )

    # a column that a lambda names may be moved into it and computed once per element, so the flags come in by position
    flags = F.split(F.aggregate("hits", start, step, lambda a: a["flags"]), "")
    marked = F.filter(F.arrays_zip(F.col("hits").alias("h"), flags.alias("f")), lambda z: z["f"] == "1")
    stands = F.transform(marked, lambda z: F.struct(z["h"]["start"].alias("start"), (-z["h"]["back"]).alias("end"), z["h"]["label"].alias("label"), z["h"]["score"].alias("score")))
    base = F.filter("hits", lambda h: h["base"])
    places = F.transform(base, lambda h: h["start"])
    done = rows.withColumn("base", base).withColumn("places", places).withColumn("kept", stands)
    names = lambda found: F.transform(found, lambda h: h["label"])
    text = lambda labels: F.coalesce(F.array_join(F.array_sort(F.array_distinct(labels)), ","), F.lit(""))
    bare = F.length("form") - F.length(F.replace(F.col("form"), F.lit(" "), F.lit("")))
    return done.select(
        "doc_id",
        F.when(F.col("form") == "  ", F.lit(0)).otherwise(bare - 1).cast("bigint").alias("n_words"),
        F.coalesce(F.size("base"), F.lit(0)).cast("bigint").alias("n_base"),
        F.array_min("places").cast("bigint").alias("first_word"),
        F.array_max("places").cast("bigint").alias("last_word"),
        text(names("base")).alias("base_labels"),
        text(F.concat(names("base"), names("kept"))).alias("labels"),
        F.coalesce(F.array_max(F.transform("kept", lambda h: h["score"])), F.lit(0.0)).alias("score"),
        F.coalesce("kept", F.array().cast("array<struct<start:int,end:int,label:string,score:double>>")).alias("detections"),
    )


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(only(table(spark, sf_dir, "documents"), "doc_id", "text")).drop("detections")
