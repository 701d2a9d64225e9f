"""Comments that look like annotations but link nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import id_prefix, nearest
from .analysis import enclosing

#: Verbs that annotations are read with. Fixed values.
VERBS = ("spec", "implement", "implements", "test", "tests", "see", "reference", "references", "not_spec")
#: A word of letters, hyphens and a number at the end. Fixed value.
ID_LIKE = r"\b[A-Za-z]{2,}(?:-[A-Za-z]{2,})*-\d+\b"


def dead_annotations(files: DataFrame, specs: DataFrame) -> DataFrame:
    """(path, line, at, verb, known, payload) of ``@word: ...`` in files (path, content) that the linker passes over:
    the word is no verb, or nothing after it has the form of an id with a prefix that the specs use."""
    line = files.where(F.col("content").contains("@")).select("path", F.posexplode(F.split("content", "\n")).alias("n", "text")).where(F.col("text").contains("@"))
    hits = line.select("path", (F.col("n") + 1).alias("line"), F.posexplode(F.regexp_extract_all("text", F.lit(r"@(\w+\s*[:=][^\r@]*)"), F.lit(1))).alias("at", "hit"))
    hits = hits.select("path", "line", "at", F.regexp_extract("hit", r"^\w+", 0).alias("verb"), F.trim(F.regexp_replace("hit", r"^\w+\s*[:=]", "")).alias("payload"))
    hits = hits.withColumn("known", F.lower("verb").isin(*VERBS))
    prefixes = specs.select(F.lower(id_prefix(F.col("spec_id"))).alias("prefix")).where("prefix <> ''").distinct()
    named = hits.where("known").select("path", "line", "at", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("payload", F.lit(r"([A-Za-z0-9]+(?:-[A-Za-z0-9]+)*)-\d+"), F.lit(1)), F.lower))).alias("prefix"))
    good = named.join(prefixes, "prefix", "left_semi").select("path", "line", "at").distinct()
    return hits.join(good, ["path", "line", "at"], "left_anti").select("path", "line", "at", "verb", "known", "payload")


def verb_groups(dead: DataFrame) -> DataFrame:
    """(verb, n, reason, did_you_mean) of ``dead_annotations``. The suggestion goes by the word's first place: ``@spec``
    if an id follows, else the verb of least edit distance; known verbs have none."""
    g = dead.groupBy("verb").agg(F.count("*").alias("n"), F.first("known").alias("known"), F.min(F.struct("path", "line", "at", "payload")).alias("f"))
    guess = F.when(F.col("f.payload").rlike(ID_LIKE), "@spec").otherwise(F.concat(F.lit("@"), nearest(F.col("verb"), list(VERBS), 1000)))
    return g.select(F.concat(F.lit("@"), "verb").alias("verb"), "n", F.when(F.col("known"), "token_shape").otherwise("unrecognized_verb").alias("reason"), F.when(~F.col("known"), guess).alias("did_you_mean"))


def verb_samples(dead: DataFrame, symbols: DataFrame, most: int = 10) -> DataFrame:
    """(verb, path, line, qualified_name, payload): the first ``most`` places of each word, with the symbol around it."""
    nth = F.row_number().over(Window.partitionBy("verb").orderBy("path", "line", "at"))
    some = dead.withColumn("nth", nth).where(F.col("nth") <= most).withColumn("place_id", F.concat_ws(":", "path", "line", "at"))
    around = enclosing(symbols.where("kind <> 'module'").select("symbol_id", "qualified_name", "file_path", "start_line", "end_line"), some.select("place_id", "path", "line")).select("place_id", "qualified_name")
    return some.join(around, "place_id", "left").select(F.concat(F.lit("@"), "verb").alias("verb"), "path", "line", "qualified_name", F.substring("payload", 1, 40).alias("payload"))
