"""Icons for labels that state none: by phrases, by words, by kind of container, and for whole lists of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: phrases and words are looked for in this order of ``ord``; fallback has an icon for kinds of container.
PHRASES, WORDS, FALLBACK = "phrase string, icon string, ord int", "word string, icon string", "kind string, icon string"
_GRAM = 3


def plain_label(label: Column) -> Column:
    """Lower case, with one space for whatever is no ASCII letter or digit; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(label), "[^a-z0-9]+", " ")), F.lit(""))


def suggested(labels: DataFrame, phrases: DataFrame, words: DataFrame, fallback: DataFrame, drawable: DataFrame) -> DataFrame:
    """labels (label, kind, ...) with ``icon`` and ``icon_by``: year (a calendar), phrase, word, kind or null.

    Of the phrases that a label holds, anywhere, the first by ``ord`` counts, whichever is longer; then the label's first word that is
    known; then the kind of container (never ``page``). Icons that drawable (name) lacks are passed over. Labels are looked at once
    each; a phrase meets them on its first characters and is then looked for."""
    can = drawable.select(F.col("name").alias("icon")).distinct()
    one = labels.select(plain_label(F.col("label")).alias("text")).filter("text IS NOT NULL").distinct()
    p = phrases.join(can, "icon").select("icon", "ord", plain_label(F.col("phrase")).alias("phrase")).filter("phrase IS NOT NULL")
    p = p.withColumn("gram", F.substring("phrase", 1, _GRAM))
    places = F.sequence(F.lit(1), F.length("text"))
    grams = F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(*[F.substring(F.col("text"), i, F.lit(k)) for k in range(1, _GRAM + 1)]))))
    held = one.select("text", F.explode(grams).alias("gram")).join(p, "gram").filter(F.contains("text", "phrase"))
    by_phrase = held.groupBy("text").agg(F.min_by("icon", F.struct("ord", "phrase")).alias("of_phrase"))
    w = words.join(can, "icon").groupBy("word").agg(F.min("icon").alias("icon"))
    said = one.select("text", F.posexplode(F.split("text", " ")).alias("n", "word")).join(w, "word")
    by_word = said.groupBy("text").agg(F.min_by("icon", "n").alias("of_word"))
    known = one.join(by_phrase, "text", "left").join(by_word, "text", "left")
    calendar = can.filter("icon = 'calendar'").select(F.lit(True).alias("has_calendar"), F.lit(1).alias("always"))
    of_kind = fallback.join(can, "icon").groupBy("kind").agg(F.min("icon").alias("of_kind")).filter("kind <> 'page'")
    j = labels.withColumns({"text": plain_label(F.col("label")), "always": F.lit(1)}).join(known, "text", "left").join(of_kind, "kind", "left").join(calendar, "always", "left")
    is_year = F.col("text").rlike("^(?:19|20)[0-9]{2}$")
    by = F.when(F.col("text").isNull(), None).when(is_year, F.when(F.col("has_calendar"), "year")).when(F.col("of_phrase").isNotNull(), "phrase").when(F.col("of_word").isNotNull(), "word").when(F.col("of_kind").isNotNull(), "kind")
    j = j.withColumn("icon_by", by)
    icon = F.when(F.col("icon_by") == "year", "calendar").when(F.col("icon_by") == "phrase", F.col("of_phrase")).when(F.col("icon_by") == "word", F.col("of_word")).when(F.col("icon_by") == "kind", F.col("of_kind"))
    return j.withColumn("icon", icon).select(*labels.columns, "icon", "icon_by")


def filled(pages: DataFrame, container: str, filler: str, share: float = 0.5) -> DataFrame:
    """pages (container, stated, icon, ...) with ``shown``: the icon each page of a container is drawn with.

    Where any page states one, all keep what they state. Else, if at least ``share`` of them have a suggestion, each gets it or the
    filler; if fewer have one, none gets any. A container's pages are counted, never gathered."""
    of = F.col(container)
    whole = Window.partitionBy(of)
    stated = F.nullif(F.trim("stated"), F.lit(""))
    j = pages.withColumns({"__any": F.count(stated).over(whole), "__named": F.count("icon").over(whole), "__all": F.count("*").over(whole)})
    shown = F.when(F.col("__any") > 0, stated).when(F.col("__named") >= share * F.col("__all"), F.coalesce("icon", F.lit(filler)))
    return j.withColumn("shown", shown).drop("__any", "__named", "__all")
