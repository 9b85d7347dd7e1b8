"""Inputs that the jobs need and the driver tables do not hold directly.

All of them are Spark expressions over the driver tables (their size grows
with the tables): topic runs from document word counts, caption files and
transcripts from document and conversation text, dated titles, word
vectors from ``embeddings``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from topicloom.functions.text import tokens
from topicloom.plans.tables import cleaned_corpus, table

TOPIC_MODELS = ("lang", "source")
TOPIC_KS = (1, 4, 10)


def cleaned_with_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned_corpus(spark, sf_dir)


def topic_runs(spark: SparkSession, sf_dir: str, corpus: DataFrame | None = None) -> DataFrame:
    """(run, model, k, cluster, words): the top-k words of each lang / source.
    ``corpus``: the cleaned corpus, if the caller has it as a table.

    One "run" per (model, k); a cluster is one lang or source value, its
    words the k most frequent cleaned tokens (ties by token). These stand
    in for the clustering runs of a sweep over K.
    """
    d = cleaned_with_meta(spark, sf_dir) if corpus is None else corpus
    toks = d.select("lang", "source", F.explode(tokens(F.col("text"))).alias("token"))
    counts = toks.groupBy("lang", "source", "token").agg(F.count(F.lit(1)).alias("c"))
    groups = F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("grp")) for m in TOPIC_MODELS))
    per_model = (counts.select(F.inline(groups), "token", "c").groupBy("model", "grp", "token").agg(F.sum("c").alias("c")))
    kmax = max(TOPIC_KS)
    w = Window.partitionBy("model", "grp").orderBy(F.col("c").desc(), F.col("token"))
    top = per_model.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= kmax)
    ks = F.array(*[F.lit(k) for k in TOPIC_KS])
    top = top.withColumn("k", F.explode(F.filter(ks, lambda k: k >= F.col("r"))))
    grouped = (top.groupBy("model", "k", "grp")
               .agg(F.array_sort(F.collect_list(F.struct("r", "token"))).alias("rt"))
               .withColumn("words", F.transform("rt", lambda s: s["token"])))
    cid = F.dense_rank().over(Window.partitionBy("model", "k").orderBy("grp")) - 1
    return grouped.select(F.concat_ws("_", "model", F.col("k").cast("string")).alias("run"),
                          "model", F.col("k").cast("int").alias("k"),
                          cid.cast("int").alias("cluster"), "words")


def caption_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-shaped raw lines from documents: each text line k of a document
    becomes a block (index, time code, text, blank); file = doc_id."""
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("k", "L"))
    mm, ss = (F.floor(F.col("k") / 60) % 60).cast("int"), (F.col("k") % 60).cast("int")
    tc = F.format_string("00:%02d:%02d,000 --> 00:%02d:%02d,900", mm, ss, mm, ss)
    blocks = F.array(
        F.struct(F.lit(0).alias("off"), (F.col("k") + 1).cast("string").alias("raw")),
        F.struct(F.lit(1).alias("off"), tc.alias("raw")),
        F.struct(F.lit(2).alias("off"), F.col("L").alias("raw")),
        F.struct(F.lit(3).alias("off"), F.lit("").alias("raw")))
    return d.select("file", "k", F.explode(blocks).alias("b")).select(
        "file", (F.col("k") * 4 + F.col("b.off")).cast("long").alias("line_no"), F.col("b.raw").alias("raw"))


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript lines from conversations: ``ROLE: text`` split on newlines,
    so later lines of a turn are unlabelled continuations; file = conv_id."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("file"), "turn",
                    F.posexplode(F.split(F.concat(F.upper("role"), F.lit(": "), F.col("text")), "\n", -1))
                    .alias("sub", "line"))


def order_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, title, month, day, year): dated titles from order dates.

    Four spellings rotate with the order key: month-day-two-digit-year in
    brackets, day.month.year (day first), a leading number that captures
    the match, and an undated year (before 2014). Years move 22 years on so
    that most of them fall in the dated range.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d0"))
    d = F.add_months(F.col("d0"), 12 * 22)
    m, dd = F.month(d).cast("string"), F.dayofmonth(d).cast("string")
    y4, y2 = F.year(d).cast("string"), F.lpad((F.year(d) % 100).cast("string"), 2, "0")
    v = F.col("o_orderkey") % 4
    title = (F.when(v == 0, F.concat(F.lit("Rally in Town ("), m, F.lit("-"), dd, F.lit("-"), y2, F.lit(")")))
             .when(v == 1, F.concat(F.lit("Speech "), dd, F.lit("."), m, F.lit("."), y4))
             .when(v == 2, F.concat(F.lit("10,000 Plus ("), m, F.lit("-"), dd, F.lit("-"), y2, F.lit(")")))
             .otherwise(F.concat(F.lit("Event "), F.month("d0").cast("string"), F.lit("/"),
                                 F.dayofmonth("d0").cast("string"), F.lit("/"), F.year("d0").cast("string"))))
    return o.select("o_orderkey", title.alias("title"), m.alias("month"), dd.alias("day"), y4.alias("year"),
                    d.alias("shifted"))
