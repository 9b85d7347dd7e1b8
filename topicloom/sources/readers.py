"""Readers for the reference's file formats (SRC-1..12).

Line-per-record text keeps a real line number per file. It is computed in
parallel: every file split is read by its own task, each split counts its
lines, a small window over the splits of a file gives each split's first
line number, and a row's line number is that offset plus its position in
the split. No file is read whole into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.functions.dates import ymd_to_mdy
from topicloom.functions.text import clean_text, first_token, html_to_text
from topicloom.operators.scans import running_sum

# The file-name pattern of run outputs (greedy: a corpus name may
# hold underscores) and the header row of a vector file.
RUN_FILE = r"^(\w+)_(\w+)_(\w+)_(\w+)_(\w+)_(\w+)\.json$"
HEADER_ROW = r"^\s*[0-9]+\s+[0-9]+\s*$"


def read_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """SRC-1/2/3: (file, line_no, value), line_no 0-based per file."""
    r = spark.read.option("lineSep", "\n")
    if glob:
        r = r.option("pathGlobFilter", glob)
    raw = r.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("_mid"))
    per_split = raw.groupBy("file", "split").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    w = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offs = per_split.select("file", "split", "_m0",
                            F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (raw.join(offs, ["file", "split"])
            .select("file", (F.col("_off") + F.col("_mid") - F.col("_m0")).alias("line_no"), "value"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1: one document per line -> (doc_id, text); doc_id = line number.

    For several files, documents are numbered file by file in path order.
    """
    lines = read_lines(spark, path)
    sizes = lines.groupBy("file").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("file", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))
    return lines.join(base, "file").select((F.col("_base") + F.col("line_no")).alias("doc_id"),
                                           F.col("value").alias("text"))


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """(folder, line_no, value) of text exports: the lines of each folder, its
    part files one after the other by name, as they were written in order."""
    lines = read_lines(spark, path).withColumn("folder", F.regexp_replace("file", "/[^/]*$", ""))
    sizes = lines.groupBy("folder", "file").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("folder").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("file", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))
    return lines.join(base, "file").select("folder", (F.col("_base") + F.col("line_no")).alias("line_no"), "value")


def folder_key(name: str) -> Column:
    """The value of a partition folder ``name=value`` in ``folder``."""
    return F.url_decode(F.regexp_extract("folder", f"/{name}=([^/]*)", 1))


def read_caption_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC-2: (file, line_no, raw) from ``*.srt`` files."""
    return read_lines(spark, path, "*.srt").withColumnRenamed("value", "raw")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3: (file, line_no, line)."""
    return read_lines(spark, path).withColumnRenamed("value", "line")


def parse_word_vector_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """SRC-4: 'word f f f' lines -> (word, features array<float>); header rows
    ('samples dim') are recognised by shape, so no first word is lost."""
    parts = F.split(F.trim(F.col(value)), r"\s+", -1)
    return (lines.filter(~F.col(value).rlike(HEADER_ROW) & (F.trim(F.col(value)) != ""))
            .select(F.element_at(parts, 1).alias("word"),
                    F.transform(F.slice(parts, 2, F.size(parts)), lambda x: x.try_cast("float")).alias("features")))


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    return parse_word_vector_lines(spark.read.text(path))


def parse_topic_csv(lines: DataFrame, value: str = "value", order: str = "line_no", keys=()) -> DataFrame:
    """SRC-5: 'id, w1 w2 ...' -> (keys, cluster, words); the last line of a
    repeated id wins (per ``keys``, e.g. the file or run)."""
    f = lines.filter(F.trim(F.col(value)) != "")
    parts = F.split(F.col(value), ",", 2)
    words = F.filter(F.split(F.trim(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))), r"\s+", -1),
                     lambda x: x != "")
    rows = f.select(*keys, F.trim(F.try_element_at(parts, F.lit(1))).alias("cluster"), words.alias("words"), order)
    return rows.groupBy(*keys, "cluster").agg(F.max_by("words", order).alias("words"))


def read_topic_csv(spark: SparkSession, path: str) -> DataFrame:
    return parse_topic_csv(read_lines(spark, path))


def parse_json_map(text: Column, value_type: str) -> Column:
    """SRC-6 / UDF-1: a JSON object -> map (NaN literals accepted); bad JSON -> null."""
    return F.from_json(text, f"map<string,{value_type}>", {"allowNonNumericNumbers": "true", "mode": "PERMISSIVE"})


# A whole entry of an object whose values are numbers, NaN included.
ENTRY = r'(?s)^\s*"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*:\s*[-+0-9.eEINafinty]+\s*$'


def read_json_entries(spark: SparkSession, path: str, value_type: str = "bigint", glob: str | None = None) -> DataFrame:
    """SRC-6: (file, key, value) of files that are one JSON object of numbers each.

    The files are split at commas, so a large object is read by many tasks and
    no row holds more than an entry. A piece with a key's two quotes and a
    number is an entry. Other pieces are parts of keys that hold commas: they
    are put together again in order, with a running count of the quotes that
    begin and end a key, in blocks of pieces (``scans.running_sum``); only
    these few are sorted. Entries that are no JSON are passed over; a key
    given twice has two rows.
    """
    r = spark.read.option("lineSep", ",")
    if glob:
        r = r.option("pathGlobFilter", glob)
    pieces = r.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                                 F.monotonically_increasing_id().alias("at"))
    # the object's own braces stand outside all keys: before the first quote, after the last number
    bare = F.regexp_replace(F.regexp_replace("value", r"^\s*\{", ""), r"\}\s*$", "")
    pieces = pieces.withColumn("entry", bare)
    whole = pieces.filter(F.col("entry").rlike(ENTRY)).select("file", "entry")
    quotes = F.length(F.regexp_replace(F.regexp_replace("value", r"(?s)\\.", ""), '[^"]', ""))
    parts = pieces.filter(~F.col("entry").rlike(ENTRY)).withColumn("quotes", quotes)
    # a split's pieces are numbered in order; a block is 65,536 of them within it
    counted = running_sum(parts, ["file"], ["split", "at"], F.struct("split", F.shiftright("at", 16).alias("block")), "quotes", "seen")
    # keys begin at odd quotes: what follows up to the even one belongs to the same entry
    joined = (counted.groupBy("file", F.ceil(F.col("seen") / 2).alias("_n"))
              .agg(F.array_sort(F.collect_list(F.struct("split", "at", "value"))).alias("_p"))
              .select("file", F.array_join(F.transform("_p", lambda p: p["value"]), ",").alias("value")))
    mended = joined.select("file", F.regexp_replace(F.regexp_replace("value", r"^\s*\{", ""), r"\}\s*$", "").alias("entry")).filter(F.col("entry").rlike(ENTRY))
    maps = whole.unionByName(mended).select("file", parse_json_map(F.concat(F.lit("{"), "entry", F.lit("}")), value_type).alias("m"))
    return maps.select("file", F.explode("m").alias("key", "value"))


def read_unigram_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC-6: {"w": n} -> (token, n)."""
    return read_json_entries(spark, path).select(F.col("key").alias("token"), F.col("value").alias("n"))


def read_bigram_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC-6: {"w1 w2": n} -> (w1, w2, n)."""
    e = read_json_entries(spark, path)
    return e.select(F.substring_index("key", " ", 1).alias("w1"), F.substring_index("key", " ", -1).alias("w2"), F.col("value").alias("n"))


def parsed(rows: DataFrame, parse, of: str | None = None, value: str = "value", out: str = "parsed") -> DataFrame:
    """UDF-1: ``rows`` with ``parse`` (Column -> Column) of a text column; a parser
    that gives no column, or another type than ``of`` (a DDL type; unless it is
    None), raises before a job is run. What it can't parse is for it to mark null."""
    made = parse(F.col(value))
    name = getattr(parse, "__name__", "parse")
    if not isinstance(made, Column):
        raise TypeError(f"{name} gives {type(made).__name__}, not a column")
    df = rows.withColumn(out, made)
    if of is not None:
        want = rows.sparkSession.range(0).select(F.lit(None).cast(of).alias("_t")).schema["_t"].dataType.simpleString()
        kind = df.schema[out].dataType.simpleString()
        if kind != want:
            raise TypeError(f"{name} gives {kind}, not {want}")
    return df


def read_objects(spark: SparkSession, path: str, parse, of: str | None = None, glob: str | None = None) -> DataFrame:
    """UDF-1: (name, parsed) of small files, each parsed whole by ``parse``."""
    r = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    raw = r.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value")
    return parsed(raw, parse, of).select("name", "parsed")


EVALUATION = "map<string,struct<mean:double,median:double>>"


def evaluation(value: Column) -> Column:
    """The default parser of evaluation files: cluster -> (mean, median)."""
    return parse_json_map(value, "struct<mean:double,median:double>")


def read_evaluations(spark: SparkSession, path: str, max_k: int | None = 1000, parse=evaluation) -> DataFrame:
    """SRC-7: evaluation files -> ``parse_evaluations``. A file is one run's JSON object."""
    raw = spark.read.text(path, wholetext=True).select(
        "value", F.col("_metadata.file_name").alias("name"))
    return parse_evaluations(raw, max_k, parse)


def parse_evaluations(raw: DataFrame, max_k: int | None = 1000, parse=evaluation) -> DataFrame:
    """(name, value) of files named corpus_embed_variant_k_kind_x.json ->
    (corpus, embed, variant, k, kind, cluster, mean, median); other names
    and unparsable files are skipped; runs with k > ``max_k`` dropped (FLT-11).
    ``parse`` turns a file's text into a map of its clusters (UDF-1)."""
    raw = raw.filter(F.col("name").rlike(RUN_FILE))
    cols = {c: F.regexp_extract("name", RUN_FILE, i) for i, c in
            enumerate(["corpus", "embed", "variant", "k", "kind"], start=1)}
    e = parsed(raw, parse, EVALUATION, out="m")
    e = e.select(*[v.alias(k) for k, v in cols.items()], "m").filter(F.col("m").isNotNull())
    e = e.withColumn("k", F.col("k").try_cast("int"))
    if max_k is not None:
        e = e.filter(F.col("k") <= max_k)
    return e.select("corpus", "embed", "variant", "k", "kind", F.explode("m").alias("cluster", "s")) \
        .select("corpus", "embed", "variant", "k", "kind", "cluster",
                F.col("s.mean").alias("mean"), F.col("s.median").alias("median"))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8: tab-separated file with a header row (ORD-7)."""
    return spark.read.csv(path, sep="\t", header=True)


def records(lines: DataFrame) -> DataFrame:
    """(file, line_no, value) lines -> records, whose quoted fields may hold line
    breaks; line_no is that of a record's first line.

    A line with an odd number of quotes begins or ends a record of several
    lines, in turns. Only such lines are put in order (two levels); lines
    outside are handed on as they are, and only the others are grouped."""
    odd = lines.filter(F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1).select("file", "line_no", F.lit(1).alias("_one"))
    turns = running_sum(odd, ["file"], ["line_no"], F.floor(F.col("line_no") / 4096), "_one", "_turn")
    spans = turns.groupBy("file", F.ceil(F.col("_turn") / 2).alias("_n")).agg(F.min("line_no").alias("_first"), F.max("line_no").alias("_last"))
    inside = spans.select(F.col("file").alias("_file"), "_first", F.explode(F.sequence("_first", "_last")).alias("_line"))
    marked = lines.join(inside, (F.col("file") == F.col("_file")) & (F.col("line_no") == F.col("_line")), "left")
    single = marked.filter("_first IS NULL").select("file", "line_no", "value")
    several = (marked.filter("_first IS NOT NULL").groupBy("file", "_first")
               .agg(F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("_l"))
               .select("file", F.col("_first").alias("line_no"), F.array_join(F.transform("_l", lambda x: x["value"]), "\n").alias("value")))
    return single.unionByName(several)


def read_articles(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """SRC-8, SET-5: tab-separated articles of one or many files, each with the
    same header -> (file, line_no, the header's columns), one row per record.

    Files are split and read by many tasks; (file, line_no) identifies a
    record however often it is read. Fields may be quoted (a quote inside is
    doubled), and with ``multi_line`` hold line breaks; missing columns are
    null, surplus ones are left out, blank lines are no records.
    """
    names = spark.read.csv(path, sep="\t", header=True, escape='"').columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    lines = read_lines(spark, path)
    rows = records(lines) if multi_line else lines
    rows = rows.filter((F.col("line_no") > 0) & (F.trim("value") != ""))
    ddl = ", ".join(f"`{n}` string" for n in names)
    parsed = F.from_csv("value", ddl, {"sep": "\t", "escape": '"', "mode": "PERMISSIVE"})
    return rows.select("file", "line_no", parsed.alias("_r")).select("file", "line_no", *(F.col("_r")[f.name].alias(f.name) for f in schema))


def article_corpus(articles: DataFrame, title: str, date: str, text: str) -> DataFrame:
    """JOB-2c from articles: (file, line_no, title, date, mdy, text), the text
    cleaned, the date that of the column's first token (SCL-21), in one row."""
    day = F.try_to_date(F.try_element_at(F.split(F.col(date), " ", -1), F.lit(1)))
    return articles.select("file", "line_no", F.col(title).alias("title"), day.alias("date"), ymd_to_mdy(F.col(date)).alias("mdy"),
                           clean_text(html_to_text(F.coalesce(F.col(text), F.lit("")))).alias("text"))


DEBATE_SCHEMA = T.StructType([T.StructField("date", T.StringType()), T.StructField("location", T.StringType()),
                              T.StructField("url", T.StringType())])


def read_debate_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC-9: 'date|location|url' lines."""
    return spark.read.csv(path, sep="|", schema=DEBATE_SCHEMA)


def parse_debate_line(value: Column) -> Column:
    """SRC-9: one line -> struct(date, location, url)."""
    return F.from_csv(value, DEBATE_SCHEMA.simpleString()[len("struct<"):-1].replace(":", " "), {"sep": "|"})


def parse_ranked_cluster_line(value: Column) -> Column:
    """SRC-10: 'score (w1, w2) [runs]' -> the words inside the parentheses."""
    inside = F.regexp_extract(value, r"\(([^)]*)\)", 1)
    return F.filter(F.split(inside, r",\s*", -1), lambda x: x != "")


def parse_timeseries_json(value: Column) -> Column:
    """SRC-11: the reference's time-series JSON array (nulls allowed)."""
    return F.from_json(value, "array<struct<cluster:array<string>,"
                              "scores:array<struct<date:string,score:bigint>>>>")


def read_series_json(spark: SparkSession, path: str, line: int = 1) -> DataFrame:
    """SRC-11: (file, element, words, date, score) of the reference's series files:
    line ``line`` (from 0) is a JSON array of clusters with their scores.

    The line is split at its opening braces and read by many tasks: a piece
    holds a cluster's head, or one score. Only the pieces with line breaks are
    put in order to find the line; heads are numbered by a two-level count, and
    a score belongs to the head before it. Null elements have no rows. Words
    hold no braces (the cleaning chain leaves none).
    """
    pieces = (spark.read.option("lineSep", "{").text(path)
              .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                      F.monotonically_increasing_id().alias("at"), "value"))
    place = F.struct("split", "at")
    ends = pieces.filter(F.contains("value", F.lit("\n"))).select(
        "file", "split", "at", F.length(F.regexp_replace("value", "[^\n]", "")).alias("_breaks"))
    passed = running_sum(ends, ["file"], ["split", "at"], F.struct("split", F.shiftright("at", 16).alias("block")), "_breaks", "_passed")
    bounds = passed.groupBy(F.col("file").alias("_file")).agg(F.min(F.when(F.col("_passed") >= line, place)).alias("_from"),
                                                              F.min(F.when(F.col("_passed") > line, place)).alias("_to"))
    # the piece that ends the line still begins in it; a line 0 begins with the file
    begins = F.lit(True) if line == 0 else place > F.col("_from")
    own = (pieces.join(bounds, F.col("file") == F.col("_file"), "left")
           .filter(F.coalesce(begins, F.lit(False)) & F.coalesce(place <= F.col("_to"), F.lit(True)))
           .select("file", "split", "at", F.substring_index("value", "\n", 1).alias("value")))
    head = F.col("value").rlike(r'^\s*"cluster"\s*:') | F.col("value").rlike(r'^\s*"scores"\s*:')
    counted = running_sum(own.withColumn("_head", head.cast("int")), ["file"], ["split", "at"],
                          F.struct("split", F.shiftright("at", 16).alias("block")), "_head", "element")
    words = F.from_json(F.regexp_extract("value", r'"cluster"\s*:\s*(\[(?:[^"\]]|"[^"\\]*+(?:\\.[^"\\]*+)*+")*+\])', 1), "array<string>")
    # the words stand before or behind an element's scores
    named = (counted.filter(F.contains("value", F.lit('"cluster"'))).groupBy(F.col("file").alias("_f"), F.col("element").alias("_e"))
             .agg(F.first(words).alias("words")))
    score = F.from_json(F.concat(F.lit("{"), F.substring_index("value", "}", 1), F.lit("}")), "date string, score bigint")
    scores = counted.filter("_head = 0 AND element > 0").select("file", "element", score.alias("s"))
    return (scores.join(named, (F.col("file") == F.col("_f")) & (F.col("element") == F.col("_e")))
            .select("file", F.col("element").cast("bigint").alias("element"), "words", "s.date", "s.score"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """SRC-12: stored pages (page_id, url, html)."""
    return spark.read.parquet(path)


def speaker_keys(lines: DataFrame, value: str = "value") -> DataFrame:
    """SCL-17 as the reference's make target did it: first token of each line."""
    return lines.select(first_token(F.col(value)).alias("speaker")).distinct()
