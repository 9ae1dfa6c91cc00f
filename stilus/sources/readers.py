"""Readers and writers of the corpus file formats, each with an explicit schema."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_aa(spark: SparkSession, path: str) -> DataFrame:
    """(author_id INT, text STRING) of a quoted CSV; an empty field is an empty text."""
    return spark.read.schema("author_id int, text string").options(**_CSV).csv(path).fillna("", ["text"])


def read_av(spark: SparkSession, path: str) -> DataFrame:
    """(same INT, text0, text1); columns count by position, whatever the header calls them."""
    return spark.read.schema("same int, text0 string, text1 string").options(**_CSV, enforceSchema=True).csv(path).fillna("", ["text0", "text1"])


def aa_frame(spark: SparkSession, rows: Iterable[tuple[int, str]]) -> DataFrame:
    """(author_id, text) of rows in memory."""
    return spark.createDataFrame([tuple(r) for r in rows], "author_id int, text string")


def av_frame(spark: SparkSession, rows: Iterable[tuple[int, str, str]]) -> DataFrame:
    """(same, text0, text1) of rows in memory."""
    return spark.createDataFrame([tuple(r) for r in rows], "same int, text0 string, text1 string")


def write_aa(df: DataFrame, path: str) -> None:
    """Quoted CSV, ordered by author and seq where the frame has them; an existing target is an error."""
    order = [x for x in ("author", "author_id", "seq") if x in df.columns]
    if order:
        df = df.orderBy(*order)
    df.drop("seq").write.mode("errorifexists").options(header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="").csv(path)


write_av = write_aa


def write_tsv(df: DataFrame, path: str, text: str, label: str) -> None:
    """text, tab, label, without a header; tabs and line breaks of the text become spaces."""
    plain = F.translate(F.col(text), "\t\n\r", "   ")
    df.select(F.concat_ws("\t", plain, F.col(label).cast("string")).alias("value")).write.mode("errorifexists").text(path)


def append_json(df: DataFrame, path: str) -> None:
    """JSON lines added to what is there."""
    df.write.mode("append").json(path)


def author_table(df: DataFrame, author: str, new_id: str) -> DataFrame:
    """(id, author) of every author, once: what id maps hold."""
    return df.select(F.col(new_id).alias("id"), F.col(author).alias("author")).distinct()


def write_counts(counts: DataFrame, path: str) -> None:
    """(token, n) rows as JSON lines."""
    counts.select("token", "n").write.mode("errorifexists").json(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(token, n) of files that hold one JSON object {token: count}, over any number of lines."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,bigint>").alias("m"))
    return whole.select(F.explode("m").alias("token", "n"))


def pan_result(metrics: DataFrame) -> Column:
    """One text of the figures of a one-row frame, in the block format of evaluation files."""
    return F.concat_ws("\n", *[F.concat(F.lit(f'measure{{\n  key: "{c}"\n  value: "'), F.col(f"`{c}`").cast("string"), F.lit('"\n}')) for c in metrics.columns])


def write_pan_result(metrics: DataFrame, path: str) -> None:
    """The figures as JSON in path/out.json and as blocks in path/evaluation.prototext."""
    metrics.write.mode("errorifexists").json(f"{path}/out.json")
    metrics.select(pan_result(metrics).alias("value")).write.mode("errorifexists").text(f"{path}/evaluation.prototext")


def ranked_text(ranked: DataFrame, doc: str, candidate: str, err: str, rank: str) -> DataFrame:
    """(doc, value): per document its candidates in the order of their rank, a block of lines each. A list
    per document, of its candidates."""
    line = F.concat(F.lit("Rank="), F.col(rank).cast("string"), F.lit(" Candidate="), F.col(candidate).cast("string"), F.lit(" NormalizedError="), F.col(err).cast("string"))
    per = ranked.select(doc, rank, line.alias("line")).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(rank, "line"))).alias("s"))
    return per.select(doc, F.array_join(F.transform("s", lambda x: x["line"]), "\n").alias("value"))


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """(author_id, text) of JSON lines {author_id, syms: [text]}."""
    return spark.read.schema("author_id string, syms array<string>").json(path).select("author_id", F.explode("syms").alias("text"))


def read_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """(author, topic, text) of review JSON lines in a folder tree: title and body joined, rows without a
    body dropped, the file's name as topic."""
    r = spark.read.schema("reviewerID string, summary string, reviewText string").option("recursiveFileLookup", True).option("pathGlobFilter", "*json*").json(folder)
    return r.where("reviewText IS NOT NULL").select(F.col("reviewerID").alias("author"), F.col("_metadata.file_name").alias("topic"), F.concat_ws(" ", F.coalesce("summary", F.lit("")), "reviewText").alias("text"))


def read_pan(spark: SparkSession, pairs: str, truth: str) -> DataFrame:
    """(id, text0, text1, same) of pair and truth JSON lines joined on id; a pair without truth fails."""
    p = spark.read.schema("id string, pair array<string>").json(pairs)
    t = spark.read.schema("id string, authors array<string>").json(truth)
    missing = F.raise_error(F.concat(F.lit("no truth for pair "), F.col("id")))
    both = p.join(t, "id", "left").withColumn("authors", F.when(F.col("authors").isNull(), missing).otherwise(F.col("authors")))
    return both.select("id", F.col("pair")[0].alias("text0"), F.col("pair")[1].alias("text1"), (F.col("authors")[0] == F.col("authors")[1]).cast("int").alias("same"))


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """(id, value DOUBLE) of answers given as a value or as a truth value."""
    a = spark.read.schema("id string, value double, same boolean").json(path)
    return a.select("id", F.coalesce("value", F.col("same").cast("int").cast("double")).alias("value"))


def read_blogs(spark: SparkSession, folder: str) -> DataFrame:
    """(author_id, gender, age, topic, sign, no, post_date, text) of blog files named
    id.gender.age.topic.sign.xml. The files need not be well-formed: text between post tags is taken,
    lines are trimmed and joined by a space, NULs go, the date before a post is its date."""
    files = spark.read.format("binaryFile").load(folder)
    name = F.split(F.element_at(F.split("path", "/"), -1), r"\.")
    text = F.replace(F.decode("content", "UTF-8"), F.lit("\x00"), F.lit(""))
    parts = F.regexp_extract_all(text, F.lit(r"(?s)(<date>.*?</date>|<post>.*?</post>)"), F.lit(1))
    rows = files.select(name[0].cast("int").alias("author_id"), name[1].alias("gender"), name[2].try_cast("int").alias("age"), name[3].alias("topic"), name[4].alias("sign"), parts.alias("parts"))
    dated = F.aggregate("parts", F.struct(F.lit("").alias("d"), F.array().cast("array<struct<d:string,t:string>>").alias("out")), lambda acc, x: F.when(x.startswith("<date>"), F.struct(F.regexp_extract(x, r"(?s)<date>\s*(.*?)\s*</date>", 1).alias("d"), acc["out"].alias("out"))).otherwise(F.struct(acc["d"].alias("d"), F.concat(acc["out"], F.array(F.struct(acc["d"].alias("d"), F.regexp_extract(x, "(?s)<post>(.*?)</post>", 1).alias("t")))).alias("out"))))
    posts = rows.select("author_id", "gender", "age", "topic", "sign", F.posexplode(dated["out"]).alias("no", "p"))
    lines = F.filter(F.transform(F.split("p.t", r"\r?\n"), lambda s: F.trim(s)), lambda s: s != "")
    return posts.select("author_id", "gender", "age", "topic", "sign", "no", F.col("p.d").alias("post_date"), F.array_join(lines, " ").alias("text"))


def read_folders(spark: SparkSession, folder: str, depth: int = 1, charset: str = "UTF-8") -> DataFrame:
    """(dirs ARRAY, file_name, text): one whole file per row, with its `depth` enclosing folders.
    A byte that the charset doesn't know becomes a replacement character."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    parts = F.split("path", "/")
    own = f.select(F.slice(parts, F.size(parts) - depth, depth).alias("dirs"), F.element_at(parts, -1).alias("file_name"), "content")
    if charset.upper() in ("UTF-8", "US-ASCII", "ISO-8859-1", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32"):
        return own.select("dirs", "file_name", F.decode("content", charset).alias("text"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["dirs", "file_name"]].assign(text=[bytes(b).decode(charset, "replace") for b in batch["content"]])

    return own.mapInPandas(decode, "dirs array<string>, file_name string, text string")


def read_pattern(spark: SparkSession, folder: str, pattern: str, fields: tuple[str, ...], charset: str = "windows-1252", fixes: dict[str, str] | None = None, depth: int = 2) -> DataFrame:
    """(dirs, file_name, fields, text) of files whose names tell them apart: each group of the pattern is
    a field. A name that doesn't match fails the query; `fixes` renames known mistaken names on reading."""
    files = read_folders(spark, folder, depth, charset)
    name = F.col("file_name")
    for wrong, right in (fixes or {}).items():
        name = F.when(F.col("file_name") == wrong, right).otherwise(name)
    named = files.withColumn("file_name", name)
    bad = F.raise_error(F.concat(F.lit("no match for file "), F.col("file_name")))
    whole = rf"^(?:{pattern})$"
    checked = named.withColumn("__n", F.when(F.col("file_name").rlike(whole), F.col("file_name")).otherwise(bad))
    return checked.select("dirs", F.col("__n").alias("file_name"), *[F.regexp_extract("__n", whole, i + 1).alias(f) for i, f in enumerate(fields)], "text")


# How files of the correlated corpus are named, and the one known mistake.
CORRELATED = (r"([A-Z]\d+)([A-Z])\d+([A-Z])\d+\.txt", ("author", "genre", "topic"), {"S1D113.txt": "S1D1I3.txt"})


def read_splits(spark: SparkSession, folder: str, charset: str = "UTF-8") -> DataFrame:
    """(split, author, file_name, text) of folders split/author/file; a file's lines joined by spaces."""
    f = read_folders(spark, folder, 2, charset)
    lines = F.filter(F.transform(F.split("text", r"\r?\n"), lambda s: F.trim(s)), lambda s: s != "")
    return f.select(F.col("dirs")[0].alias("split"), F.col("dirs")[1].alias("author"), "file_name", F.array_join(lines, " ").alias("text"))


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(author, file_name, text) of folders author/file with a record a line; the line break isn't kept.
    Lines are read where they lie, a file may be of any size."""
    rows = spark.read.option("recursiveFileLookup", True).text(folder)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return rows.select(F.element_at(parts, -2).alias("author"), F.element_at(parts, -1).alias("file_name"), F.col("value").alias("text"))


def read_tsv(spark: SparkSession, path: str, arity: int) -> DataFrame:
    """f0..fn of tab-separated lines of exactly `arity` fields; another line fails the query."""
    parts = F.split(F.replace("value", F.lit("\x00"), F.lit("")), "\t")
    bad = F.raise_error(F.concat(F.lit("a line without the right number of fields: "), F.substring("value", 1, 100)))
    rows = spark.read.text(path).select(F.when(F.size(parts) == arity, parts).otherwise(bad).alias("p"))
    return rows.select(*[F.col("p")[i].alias(f"f{i}") for i in range(arity)])


def repaired(lines: Iterable[str], arity: int = 4) -> Iterator[list[str]]:
    """Records of `arity` fields from tab-separated lines. Of a line of another number of fields the
    trimmed fields of more than one character are kept until `arity` of them have come together, which
    are a record, and stay one for each broken line after it that adds none; more are thrown away."""
    kept: list[str] = []
    for line in lines:
        fields = line.replace("\0", "").rstrip("\r\n").split("\t")
        if len(fields) != arity:
            kept += [f for f in map(str.strip, fields) if len(f) > 1]
            if len(kept) > arity:
                kept = []
                continue
            if len(kept) < arity:
                continue
            fields = list(kept)
        yield fields


def read_tweets(spark: SparkSession, path: str) -> DataFrame:
    """(user BIGINT, seq, text) of tab-separated tweet files (user, tweet, text, time) with broken lines
    mended by `repaired`; rows whose user isn't a number are dropped, and of equal texts the first in a
    file stays. seq orders a file's rows. A file is one task's work: mending needs its lines in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                rows = []
                for i, r in enumerate(repaired(bytes(content).decode("utf-8", "replace").split("\n"))):
                    try:
                        rows.append((int(r[0]), file, i, r[2]))
                    except ValueError:
                        continue
                yield pd.DataFrame(rows, columns=["user", "file", "i", "text"])

    rows = files.mapInPandas(mend, "user long, file string, i long, text string")
    first = rows.groupBy("text").agg(F.min(F.struct("file", "i", "user")).alias("s"))
    return first.select("s.user", F.concat_ws("#", "s.file", F.lpad(F.col("s.i").cast("string"), 12, "0")).alias("seq"), "text")


def read_lexicon(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(word) in small letters of a lexicon file: `stopwords` a word a line as it stands; `misspelled`
    what stands after //, cut at commas; `typos` a line's last word; `british` the words before the first
    tab; `determiner` a line's first word."""
    v, low = F.col("value"), F.lower(F.col("value"))
    piece = {
        "stopwords": F.array(F.trim(v)), "misspelled": F.split(F.get(F.split(low, "//"), F.lit(1)), ","), "typos": F.array(F.element_at(F.split(F.trim(low), r"\s+"), -1)),
        "british": F.split(F.trim(F.split(low, "\t")[0]), r"\s+"), "determiner": F.array(F.split(F.trim(low), r"\s+")[0]),
    }
    if kind not in piece:
        raise ValueError(f"unknown lexicon {kind}; known: {sorted(piece)}")
    return spark.read.text(path).select(F.explode(piece[kind]).alias("w")).select(F.trim("w").alias("word")).where("word <> ''").distinct()


#: A linguistic entry as it lies in JSON cells.
ENTRY = "struct<preprocessed:string,pos_tags:array<string>,pos_tag_chunks:array<string>,pos_tag_chunk_subtrees:array<string>,tokens:array<string>>"


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """(same INT, entry0, entry1) of CSV files without a header: label and two entries as JSON cells."""
    r = spark.read.schema("same int, a string, b string").options(**{**_CSV, "header": False}).csv(path)
    return r.select("same", F.from_json("a", ENTRY).alias("entry0"), F.from_json("b", ENTRY).alias("entry1"))


def write_entries(df: DataFrame, path: str) -> None:
    """The reverse of `read_entries`."""
    df.select("same", F.to_json("entry0").alias("a"), F.to_json("entry1").alias("b")).write.mode("errorifexists").options(header=False, quote='"', escape='"', quoteAll=True).csv(path)


MARK, SPARE = "$$$", "&&&"


def packed(a: Column, b: Column) -> Column:
    """Two texts in one, parted by $$$; a $$$ of their own becomes &&&."""
    own = lambda c: F.replace(c, F.lit(MARK), F.lit(SPARE))
    return F.concat(own(a), F.lit(MARK), own(b))


def unpacked(t: Column) -> tuple[Column, Column]:
    """The first and the last part of a text parted by $$$."""
    p = F.split(t, r"\$\$\$")
    return p[0], F.element_at(p, -1)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector) of a matrix written by `write_matrix`."""
    return spark.read.schema("id long, vector array<float>").parquet(path)


def write_matrix(df: DataFrame, path: str) -> None:
    """(id, vector) rows as Parquet, the vector as floats."""
    df.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector")).write.mode("errorifexists").parquet(path)


def read_packed_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(same, text0, text1) of TSV rows sentiment, doc1$$$doc2 (first and last part)."""
    r = spark.read.schema("same int, review string").options(header=True, sep="\t").csv(path)
    a, b = unpacked(F.col("review"))
    return r.select("same", a.alias("text0"), b.alias("text1"))


def read_vectors(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """(word, vector ARRAY<FLOAT>) of a text file of word vectors; rows of another length are dropped."""
    p = F.split("value", " ")
    v = F.transform(F.slice(p, 2, dims), lambda x: x.try_cast("float"))
    return spark.read.text(path).where(F.size(p) == dims + 1).select(p[0].alias("word"), v.alias("vector")).where(F.forall("vector", lambda x: x.isNotNull()))
