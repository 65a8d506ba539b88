"""Sequence files, identifier lists, typed tables and tool outputs as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from peptora.functions.sequence import accession, normalised
from peptora.sources.objects import object_entries


def read_fasta(spark: SparkSession, path: str, strict_id: bool = True, strict: bool = False) -> DataFrame:
    """acc, seq, header, length, sequence_hash, file of every record under ``path``.

    A record begins at a line that starts with ``>``; files are split between tasks there.
    Records without residues stay, with an empty sequence, for ``empty_records`` to name.
    ``strict``: an input without any record is an error, and so is, once its row is read, an empty sequence.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_name").alias("file"))
    text = F.regexp_replace("value", "^>", "")
    head = F.trim(F.regexp_replace(F.regexp_extract(text, r"^([^\n]*)", 1), "\r$", ""))
    seq = normalised(F.regexp_replace(text, r"^[^\n]*", ""))
    got = raw.where(F.trim("value") != "")
    if strict:
        if not spark.read.text(path).where(F.startswith("value", F.lit(">"))).limit(1).count():
            raise ValueError(f"no record in {path}")
        seq = F.when(seq == "", F.raise_error(F.concat(F.lit("empty sequence of "), head))).otherwise(seq)
    got = got.select(head.alias("header"), seq.alias("seq"), "file")
    return got.select(accession(F.col("header"), strict_id).alias("acc"), "seq", "header", F.length("seq").alias("length"), F.sha2("seq", 256).alias("sequence_hash"), "file")


def empty_records(records: DataFrame) -> DataFrame:
    return records.where("seq = ''").select("acc", F.lit("empty sequence").alias("error"))


def read_masked_fasta(spark: SparkSession, path: str) -> DataFrame:
    """acc, label: 1 where a residue is masked (lower case or x)."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    text = F.regexp_replace("value", "^>", "")
    seq = F.regexp_replace(F.regexp_replace(text, r"^[^\n]*", ""), r"\s", "")
    label = F.transform(F.split(seq, ""), lambda c: F.when(c.rlike("[a-z]|X"), 1).otherwise(0))
    return raw.where(F.trim("value") != "").select(accession(F.regexp_extract(text, r"^([^\n]*)", 1)).alias("acc"), F.when(seq != "", label).otherwise(F.array().cast("array<int>")).alias("label"))


def read_json_cache(spark: SparkSession, path: str, schema: str | StructType, key: str, order: Sequence[str]) -> DataFrame:
    """The last record of each key of an append-only file of JSON lines."""
    from peptora.operators.assemble import last_of_each

    return last_of_each(spark.read.schema(schema).json(path), key, *order)


def write_json_cache(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def id_list(spark: SparkSession, text: str) -> DataFrame:
    """ord, acc of an inline list: commas or white space between, first occurrences in order."""
    words = F.filter(F.split(F.lit(text), r"[,\s]+"), lambda w: w != "")
    got = spark.range(1).select(F.posexplode(words).alias("ord", "acc"))
    return got.groupBy("acc").agg(F.min("ord").alias("ord")).select("ord", "acc").orderBy("ord")


def read_id_file(spark: SparkSession, path: str) -> DataFrame:
    """ord, acc of a file: ``#`` comments and blank lines left out, first occurrences in order."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.trim(F.regexp_replace("value", "#.*", "")).alias("acc")).where("acc != ''")
    return lines.groupBy("acc").agg(F.min("ord").alias("ord")).select("ord", "acc").orderBy("ord")


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """Of tab, semicolon, bar and comma the one most frequent in the first line."""
    first = spark.read.text(path).first()
    line = first["value"] if first else ""
    return max("\t;|,", key=line.count)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A delimited table with a header, all columns text."""
    return spark.read.csv(path, sep=sniff_delimiter(spark, path), header=True)


def read_typed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Tab-separated with exactly this schema; only an empty field is null, anything unreadable fails."""
    return spark.read.schema(schema).csv(path, sep="\t", header=True, nullValue="", mode="FAILFAST", enforceSchema=False)


def write_typed(df: DataFrame, path: str, key: str) -> None:
    """Tab-separated with a header, missing as an empty field. The key may not be null: a row without any value would be lost."""
    if df.where(F.col(key).isNull()).limit(1).count():
        raise ValueError(f"{key} is null in some rows")
    df.write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="", emptyValue="")


def read_below_banner(spark: SparkSession, path: str, required: Sequence[str], sep: str = "\t") -> DataFrame:
    """Tables whose header stands below a banner: in each file the first line that holds all required columns.

    Files may order and name their other columns differently; a column that a file lacks is null in
    its rows. A file without such a line is an error. Lines are kept in order within a file by where
    they stand in it, so no file is gathered.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.col("value"), F.col("_metadata.file_path").alias("file"))
    cells = F.split("value", sep)
    is_head = F.size(F.array_except(F.array(*map(F.lit, required)), F.transform(cells, F.trim))) == 0
    # One row a file: the headers are as few as the files.
    heads = lines.where(F.trim("value") != "").groupBy("file").agg(F.min(F.when(is_head, F.struct("ord", "value"))).alias("head"))
    heads = heads.select("file", F.col("head.ord").alias("head"), F.transform(F.split("head.value", sep), F.trim).alias("names"))
    seen = heads.agg(F.count("*").alias("files"), F.count("head").alias("found"), F.array_distinct(F.flatten(F.collect_set("names"))).alias("names")).first()
    if seen["found"] < seen["files"] or not seen["files"]:
        raise ValueError(f"no header with {', '.join(required)}")
    names = [*required, *sorted({n for n in seen["names"] if n} - set(required))]
    rows = lines.join(heads, "file").where((F.col("ord") > F.col("head")) & (F.trim("value") != "") & ~is_head)

    def cell(name: str) -> Column:
        at = F.array_position("names", name)
        return F.when(at > 0, F.nullif(F.trim(F.get(cells, at.cast("int") - 1)), F.lit("")))

    return rows.select(*[cell(n).alias(n) for n in names])


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """acc, site, organism of a site table (gzip too): a banner, then the header line that begins with GENE."""
    got = read_below_banner(spark, path, ["GENE", "ACC_ID", "MOD_RSD", "ORGANISM"])
    return got.select(F.col("ACC_ID").alias("acc"), F.col("MOD_RSD").alias("site"), F.lower("ORGANISM").alias("organism")).where("acc is not null")


def version_marker(spark: SparkSession, path: str) -> DataFrame:
    """version: the first line that isn't blank."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("version")).limit(1)


def read_lookup(spark: SparkSession, path: str, keys: Sequence[str], value: str) -> DataFrame:
    """acc, value: the key under any of its spellings; blank ids and unreadable numbers go."""
    df = read_table(spark, path)
    have = [F.col(f"`{k}`") for k in keys if k in df.columns]
    if not have:
        raise ValueError(f"none of {', '.join(keys)} is a column")
    got = df.select(F.trim(F.coalesce(*have)).alias("acc"), F.col(f"`{value}`").try_cast("double").alias("value"))
    return got.where("acc != '' and value is not null").dropDuplicates(["acc"])


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """acc, entry_name, organism, seq, single, residue, error of a bulk dump: one JSON object keyed by accession.

    Numbers that can't be read are null, and the row says so.
    """
    inner = "struct<Sequence:string,`Entry name`:string,Organism:string,catGRANULE:struct<single:string,residue:string>>"
    got = object_entries(spark, path, inner).select(F.col("key").alias("acc"), F.col("value").alias("r"))
    values = F.transform(F.split("r.catGRANULE.residue", ","), lambda x: F.trim(x).try_cast("double"))
    residue = F.when(F.trim("r.catGRANULE.residue") != "", values)
    bad = F.coalesce(F.exists(residue, lambda x: x.isNull()), F.lit(False)) | (F.col("r.catGRANULE.single").isNotNull() & F.col("r.catGRANULE.single").try_cast("double").isNull())
    return got.select("acc", F.col("r.`Entry name`").alias("entry_name"), F.col("r.Organism").alias("organism"), F.col("r.Sequence").alias("seq"), F.col("r.catGRANULE.single").try_cast("double").alias("single"), residue.alias("residue"), F.when(bad, "unreadable number").alias("error"))


def species_is(column: Column, *names: str) -> Column:
    return F.coalesce(F.trim(column).isin(*names), F.lit(False))


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """acc, human, self, partner of JSON lines with a class text."""
    df = spark.read.schema("uniprot_id string, organism string, aggregated_class string").json(path)
    held = lambda w: F.coalesce(F.contains("aggregated_class", F.lit(w)), F.lit(False))
    return df.where("trim(uniprot_id) != ''").select(F.trim("uniprot_id").alias("acc"), species_is(F.col("organism"), "Homo sapiens").alias("human"), held("PS-self").alias("self"), held("PS-other").alias("partner"))


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """acc, human of one JSON object keyed by accession."""
    got = object_entries(spark, path, "struct<organism:string>").select(F.col("key").alias("acc"), F.col("value").alias("r"))
    return got.select("acc", F.coalesce(F.contains("r.organism", F.lit("Homo sapiens")), F.lit(False)).alias("human"))


def read_label_table(spark: SparkSession, path: str) -> DataFrame:
    """acc, human of a positive or negative table with either spelling of its key."""
    df = read_table(spark, path)
    keys = [F.col(f"`{k}`") for k in ("Uniprot ID", "UniprotID") if k in df.columns]
    got = df.select(F.trim(F.coalesce(*keys)).alias("acc"), species_is(F.col("Species"), "Homo sapiens", "Human").alias("human"))
    return got.where("acc != ''")


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, state, score of disorder outputs: two-column D or O lines, banners left out."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), "value", F.col("_metadata.file_name").alias("file"))
    got = lines.where(F.col("value").rlike(r"^[DO]\s+\S+\s*$"))
    score = F.regexp_extract("value", r"^[DO]\s+(\S+)", 1).try_cast("double")
    pos = F.row_number().over(Window.partitionBy("file").orderBy("ord")) - 1
    return got.select("file", pos.alias("pos"), F.substring("value", 1, 1).alias("state"), score.alias("score")).where("score is not null")


def read_prion_output(spark: SparkSession, path: str) -> DataFrame:
    """acc, value: comment lines and rows of another width than the header's are left out."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    head = lines.where(F.col("value").startswith("SEQid")).first()
    if head is None:
        raise ValueError("no SEQid header")
    names = head["value"].split("\t")
    cells = F.split("value", "\t")
    rows = lines.where((F.size(cells) == len(names)) & ~F.col("value").startswith("SEQid"))
    return rows.select(accession(F.get(cells, 0)).alias("acc"), F.get(cells, names.index("NLLR")).try_cast("double").alias("value"))


def read_contact_output(spark: SparkSession, path: str) -> DataFrame:
    """acc, value of lines with a PScore and, behind it, the header of its protein."""
    lines = spark.read.text(path)
    pattern = r"PScore:?\s*(-?[0-9.eE+\-]+).*>(\S+)"
    return lines.where(F.col("value").rlike(pattern)).select(accession(F.regexp_extract("value", pattern, 2)).alias("acc"), F.regexp_extract("value", pattern, 1).try_cast("double").alias("value")).where("value is not null")


def read_coil_outputs(spark: SparkSession, path: str) -> DataFrame:
    """acc (the file's name), raw_cc and cc arrays in file order."""
    df = spark.read.csv(path, sep="\t", header=True).select("*", F.monotonically_increasing_id().alias("ord"), F.regexp_replace(F.col("_metadata.file_name"), r"\.out$", "").alias("acc"))
    cc = F.col("cc").try_cast("double") if "cc" in df.columns else F.lit(None).cast("double")
    got = df.groupBy("acc").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("raw_cc").try_cast("double").alias("raw"), cc.alias("cc")))).alias("rows"))
    return got.select("acc", F.transform("rows", lambda r: r["raw"]).alias("raw_cc"), F.transform("rows", lambda r: r["cc"]).alias("cc"))


def write_residue_json(df: DataFrame, path: str) -> None:
    """A JSON document an accession, in a folder under its safe name. Tools: map of map of array."""
    safe = F.regexp_replace("acc", "[^0-9A-Za-z_-]", "_")
    df.select(safe.alias("name"), F.to_json(F.struct("acc", "tools")).alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def write_lists(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Sorted distinct accessions in a folder for each of ``by``."""
    df.select(*by, "acc").distinct().repartition(*by).sortWithinPartitions(*by, "acc").write.mode("overwrite").partitionBy(*by).text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def cache_report(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """acc, status: cached or not cached."""
    return asked.join(cache.select("acc").distinct().withColumn("_hit", F.lit(True)), "acc", "left").select("acc", F.when(F.col("_hit"), "cached").otherwise("not cached").alias("status"))
