"""Line formats: everything is read.text, split and try_cast, so bad lines become nulls or go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.genomics import average_length
from ..functions.order import carried, running_sum


def _fields(df: DataFrame, sep: str = "\t") -> DataFrame:
    return df.withColumn("f", F.split("value", sep))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of one file; line numbers rise in file order."""
    return spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())


def run_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_run_list(spark.read.text(path))


def parse_run_list(lines: DataFrame) -> DataFrame:
    """Runs of tab lines; '@' and blank lines, short ones and those that do not cast are skipped.
    Platform and project are optional."""
    f = F.col("f")
    flag = lambda c: F.lower(F.trim(c)).isin("1", "true")
    text = lambda k: F.coalesce(F.trim(F.get(f, k)), F.lit(""))
    rows = _fields(lines.where((F.trim("value") != "") & ~F.col("value").startswith("@"))).where(F.size(f) >= 6)
    rows = rows.select(
        F.trim(f[0]).alias("accession"), f[1].try_cast("long").alias("total_spots"), f[2].try_cast("long").alias("total_bases"), f[3].try_cast("double").alias("avg_len"),
        flag(f[4]).alias("paired"), flag(f[5]).alias("colorspace"), text(F.lit(6)).alias("platform"), text(F.lit(7)).alias("bioproject"),
    )
    return rows.where("total_spots is not null and total_bases is not null and avg_len is not null")


def parse_run_pages(pages: DataFrame) -> DataFrame:
    """Runs of metadata pages (xml): one part for each DocSum; blank or zero spots go."""
    doc = pages.select(F.explode(F.slice(F.split("xml", "<DocSum>"), 2, F.size(F.split("xml", "<DocSum>")))).alias("d")).select(F.substring_index("d", "</DocSum>", 1).alias("d"))
    d = F.col("d")
    quote = r"""(?:"|&quot;)"""
    lt = "(?:<|&lt;)"
    runs = F.regexp_extract_all(d, F.lit(lt + r"""(Run\s+acc=[^<&>]*(?:&quot;[^<&>]*)*)"""), F.lit(1))
    attr = lambda c, name: F.regexp_extract(c, name + "=" + quote + r"""([^"&]*)""" + quote, 1)
    rows = doc.select(
        F.explode(runs).alias("r"), d.rlike(lt + r"PAIRED\b").alias("paired"), d.rlike(r"(?i)(?:ABI_SOLID|is_public_colorspace=.?1|colorspace)").alias("colorspace"),
        F.regexp_extract(d, lt + r"Platform[^>&]*(?:&quot;[^>&]*)*(?:>|&gt;)([^<&]*)" + lt, 1).alias("platform"),
        F.regexp_extract(d, lt + r"Bioproject(?:>|&gt;)([^<&]*)" + lt, 1).alias("bioproject"),
    )
    spots, bases = attr(F.col("r"), "total_spots").try_cast("long"), attr(F.col("r"), "total_bases").try_cast("long")
    out = rows.select(attr(F.col("r"), "acc").alias("accession"), spots.alias("total_spots"), bases.alias("total_bases"), "paired", "colorspace", "platform", "bioproject")
    out = out.where("total_spots > 0 and total_bases is not null")
    return out.withColumn("avg_len", average_length(F.col("total_bases"), F.col("total_spots"))).select("accession", "total_spots", "total_bases", "avg_len", "paired", "colorspace", "platform", "bioproject")


def sam(spark: SparkSession, path: str) -> DataFrame:
    return parse_sam(spark.read.text(path))


def parse_sam(lines: DataFrame) -> DataFrame:
    """Alignment records of SAM text; '*' names are null, positions 0-based."""
    f = F.col("f")
    tags = F.array_join(F.slice(f, 12, F.size(f)), "\t")
    tag = lambda t, kind: F.regexp_extract(tags, rf"(?:^|\t){t}:[if]:([^\t]+)", 1).try_cast(kind)
    name = lambda c: F.when(c != "*", c)
    rows = _fields(lines.where(~F.col("value").startswith("@"))).where(F.size(f) >= 11)
    return rows.select(
        f[0].alias("qname"), f[1].cast("int").alias("flag"), name(f[2]).alias("chrom"), (f[3].cast("long") - 1).alias("pos0"), f[4].cast("int").alias("mapq"), f[5].alias("cigar"),
        tag("NH", "int").alias("nh"), tag("de", "double").alias("de"), tag("NM", "int").alias("nm"), F.when(f[9] != "*", F.length(f[9])).otherwise(0).alias("qlen"),
    )


def parse_gff_introns(lines: DataFrame) -> DataFrame:
    """(chrom, start, end, strand, mult) of intron lines; multiplicities of equal ones add up."""
    f = F.col("f")
    mult = F.coalesce(F.nullif(F.regexp_extract(f[8], r"(?:^|;)mult=(\d+)", 1), F.lit("")).try_cast("long"), F.lit(1))
    rows = _fields(lines.where(~F.col("value").startswith("#"))).where((F.size(f) >= 9) & (f[2] == "intron"))
    rows = rows.select(f[0].alias("chrom"), f[3].try_cast("long").alias("start"), f[4].try_cast("long").alias("end"), f[6].alias("strand"), mult.alias("mult")).dropna(subset=["start", "end"])
    return rows.groupBy("chrom", "start", "end", "strand").agg(F.sum("mult").alias("mult"))


def parse_gff(lines: DataFrame) -> DataFrame:
    """Nine columns c0..c8 of GFF or GTF lines."""
    rows = _fields(lines.where(~F.col("value").startswith("#"))).where(F.size("f") >= 9)
    return rows.select(*[F.col("f")[k].alias(f"c{k}") for k in range(9)])


def parse_cds(gff: DataFrame) -> DataFrame:
    """(chrom, parents, start, end) of the CDS lines of parsed GFF or GTF."""
    gtf = F.regexp_extract("c8", r'transcript_id "([^"]+)"', 1)
    parents = F.coalesce(F.nullif(F.regexp_extract("c8", r"(?:^|;)\s*Parent=([^;]+)", 1), F.lit("")), F.nullif(gtf, F.lit("")))
    return gff.where("c2 = 'CDS'").select(F.col("c0").alias("chrom"), parents.alias("parents"), F.col("c3").cast("long").alias("start"), F.col("c4").cast("long").alias("end")).where("parents is not null")


def parse_manifest(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(header, rows) of a manifest: '#key=value' lines, and typed tab rows."""
    head = lines.where(F.col("value").startswith("#")).select(F.regexp_extract("value", r"^#\s*([^=]*)=", 1).alias("key"), F.regexp_extract("value", r"^#[^=]*=(.*)$", 1).alias("item")).where("key <> ''")
    f = F.col("f")
    rows = _fields(lines.where(~F.col("value").startswith("#") & ~F.col("value").startswith("batch\t") & (F.trim("value") != ""))).where(F.size(f) >= 11)
    kinds = [("batch", "int"), ("accession", "string"), ("n", "long"), ("x", "long"), ("db_version", "int"), ("threads", "int"), ("batch_size", "long"), ("success", "boolean"), ("uniq_pct", "double"), ("spliced_pct", "double"), ("seconds", "double")]
    return head, rows.select(*[f[k].try_cast(kind).alias(name) for k, (name, kind) in enumerate(kinds)])


def parse_db_log(lines: DataFrame) -> DataFrame:
    """(version, op, line) of a change log."""
    f = F.split("value", "\t", 3)
    return lines.where(F.col("value") != "").select(f[0].cast("int").alias("version"), f[1].alias("op"), f[2].alias("line"))


def parse_fasta(lines: DataFrame) -> DataFrame:
    """(chrom, seq) of FASTA lines (line_no, value); joins the lines of one sequence."""
    head = F.col("value").startswith(">")
    name = F.regexp_extract("value", r"^>(\S+)", 1)
    rows = carried(lines, "line_no", F.when(head, name), "chrom")
    parts = rows.where(~head & F.col("chrom").isNotNull()).groupBy("chrom").agg(F.array_sort(F.collect_list(F.struct("line_no", F.trim("value").alias("s")))).alias("p"))
    return parts.select("chrom", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("seq"))


def sequence_lengths(fai: DataFrame, most: int = 2**31 - 1) -> DataFrame:
    """(chrom, length) of index lines; a longer sequence than ``most`` is an error."""
    f = F.split("value", "\t")
    rows = fai.where(F.col("value") != "").select(f[0].alias("chrom"), f[1].cast("long").alias("length"))
    checked = F.when(F.col("length") > most, F.raise_error(F.concat(F.lit("sequence too long: "), "chrom"))).otherwise(F.col("length"))
    return rows.select("chrom", checked.cast("long").alias("length"))


def contig_header(line: Column) -> tuple[Column, Column]:
    """Name and abundance of a contig header; null abundance if it is missing or no number."""
    name = F.regexp_extract(F.trim(line), r"^>?(\S+)", 1)
    return name, F.regexp_extract(line, r"\s(?:ka|km):f:(\S+)", 1).try_cast("double")


def parse_contigs(lines: DataFrame, acc: str) -> DataFrame:
    """(acc, idx, ka, len) of contig FASTA lines (line_no, value), numbered in file order."""
    head = F.col("value").startswith(">")
    rows = running_sum(lines, "line_no", head.cast("int"), "heads").where("heads > 0").withColumn("idx", (F.col("heads") - 1).cast("int"))
    return rows.groupBy("idx").agg(F.max(F.when(head, contig_header(F.col("value"))[1])).alias("ka"), F.sum(F.when(head, 0).otherwise(F.length(F.trim("value")))).cast("int").alias("len")).select(F.lit(acc).alias("acc"), "idx", "ka", "len")


def uniquely_aligned(log: DataFrame) -> DataFrame:
    """num_uniq of an aligner log (line_no, value): the first line that says how many aligned once."""
    hit = F.when(F.col("value").rlike("aligned (concordantly )?exactly 1 time"), F.col("line_no"))
    return log.agg(F.coalesce(F.regexp_extract(F.min_by("value", hit), r"^\s*(\d+)", 1).try_cast("long"), F.lit(0)).alias("num_uniq"))
