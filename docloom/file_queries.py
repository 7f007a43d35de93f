"""Registered queries over files: documents and data are written by Spark, then found and read by the registry.

A file holds a hundred documents, one after the other, so that files are few and grow with the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import samples
from .functions.tables import parse_embedded_blocks
from .operators import structure as st
from .plans.files import new_folder
from .sources import compact, interchange, prose, sinks
from .sources.registry import REGISTRY, glob_files, read_data, read_documents

BUNDLE = 100


def _joined(docs: DataFrame) -> DataFrame:
    """(doc, text): the texts of a hundred documents each, by id, with a blank line between them."""
    item = F.struct("doc_id", "text")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]), "\n\n")
    return docs.where("text is not null").groupBy(F.floor(F.col("doc_id") / BUNDLE).alias("doc")).agg(whole.alias("text"))


def _bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: What `_bundles` is in SQL, in the place of the table.
BUNDLES = f"(select doc_id // {BUNDLE} as doc_id, string_agg(text, chr(10) || chr(10) order by doc_id) as text from documents where text is not null group by 1)"


def bundled(sql: str) -> str:
    """A query's SQL over bundles instead of documents."""
    return sql.replace("from documents where", f"from {BUNDLES} where")


def _written(docs: DataFrame) -> str:
    """Writes each document to a text file in a folder of its own; gives the glob of the files."""
    folder = new_folder(docs.sparkSession)
    docs.repartition("doc").select("text", F.col("doc").alias("bundle")).write.partitionBy("bundle").text(folder)
    return f"{folder}/bundle=*/*.txt"


def _number(path: str = "doc", name: str = "bundle") -> Column:
    return F.regexp_extract(path, rf"{name}=(\d+)", 1).cast("bigint")


def scan_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose extension tells the reader."""
    blocks = read_documents(spark, _written(_bundles(spark, sf_dir)), filename=True)
    return blocks.withColumn("doc", _number("filename")).drop("filename")


def scan_org_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files read in a named format, which goes before the extension."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("doc"), "text")
    texts = _joined(samples.sample_texts(docs, "org").withColumnRenamed("doc", "doc_id"))
    blocks = read_documents(spark, _written(texts), format="org").where("element_type = 'heading'")
    return blocks.groupBy(_number().alias("doc")).agg(F.count("*").alias("n_headings"), F.sum(F.length("content")).cast("bigint").alias("n_chars"))


_SCAN_ORG = f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as raw, unnest(range(len(string_split(text, chr(10))))) as n from documents where text is not null),
c as (select doc_id, n, trim(regexp_replace(regexp_replace(raw, '{samples.SIGNS}', '', 'g'), '\\s+', ' ', 'g')) as clean from l)
select doc_id // {BUNDLE} as doc, count(*) as n_headings, sum(length(clean))::bigint as n_chars from c where clean <> '' and n % 7 = {samples.HEADING} group by 1"""


def glob_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that a glob names; those of bundles with an odd number."""
    pattern = _written(_bundles(spark, sf_dir)).replace("bundle=*", "bundle=*[13579]")
    rows = [(f,) for f in glob_files(spark, pattern)]
    files = spark.createDataFrame(rows, "path string")
    return files.groupBy(_number("path").alias("doc")).agg(F.count("*").alias("n_files"))


def compact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks written as compact files and read back."""
    folder = new_folder(spark)
    compact.write_compact_files(prose.read_prose(_bundles(spark, sf_dir)), folder)
    return compact.read_compact_files(spark, folder).withColumn("doc", _number(name="doc"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks written as one compact file a document, under its name, and read back by parts of files."""
    folder = new_folder(spark)
    sinks.write_files(compact.write_compact(prose.read_prose(_bundles(spark, sf_dir))), folder, suffix=".dblocks")
    blocks = compact.read_compact_files(spark, folder)
    return blocks.withColumn("doc", sinks.document_of(F.col("doc"), ".dblocks").cast("bigint"))


def ast_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks written as compressed files of interchange ASTs and read back."""
    folder = new_folder(spark)
    interchange.write_interchange_files(prose.read_prose(_bundles(spark, sf_dir)), folder, compression="gzip")
    blocks = read_documents(spark, f"{folder}/doc=*/*.txt.gz", format="pandoc")
    return blocks.withColumn("doc", _number(name="doc"))


def data_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as data files of each kind and read by extension."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_nationkey")
    folder = new_folder(spark)
    writers: dict[str, Callable[[str], None]] = {
        "csv": lambda path: rows.write.csv(path, header=True),
        "tsv": lambda path: rows.write.csv(path, header=True, sep="\t"),
        "jsonl": rows.write.json,
        "parquet": rows.write.parquet,
    }
    out = None
    for extension, write in writers.items():
        path = f"{folder}/customers.{extension}"
        write(path)
        read = read_data(spark, path).select(F.lit(extension).alias("format"), F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("bigint").alias("c_nationkey"))
        out = read if out is None else out.unionByName(read)
    return out


def embedded_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of each customer as a code block of JSON or of JSON lines, in turn, put in the place of it as a table."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    one = F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", one.alias("line")))), lambda x: x["line"])
    is_lines = F.col("doc") % 2 == 0
    text = F.when(is_lines, F.array_join("lines", "\n")).otherwise(F.concat(F.lit("["), F.array_join("lines", ", "), F.lit("]")))
    blocks = orders.groupBy(F.col("o_custkey").alias("doc")).agg(lines.alias("lines")).select(
        "doc", F.lit("block").alias("kind"), F.lit("code").alias("element_type"), text.alias("content"), F.lit(1).alias("level"), F.lit("text").alias("encoding"),
        F.create_map(F.lit("language"), F.when(is_lines, "jsonl").otherwise("json")).alias("attributes"), F.lit(0).alias("element_order"),
    )
    return parse_embedded_blocks(blocks).select("doc", "element_type", "content", "encoding", F.length(st.attribute("source_text")).cast("bigint").alias("n_source"))


_EMBEDDED_JSON = """select o_custkey as doc, 'table' as element_type, '{"headers":["key","status"],"rows":[' || string_agg('["' || o_orderkey || '","' || o_orderstatus || '"]', ',' order by o_orderkey) || ']}' as content, 'json' as encoding,
(sum(length('{"key":' || o_orderkey || ',"status":"' || o_orderstatus || '"}')) + case when o_custkey % 2 = 0 then count(*) - 1 else 2 * count(*) end)::bigint as n_source from orders group by o_custkey"""

#: Names of files, one of which each document gets in turn.
_NAMES = ("a.md", "b.ORG", "c.tex", "d.rest", "e.html", "f.tar.docx", "g", "h.unknown", "i.csv", "https://x.org/j.wiki?x=1.md#y", "git://r/k.txt@main", "zim://l/m.html", "n.pdf", "o.yml", "p.dblocks")


def registry_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the registry says of the path of each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("doc"))
    paths = docs.withColumn("path", F.get(F.array(*map(F.lit, _NAMES)), (F.col("doc") % len(_NAMES)).cast("int")))
    return REGISTRY.described(paths)


# Extension, format, kind and whether there is a reader, of the names above.
_SAID = (("md", "markdown", "doc", True), ("org", "org", "doc", True), ("tex", "latex", "doc", True), ("rest", "rst", "doc", True), ("html", "html", "doc", True), ("docx", "docx", "doc", True), ("", None, None, False), ("unknown", None, None, False), ("csv", "data", "table", False), ("wiki", "mediawiki", "doc", True), ("txt", "prose", "doc", True), ("zim://", "zim_article", "doc", False), ("pdf", "pdf", "doc", False), ("yml", "yaml", "doc", True), ("dblocks", "dblocks", "doc", True))
_sql = lambda x: "null" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'"
_LOOKUPS = "select doc_id as doc, v.* exclude (k) from documents join (values " + ", ".join(
    f"({k}, '{name}', {', '.join(map(_sql, (ext, fmt, kind, can)))}, {_sql(fmt)})" for k, (name, (ext, fmt, kind, can)) in enumerate(zip(_NAMES, _SAID, strict=True))
) + f") v (k, path, extension, format, kind, can_read, builtin_format) on doc_id % {len(_NAMES)} = v.k"

#: Those whose rows are blocks.
BLOCKS = {"scan_text_files": scan_text_files, "compact_files": compact_files, "document_files": document_files, "ast_files": ast_files}
QUERIES = {"scan_org_files": scan_org_files, "glob_listing": glob_listing, "data_files": data_files, "embedded_json": embedded_json, "registry_lookups": registry_lookups}


def oracles(prose_sql: str) -> dict[str, str]:
    """The SQL of these queries, from that of `read_prose`."""
    blocks = bundled(prose_sql)
    return {
        "scan_text_files": blocks,
        "scan_org_files": _SCAN_ORG,
        "glob_listing": f"select doc_id as doc, 1 as n_files from {BUNDLES} where doc_id % 2 = 1",
        "compact_files": blocks,
        "document_files": blocks,
        "ast_files": blocks,
        "data_files": "select unnest(['csv', 'tsv', 'jsonl', 'parquet']) as format, c_custkey, c_name, c_nationkey from customer",
        "embedded_json": _EMBEDDED_JSON,
        "registry_lookups": _LOOKUPS,
    }
