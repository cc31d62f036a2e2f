"""Readers and writers of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import classify, doc_id_for


#: Folders of retained parse results, and files of a folder at a time.
RAW_BUCKETS, RAW_SPREAD = 256, 4


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table by its header, all text, with either line end; missing cells are ''. ``ordinal`` keeps the order of rows in files."""
    rows = spark.read.csv(path, header=True, schema=schema, quote='"', escape='"', multiLine=True, enforceSchema=False)
    return rows.na.fill("").withColumn("ordinal", F.monotonically_increasing_id())


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, also when empty; fields with commas, quotes or line ends are quoted. For exports of bounded size."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, schemas.MANIFEST)


def parsed_refs(rows: DataFrame) -> DataFrame:
    """(key, parsed_ref): the last row of each key counts."""
    return rows.groupBy("key").agg(F.max_by("parsed_ref", "ordinal").alias("parsed_ref"))


def manifest_entries(rows: DataFrame) -> DataFrame:
    """(key, asset_team, ordinal): the first row of each key."""
    return rows.groupBy("key").agg(F.min(F.struct("ordinal", "asset_team")).alias("f")).select("key", "f.asset_team", "f.ordinal")


def ingestable(rows: DataFrame) -> DataFrame:
    return rows.where("parsed_ref <> ''")


def without_output(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("parsed_ref").eqNullSafe("") & F.col("parse_source").startswith("pilot-"))


def relative(path: Column, root: str) -> Column:
    """The key of a file under a root, without scheme."""
    bare = F.regexp_replace(path, "^[a-z0-9]+:/*", "/")
    return F.ltrim(F.replace(bare, F.lit("/" + root.split(":")[-1].strip("/")), F.lit("")), F.lit("/"))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(key, asset_team, etag, size, path) of all files under a root. Contents aren't read: the column is pruned."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    key = relative(F.col("path"), root)
    tag = F.concat(F.col("length").cast("string"), F.lit("-"), F.unix_millis("modificationTime").cast("string"))
    return files.select(key.alias("key"), F.split(key, "/")[0].alias("asset_team"), tag.alias("etag"), F.col("length").alias("size"), "path")


def contents(spark: SparkSession, root: str) -> DataFrame:
    """(key, content) of all files under a root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(relative(F.col("path"), root).alias("key"), "content")


def json_objects(spark: SparkSession, root: str) -> DataFrame:
    """(key, json): whole files as text; what isn't JSON becomes null when parsed."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    return files.select(relative(F.col("_metadata.file_path"), root).alias("key"), F.col("value").alias("json"))


def put_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return csv(spark, f"{path}/nodes.csv", schemas.NODES), csv(spark, f"{path}/edges.csv", schemas.EDGES)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    write_csv(nodes, f"{path}/nodes.csv")
    write_csv(edges, f"{path}/edges.csv")


def nominations(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the evidence store that are nominated for the graph."""
    return csv(spark, path, schemas.NOMINATIONS)


def retain_raw(parsed: DataFrame, root: str) -> None:
    """Append whole parse results (doc_id, key, result struct with its text items and boxes) as JSON, in RAW_BUCKETS folders by a hash of the document."""
    bucket = raw_bucket(F.col("doc_id"))
    parsed.select("doc_id", "key", "result", bucket.alias("bucket")).repartition("bucket", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(RAW_SPREAD))).write.mode("append").partitionBy("bucket").json(root)


def raw_bucket(doc_id: Column) -> Column:
    """The folder of a document's parse results, by which reads of one document are pruned."""
    return F.pmod(F.xxhash64(doc_id), F.lit(RAW_BUCKETS)).cast("int")


def raw(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Retained parse results with the schema of their result."""
    return spark.read.schema(f"key string, result {schema}, doc_id string").json(root)


def master(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A master export; an error says what to do if it isn't there."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no master export at {path}: run its export query first")
    return csv(spark, path, schema)


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """Alias rows; none if the file isn't there."""
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.ALIASES + ", ordinal long")
    return csv(spark, path, schemas.ALIASES)


def ontology(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """classes (name, parent), properties (name, domain, range) and individuals (fragment, cls, label) of an RDF/XML file."""

    def rows(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)

    tail = lambda c: F.element_at(F.split(c, "#"), -1)
    resource = "struct<`_rdf:resource`: string>"
    classes = rows("owl:Class", f"`_rdf:about` string, `rdfs:subClassOf` {resource}")
    properties = rows("owl:ObjectProperty", f"`_rdf:about` string, `rdfs:domain` {resource}, `rdfs:range` {resource}")
    individuals = rows("rdf:Description", f"`_rdf:about` string, `rdf:type` {resource}, `rdfs:label` string")
    return {
        "classes": classes.select(tail(F.col("`_rdf:about`")).alias("name"), tail(F.col("`rdfs:subClassOf`.`_rdf:resource`")).alias("parent")),
        "properties": properties.select(tail(F.col("`_rdf:about`")).alias("name"), tail(F.col("`rdfs:domain`.`_rdf:resource`")).alias("domain"), tail(F.col("`rdfs:range`.`_rdf:resource`")).alias("range")),
        "individuals": individuals.select(tail(F.col("`_rdf:about`")).alias("fragment"), tail(F.col("`rdf:type`.`_rdf:resource`")).alias("cls"), F.col("`rdfs:label`").alias("label")),
    }


def questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True, schema="id string, question string, modality string, expected_pages array<struct<s3key: string, page: int>>")


def run_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Keys that any earlier run finished."""
    if not exists(spark, path):
        return spark.createDataFrame([], "key string")
    return spark.read.csv(path, header=True, recursiveFileLookup=True).where("status = 'ok'").select("key").distinct()


def append_run_ledger(df: DataFrame, path: str, stamp: str) -> DataFrame:
    """Appends one run's rows and returns the counts by status with their characters."""
    df.withColumn("stamp", F.lit(stamp)).write.mode("append").csv(path, header=True)
    return df.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.col("chars").cast("long")).alias("chars"))


def with_identity(rows: DataFrame) -> DataFrame:
    """Listing rows with their document id and format gate."""
    return rows.withColumn("doc_id", doc_id_for(F.col("key"))).withColumn("gate", classify(F.col("key")))
