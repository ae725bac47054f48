"""Files that carry their own proof: documents with sidecars that hold the digests of their bytes, chained by the digest of the one before.

The bytes are read as they are (binaryFile), so a digest is that of the file. A document is known by the date in its path, as the name of a file
(2026-09-15.json, with 2026-09-15.json.sha256 or 2026-09-15.sha256) or of a folder that Spark's writers made. The same scan works on a folder and on a stream of files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_DAY = r"\d{4}-\d{2}-\d{2}"
_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def files(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """name (the date in the path below the folder), sidecar (whether the file is one), modified, content."""
    reader = (spark.readStream.schema(_FILE) if stream else spark.read).format("binaryFile").option("recursiveFileLookup", "true")
    below = F.substring_index(F.col("path"), folder.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    return reader.load(folder).select(F.regexp_extract(below, f".*({_DAY})", 1).alias("name"), below.contains("sha256").alias("sidecar"), F.col("modificationTime").alias("modified"), "content").filter("name <> ''")


def verified(found: DataFrame) -> DataFrame:
    """One row per name: digest of the document's bytes, stated (the digest in its sidecar, the first word), content as text, modified. Sums of either side only, so that it can run on a stream, in which a
    document waits for its sidecar with a null `stated`. Of several files of one name and kind the one modified last counts."""
    of = lambda c, side: F.max_by(F.when(F.col("sidecar") == side, c), F.when(F.col("sidecar") == side, F.col("modified")))
    text = F.decode("content", "UTF-8")
    first = F.lower(F.get(F.split(F.trim(text), r"\s+"), F.lit(0)))
    return found.groupBy("name").agg(of(F.sha2("content", 256), False).alias("digest"), of(first, True).alias("stated"), of(text, False).alias("content"), F.max("modified").alias("modified"))


def proof(rows: DataFrame) -> DataFrame:
    """rows of verified() with `state`: verified, differs, no sidecar, no document."""
    state = F.when(F.col("digest").isNull(), "no document").when(F.col("stated").isNull(), "no sidecar").when(F.col("digest") == F.col("stated"), "verified").otherwise("differs")
    return rows.withColumn("state", state)


def problems(rows: DataFrame, schema: str, version: str, version_field: str = "schema", date_field: str = "entryDate", previous_field: str = "previousSha256", genesis: str | None = None, most_days: int = 7) -> DataFrame:
    """name, problem: what is wrong with a store of entries; a name may have several.

    Sidecars (missing, or of other bytes), documents that are no JSON of the schema, another version, a date that is not the name's, a digest of
    the entry before that isn't that entry's (genesis: of the first), gaps of more than `most_days` (a warning). rows: of verified(). A store is a chain, an entry a day, in one order."""
    doc = F.from_json("content", schema)
    x = proof(rows).withColumn("_d", doc).withColumn("_broken", F.try_parse_json("content").isNull())
    w = Window.orderBy("name")  # one chain; its entries without their contents
    x = x.filter("digest is not null").select("name", "digest", "state", "_broken", F.col(f"_d.{version_field}").alias("_v"), F.col(f"_d.{date_field}").alias("_t"), F.col(f"_d.{previous_field}").alias("_p")).withColumn("_before", F.coalesce(F.lag("digest").over(w), F.lit(genesis))).withColumn("_gap", F.datediff(F.to_date("name"), F.to_date(F.lag("name").over(w))))
    other = lambda a, b: ~F.coalesce(a.eqNullSafe(b), F.lit(False))
    found = F.array_compact(F.array(
        F.when(F.col("state") != "verified", F.col("state")), F.when(F.col("_broken"), "no document of the schema"), F.when(~F.col("_broken") & other(F.col("_v"), F.lit(version)), "version"),
        F.when(~F.col("_broken") & other(F.col("_t"), F.col("name")), "date"), F.when(~F.col("_broken") & F.col("_before").isNotNull() & other(F.col("_p"), F.col("_before")), "chain"), F.when(F.col("_gap") > most_days, "gap"),
    ))
    alone = proof(rows).filter("digest is null").select("name", F.lit("no document").alias("problem"))
    return x.select("name", F.explode(found).alias("problem")).unionByName(alone)


def read_verified(rows: DataFrame, schema: str, version: str, version_field: str = "schema") -> DataFrame:
    """name, digest and the fields of documents that are verified and of the version; what is not is for problems()."""
    return proof(rows).filter("state = 'verified'").select("name", "digest", F.from_json("content", schema).alias("d")).filter(F.col(f"d.{version_field}") == version).select("name", "digest", "d.*")
