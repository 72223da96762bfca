"""File sources and sinks: match/prediction/fixture CSV, season extracts, slug map JSON.

Readers always take a fixed schema (no inference); dirty text is read as
strings and cleaned by the operators. Writers never funnel data through one
task: CSV/JSON are written by all partitions, and the slug map is written as
several map documents (one per hash bucket) whose union is the whole map.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType

from ..functions import constants as C
from ..session import scratch_path

# --- fixed values: text the reference's CSV reader treats as missing (pandas defaults) ---
NA_STRINGS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
              "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

PREDICTION_COLUMNS = ["season", "date", "home_team", "away_team", "pred_home_goals", "pred_away_goals",
                      "pred_result"]
FIXTURE_COLUMNS = ["home_team", "away_team", "date", "venue"]


def string_schema(cols: list[str]) -> StructType:
    return StructType([StructField(c, StringType(), True) for c in cols])


def _writer(df: DataFrame):
    return (df.write.mode("overwrite").option("header", True)
              .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def sink_csv(df: DataFrame, path: str) -> None:
    """CSV with a header row, no index column; whitespace kept as is."""
    _writer(df).csv(path)


def _read_csv(spark: SparkSession, path: str, schema: StructType, multi_line: bool = False) -> DataFrame:
    """Files are split among tasks; only ``multi_line`` (line breaks inside quotes) reads a file as a whole."""
    return (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
            .option("multiLine", multi_line).csv(path))


def _na_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(F.col(c).isin(*NA_STRINGS), F.lit(None).cast("string")).otherwise(F.col(c)).alias(c)
                       for c in df.columns])


def scan_matches_csv(spark: SparkSession, path: str, columns: list[str], multi_line: bool = False) -> DataFrame:
    """Raw match CSV, every column as text; pandas' missing markers -> null."""
    return _na_to_null(_read_csv(spark, path, string_schema(columns), multi_line))


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def scan_predictions_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Predictions as text with missing -> ''; a missing file -> no rows."""
    schema = string_schema(PREDICTION_COLUMNS)
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return _na_to_null(_read_csv(spark, path, schema, multi_line)).na.fill("")


def scan_fixtures_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Fixtures to score: home_team, away_team, date, optional venue."""
    return _na_to_null(_read_csv(spark, path, string_schema(FIXTURE_COLUMNS), multi_line))


def union_season_extracts(spark: SparkSession, matches: DataFrame) -> DataFrame:
    """Write one CSV extract per season (partition folders), read them all back as one table."""
    path = scratch_path(spark, "season-extracts")
    extracts = matches.withColumn("season", F.concat_ws("-", F.col("season_year").cast("string"),
                                                       (F.col("season_year") + 1).cast("string")))
    _writer(extracts.drop("season_year")).partitionBy("season").csv(path)
    cols = [c for c in extracts.columns if c not in ("season_year", "season")]
    back = _read_csv(spark, path, StructType(list(string_schema(cols).fields) + [StructField("season", StringType())]))
    return back.select(F.col("league").cast("bigint"), F.to_date("match_date").alias("match_date"),
                       "home_team", "away_team", F.col("home_goals").cast("double"),
                       F.col("away_goals").cast("double"), "venue", F.col("result").cast("int"), "season")


# ------------------------------------------------------------ slug map

SLUG_MAP_SCHEMA = StructType([StructField("teams", MapType(StringType(), StringType())),
                              StructField("stadiums", MapType(StringType(), StringType()))])
#: Map documents that every slug map is written as.
SLUG_MAP_SHARDS = 64


def sink_slug_map(sources: DataFrame, path: str, shards: int = SLUG_MAP_SHARDS) -> None:
    """Write {teams: {name: slug}, stadiums: {name: slug}} documents.

    ``sources`` = (kind, name, slug). Entries are hashed into ``shards`` map documents
    at any size, so no task builds the whole map and readers meet one shape.
    """
    keyed = sources.withColumn("_shard", F.pmod(F.hash("name"), F.lit(shards)))
    entry = F.struct("name", "slug")
    docs = keyed.groupBy("_shard").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("kind") == "team", entry))).alias("teams"),
        F.map_from_entries(F.collect_list(F.when(F.col("kind") == "stadium", entry))).alias("stadiums"))
    docs.select("teams", "stadiums").write.mode("overwrite").json(path)


def scan_slug_map(spark: SparkSession, path: str) -> DataFrame:
    """Team rows from slug-map documents: id (= slug), name, short_name, logo_url."""
    docs = spark.read.schema(SLUG_MAP_SCHEMA).json(path)
    teams = docs.select(F.explode("teams").alias("name", "slug"))
    return teams.select(F.col("slug").alias("id"), "name", F.col("name").alias("short_name"),
                        F.concat(F.lit(C.LOGO_PREFIX), F.col("slug"), F.lit(C.LOGO_SUFFIX)).alias("logo_url"))


def scan_stadium_map(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.schema(SLUG_MAP_SCHEMA).json(path)
    return docs.select(F.explode("stadiums").alias("name", "slug"))
