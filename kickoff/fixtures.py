"""Stand-in inputs derived from the driver's tables.

The reference ships no match history, so match-shaped rows are derived from
``lineitem``/``supplier``/``events``. The SQL text is shared by Spark and
DuckDB (``{name}`` placeholders are table references): the oracle wraps the
same text in CTEs, so both engines start from identical rows. These
statements only *build input rows*; none of the operators' work happens here.
Scalar subqueries carry the supplier count, so there is no cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Teams are suppliers; a league holds about 20 of them.
_N = "(SELECT COUNT(*) FROM {supplier})"
_K = f"GREATEST(1, CAST(FLOOR({_N} / 20) AS BIGINT))"
_SZ = f"CAST(FLOOR({_N} / {_K}) AS BIGINT)"

RAW_MATCHES_SQL = f"""
WITH b AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey,
         l.l_suppkey % {_K} AS league,
         CAST(l.l_shipdate AS DATE) AS d,
         'Team ' || CAST(l.l_suppkey AS STRING) AS h,
         'Team ' || CAST((l.l_suppkey + {_K} * (l.l_partkey % {_SZ})) % {_N} AS STRING) AS a,
         CAST(l.l_quantity AS INT) % 12 AS hg,
         CAST(l.l_orderkey % 13 AS INT) - 1 AS ag,
         CAST(FLOOR(l.l_extendedprice) AS BIGINT) AS att
  FROM {{lineitem}} l)
SELECT league,
       CASE WHEN l_partkey % 97 = 1 THEN 'n/a' ELSE CAST(d AS STRING) END AS date,
       CASE l_linenumber % 3
         WHEN 0 THEN CAST(d AS STRING)
         WHEN 1 THEN SUBSTR(CAST(d AS STRING), 9, 2) || '/' || SUBSTR(CAST(d AS STRING), 6, 2) || '/' || SUBSTR(CAST(d AS STRING), 1, 4)
         ELSE SUBSTR(CAST(d AS STRING), 9, 2) || ' ' || SUBSTR('enefebmarabrmayjunjulagosepoctnovdic', 3 * MONTH(d) - 2, 3) || ' ' || SUBSTR(CAST(d AS STRING), 1, 4)
       END AS date_text,
       CASE WHEN l_linenumber = 5 AND l_partkey % 101 = 0 THEN NULL
            WHEN l_linenumber = 7 THEN h || ' CF'
            WHEN l_linenumber = 6 THEN '  ' || h || ' ' ELSE h END AS home_team,
       CASE WHEN l_linenumber = 4 THEN a || ' CF' ELSE a END AS away_team,
       CASE WHEN d >= DATE '2001-03-01' THEN NULL WHEN l_partkey % 89 = 2 THEN 'x' ELSE CAST(hg AS STRING) END AS home_goals,
       CASE WHEN d >= DATE '2001-03-01' THEN NULL ELSE CAST(ag AS STRING) END AS away_goals,
       CASE WHEN d >= DATE '2001-03-01' OR ag < 0 THEN '' ELSE CAST(hg AS STRING) || CASE WHEN l_linenumber % 2 = 0 THEN '–' ELSE ':' END || CAST(ag AS STRING) END AS score,
       CASE WHEN l_partkey % 53 = 3 THEN NULL WHEN l_partkey % 10 = 0 THEN 'San Mamés' ELSE ' Ground of ' || h || ' ' END AS venue,
       CAST(CAST(FLOOR(att / 1000) AS BIGINT) AS STRING) || ',' || LPAD(CAST(att % 1000 AS STRING), 3, '0') AS attendance
FROM b
"""

MATCHES_SQL = """
SELECT league, match_date, home_team, away_team, MIN(hg) AS home_goals, MIN(ag) AS away_goals, MIN(venue) AS venue,
  CASE WHEN MIN(hg) > MIN(ag) THEN 1 WHEN MIN(hg) < MIN(ag) THEN -1 WHEN MIN(hg) = MIN(ag) THEN 0 END AS result,
  CAST(CASE WHEN MONTH(match_date) >= 8 THEN YEAR(match_date) ELSE YEAR(match_date) - 1 END AS INT) AS season_year
FROM (
  SELECT league, TRY_CAST(date AS DATE) AS match_date,
    CASE WHEN home_team LIKE 'Team%' THEN REPLACE(home_team, ' CF', '') ELSE TRIM(home_team) END AS home_team,
    REPLACE(away_team, ' CF', '') AS away_team,
    CASE WHEN TRY_CAST(home_goals AS DOUBLE) BETWEEN 0 AND 10 THEN TRY_CAST(home_goals AS DOUBLE) END AS hg,
    CASE WHEN TRY_CAST(away_goals AS DOUBLE) BETWEEN 0 AND 10 THEN TRY_CAST(away_goals AS DOUBLE) END AS ag,
    REPLACE(COALESCE(TRIM(venue), 'Unknown'), 'San Mamés', 'San Mames') AS venue
  FROM {raw_matches}) x
WHERE match_date IS NOT NULL AND home_team IS NOT NULL AND away_team IS NOT NULL AND home_team <> away_team
GROUP BY league, match_date, home_team, away_team
"""

# Synthetic scored matches: no model involved, so evaluation has an exact oracle.
PREDICTIONS_SQL = """
SELECT m.*, ((5 * home_goals + DAY(match_date)) % 40) / 10 AS pred_home_goals,
       ((5 * away_goals + 2 * DAY(match_date)) % 40) / 10 AS pred_away_goals,
       wh / (wh + wd + wa) AS prob_home, wd / (wh + wd + wa) AS prob_draw, wa / (wh + wd + wa) AS prob_away,
       CASE WHEN wh >= wd AND wh >= wa THEN 1 WHEN wd >= wa THEN 0 ELSE -1 END AS pred_result
FROM (SELECT c.*, 1 + (3 * home_goals + DAY(match_date)) % 7 AS wh, 1 + (home_goals + away_goals + MONTH(match_date)) % 5 AS wd,
             1 + (3 * away_goals + DAY(match_date)) % 7 AS wa FROM {matches} c WHERE result IS NOT NULL) m
"""

# Leaderboard users: points null for users without purchases.
USERS_SQL = """
SELECT user_id, 'user_' || CAST(user_id AS STRING) AS username,
       SUM(CASE WHEN event_type = 'purchase' THEN CAST(FLOOR(value) AS BIGINT) END) AS points,
       COUNT(CASE WHEN event_type = 'signup' THEN 1 END) AS correct_predictions
FROM {events} GROUP BY user_id
"""

# Alias table for this input: "Team N CF" -> "Team N" for every supplier.
TEAM_ALIASES_SQL = """
SELECT 'Team ' || CAST(s_suppkey AS STRING) || ' CF' AS alias,
       'Team ' || CAST(s_suppkey AS STRING) AS canonical
FROM {supplier}
"""


def duck(sql: str, **names: str) -> str:
    """SQL text with placeholders bound to DuckDB table / CTE names."""
    return sql.format(**names)


def oracle_with(*ctes: str) -> str:
    """``WITH`` prefix holding the requested fixture CTEs (in dependency order)."""
    parts = []
    have = set()

    def add(name):
        if name in have:
            return
        if name == "raw_matches":
            parts.append("raw_matches AS (" + duck(RAW_MATCHES_SQL, lineitem="lineitem", supplier="supplier") + ")")
        elif name == "matches":
            add("raw_matches")
            parts.append("matches AS (" + duck(MATCHES_SQL, raw_matches="raw_matches") + ")")
        elif name == "predictions":
            add("matches")
            parts.append("predictions AS (" + duck(PREDICTIONS_SQL, matches="matches") + ")")
        elif name == "users":
            parts.append("users AS (" + duck(USERS_SQL, events="events") + ")")
        elif name == "team_aliases":
            parts.append("team_aliases AS (" + duck(TEAM_ALIASES_SQL, supplier="supplier") + ")")
        else:
            raise KeyError(name)
        have.add(name)

    for c in ctes:
        add(c)
    return "WITH " + ",\n".join(parts) + "\n"


_FEATURE_CACHE: dict = {}


class Tables:
    """Lazy access to the driver tables and the derived stand-in inputs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[name]

    def version(self) -> tuple:
        """The session, the input folder and its tables' times."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.sf_dir)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        times = tuple(sorted((f.getPath().getName(), f.getModificationTime()) for f in fs.listStatus(where)))
        return self.spark.sparkContext.applicationId, self.sf_dir, times

    def _stored(self, name: str, build) -> DataFrame:
        """Derived input written once per session and input folder to the shared
        checkpoint folder, then read back (a stored table, lineage cut)."""
        from .session import scratch_path
        key = (*self.version(), name)
        path = _FEATURE_CACHE.get(key)
        if path is None:
            path = scratch_path(self.spark, name)
            build().write.mode("overwrite").parquet(path)
            _FEATURE_CACHE[key] = path
        return self.spark.read.parquet(path)

    def _derived_raw(self) -> DataFrame:
        # the supplier count is one scalar: bind it as a literal instead of
        # re-running the scalar subquery inside every expression
        n = self.table("supplier").count()
        text = RAW_MATCHES_SQL.replace(_N, str(n))
        return self.spark.sql(text, lineitem=self.table("lineitem"))

    def raw_matches(self) -> DataFrame:
        return self._stored("raw_matches", self._derived_raw)

    def matches(self) -> DataFrame:
        # straight from the lines: the raw rows' text columns are neither built nor stored for it
        return self._stored("matches", lambda: self.spark.sql(MATCHES_SQL, raw_matches=self._derived_raw()))

    def predictions(self, matches: DataFrame | None = None) -> DataFrame:
        """Scored matches; ``matches`` may be these with more columns, which stay."""
        return self.spark.sql(PREDICTIONS_SQL, matches=self.matches() if matches is None else matches)

    def users(self) -> DataFrame:
        return self.spark.sql(USERS_SQL, events=self.table("events"))

    def features(self) -> DataFrame:
        """The unfilled feature table of ``matches``, written once per session and
        input folder to the shared checkpoint folder (cuts the long lineage)."""
        from .operators.features import feature_matrix
        return self._stored("features", lambda: feature_matrix(self.matches(), fill=False))

    def team_aliases(self) -> DataFrame:
        return self.spark.sql(TEAM_ALIASES_SQL, supplier=self.table("supplier"))
