"""Play tables made from the given tables, in Spark SQL and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _plays(k: str, text: str) -> str:
    return f"""
    select event_id as game_result_id, user_id,
      case event_type when 'click' then 1 when 'error' then 2 when 'purchase' then 3
        when 'signup' then 4 else 5 end as game_id,
      ts as created_at, ts as event_created_at,
      1 + k % 7 as user_level, 1 + k % 10 as session_level, value as score,
      case when k = 13 then 'bad' when k = 17 then null
        else cast(cast(floor(value / 10) as int) as {text}) end as numcorrect,
      case when user_id % 50 = 49 or k % 25 = 0 then '0'
        else cast(cast(floor(value / 10) as int) + k % 4 as {text}) end as numtries,
      cast(k * 1000 as {text}) as playtime, k as selected_level, 1 + k % 2 as version
    from (select *, cast({k} as int) as k from events) e"""


PLAYS_SPARK = _plays("get_json_object(props, '$.k')", "string")
PLAYS_DUCKDB = _plays("json_extract_string(props, '$.k')", "varchar")

# The same in both engines.
DATED = """
    select o_orderkey as game_result_id, o_custkey as user_id,
      case o_orderstatus when 'F' then 11 when 'O' then 12 else 13 end as game_id,
      o_orderdate as created_at, o_orderdate as event_created_at,
      year(o_orderdate) as yyyy, month(o_orderdate) as mm, o_totalprice as score
    from orders"""

GAMES = """
    select distinct
      case event_type when 'click' then 1 when 'error' then 2 when 'purchase' then 3
        when 'signup' then 4 else 5 end as id,
      event_type as name
    from events"""


def _view(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(sql.replace(f"from {table}", "from {frame}"), frame=frame)


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted form: values are columns."""
    return _view(spark, sf_dir, "events", PLAYS_SPARK)


def raw_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw form: values are fields of a JSON text."""
    return plays(spark, sf_dir).selectExpr(
        *("game_result_id", "user_id", "game_id", "created_at", "event_created_at"),
        *("user_level", "session_level", "score"),
        "to_json(named_struct('num_correct', numcorrect, 'num_tries', numtries, 'playTime',"
        " playtime, 'selected_level', selected_level, 'version', version)) as metadata",
    )


def nested_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw form with two fields one level down, and two names that differ in case alone."""
    return plays(spark, sf_dir).selectExpr(
        *("game_result_id", "user_id", "game_id", "created_at", "event_created_at"),
        *("user_level", "session_level", "score"),
        "to_json(named_struct('summary', named_struct('num_correct', numcorrect, 'num_tries',"
        " numtries), 'playTime', playtime)) as outer_part",
        "to_json(named_struct('playtime', selected_level)) as inner_part",
    ).selectExpr(
        *("game_result_id", "user_id", "game_id", "created_at", "event_created_at"),
        *("user_level", "session_level", "score"),
        "concat(substr(outer_part, 1, length(outer_part) - 1), ', ', substr(inner_part, 2))"
        " as metadata",
    )


# A line of a CSV file for each play, by the last digit of its id, the same in both engines: files of three kinds
# (the third lacks a column), and in the first kind lines that are no rows.
RAGGED = """
    select game_result_id, game_result_id % 10 as kind, case
        when game_result_id % 10 = 1 then concat(user_id, ',', session_level)
        when game_result_id % 10 = 2 then concat(user_id, ',', session_level, ',', user_level, ',7')
        when game_result_id % 10 = 3 then concat(user_id, ',level ', session_level, ',', user_level)
        when game_result_id % 10 = 4 then concat('"', user_id, '",,', user_level)
        when game_result_id % 10 < 7 then concat(user_id, ',', session_level, ',', user_level)
        when game_result_id % 10 < 9 then concat(user_level, ',"a, b",', user_id, ',', session_level)
        else concat(session_level, ',', user_id) end as line,
      case when game_result_id % 10 < 7 then 0 when game_result_id % 10 < 9 then 1 else 2 end as part
    from plays"""
HEADERS = ("User_ID,session_level,user_level", "USER_LEVEL,note,user_id,Session_Level", "session_level,user_id")


def ragged_files(spark: SparkSession, sf_dir: str, path: str) -> None:
    """CSV files with three headers and some broken lines."""
    lines = spark.sql(RAGGED.replace("from plays", "from {plays}"), plays=plays(spark, sf_dir))
    heads = spark.createDataFrame([(-1, i, h) for i, h in enumerate(HEADERS)], "game_result_id long, part int, line string")
    files = heads.unionByName(lines.select("game_result_id", "part", "line"))
    ordered = files.repartition("part").sortWithinPartitions("part", "game_result_id")
    ordered.select("line", "part").write.partitionBy("part").text(path)


# The blob of ``listed_plays``, the same in both engines but for the function that writes an object.
LISTED = """concat('{{"items": [', {first}, ', 7, {{"x": {{"y z": ', coalesce('"' || numtries || '"', 'null'),
      '}}}}], "play.time": ', {time}, '}}')"""


def listed_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw form with fields in an array of mixed elements, and names that hold a dot and a blank."""
    blob = LISTED.format(
        first="to_json(named_struct('x', numcorrect))", time="to_json(named_struct('in ms', playtime))"
    )
    return plays(spark, sf_dir).selectExpr(
        *("game_result_id", "user_id", "game_id", "created_at", "event_created_at"),
        *("user_level", "session_level", "score"),
        f"{blob} as metadata",
    )


def plays_with_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores that are no numbers, as a division elsewhere may leave them."""
    return plays(spark, sf_dir).selectExpr(
        "* except (score)", "if(selected_level = 11, double('NaN'), score) as score"
    )


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "orders", DATED)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plays(spark, sf_dir).selectExpr("game_result_id as id", "game_id", "user_id")


def anonymous_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results log with no user for a third of the results."""
    return results(spark, sf_dir).selectExpr(
        "id", "game_id", "if(id % 3 = 0, null, user_id) as user_id"
    )


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events", GAMES).selectExpr(
        "cast(id as bigint) as id",
        "name",
        "cast(null as timestamp) as updated_at",
        "cast(null as date) as release_date",
        "cast(null as string) as game_version",
    )
