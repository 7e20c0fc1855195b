import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.sql.maxMetadataStringLength", "5000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def skewed_plays(spark):
    """Raw plays of two games where user 1 holds a third of all rows, with tied times."""
    return spark.range(1200).selectExpr(
        "id AS game_result_id",
        "IF(id % 3 = 0, 1L, 2 + (id * 7) % 40) AS user_id",
        "1 + (id DIV 3) % 2 AS game_id",
        "timestamp'2024-01-01' + make_interval(0, 0, 0, CAST(id DIV 50 AS INT)) AS created_at",
        "timestamp'2024-01-01' + make_interval(0, 0, 0, CAST(id DIV 50 AS INT))"
        " AS event_created_at",
        "CAST(1 + (id * 13) % 7 AS INT) AS user_level",
        "CAST(1 + (id * 11) % 9 AS INT) AS session_level",
        "CAST((id * 37) % 101 AS DOUBLE) AS score",
        "CONCAT('{\"num_correct\": ', (id * 17) % 23, ', \"num_tries\": ', (id * 17) % 23 + id % 4,"
        " ', \"playTime\": ', 1000 * (id % 61), '}') AS metadata",
    )


def rows_of(df, columns=None):
    """All rows as sorted tuples, doubles to 9 places."""
    columns = columns or sorted(df.columns)

    def plain(value):
        return round(value, 9) + 0.0 if isinstance(value, float) else value

    found = [tuple(plain(row[c]) for c in columns) for row in df.collect()]
    return sorted(found, key=lambda row: tuple((v is None, str(v)) for v in row))
