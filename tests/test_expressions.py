import math

import pytest

from cohortlens.functions import (
    age,
    json_fields,
    json_steps,
    ks_p_value,
    number,
    percent,
    t_quantile,
    to_number,
    variance_explained,
    whole_number,
)


def value(spark, text):
    return spark.sql(f"SELECT {text}").first()[0]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("'12'", 12.0),
        ("' 3.5 '", 3.5),
        ("'-1e3'", -1000.0),
        ("'bad'", None),
        ("''", None),
        ("'12d'", None),
        ("'7F'", None),
        ("'NaN'", None),
        ("'Infinity'", None),
        ("'inf'", None),
        ("'1.5E2'", 150.0),
        ("'0x1p3'", None),
        ("CAST(NULL AS STRING)", None),
        ("7", 7.0),
    ],
)
def test_to_number(spark, text, expected):
    assert value(spark, to_number(text)) == expected


def test_whole_number_has_no_fraction(spark):
    assert value(spark, whole_number("'4'")) == 4
    assert value(spark, whole_number("'1.5'")) is None
    assert value(spark, whole_number("'x'")) is None


@pytest.mark.parametrize(
    "part, whole, expected",
    [("3D", "4D", 75.0), ("3D", "0D", 0.0), ("0D", "0D", None), ("NULL", "4D", None)],
)
def test_percent(spark, part, whole, expected):
    assert value(spark, percent(part, whole)) == expected


@pytest.mark.parametrize("part, whole, expected", [("0.6D", "1.6D", 38.0), ("0.58D", "0.8D", 72.0)])
def test_percent_on_a_half(spark, part, whole, expected):
    """The product is taken first: 100 * 0.6 / 1.6 is 37.5, which goes to the even 38."""
    assert value(spark, f"bround({percent(part, whole)})") == expected


@pytest.mark.parametrize("constant", [float("inf"), float("-inf"), 0.1, 1e300])
def test_constants_of_any_size(spark, constant):
    assert value(spark, number(constant)) == constant
    assert math.isnan(value(spark, number(float("nan"))))


def test_ks_p_value_of_tables(spark):
    """Critical values as printed in statistics tables, for samples so large that the asymptotic
    distribution holds: 1.3581 for 5 percent and 1.6276 for 1 percent."""
    n = 10**8
    for critical, p in ((1.2238, 0.10), (1.3581, 0.05), (1.6276, 0.01)):
        d = critical / math.sqrt(n / 2)
        assert value(spark, ks_p_value(f"{d!r}D", f"{n}L", f"{n}L")) == pytest.approx(p, abs=2e-4)


@pytest.mark.parametrize(
    "unit, start, end, complete, crossed",
    [
        ("month", "2024-01-31", "2024-02-15", 0, 1),
        ("month", "2024-01-31", "2024-02-29", 1, 1),
        ("month", "2024-03-15", "2024-02-15", -1, -1),
        ("week", "2024-01-28", "2024-01-29", 0, 1),
        ("day", "2024-01-30 18:00:00", "2024-01-31", 0, 1),
        ("day", "2024-01-29 00:00:00", "2024-01-31", 2, 2),
        ("year", "2023-12-31", "2024-01-01", 0, 1),
    ],
)
def test_age(spark, unit, start, end, complete, crossed):
    start, end = f"timestamp'{start}'", f"timestamp'{end}'"
    assert value(spark, age(unit, start, end)) == complete
    assert value(spark, age(unit, start, end, boundary=True)) == crossed


def test_json_fields_of_broken_text_are_null(spark):
    parsed, read = json_fields("m", ["a", "b", "a"])
    ((name, text),) = parsed.items()
    sql = f"SELECT {read['a']}, {read['b']} FROM (SELECT {text} AS {name} FROM VALUES (%s) AS t(m))"
    assert tuple(spark.sql(sql % """'{"a": 5, "b": "x"}'""").first()) == ("5", "x")
    assert tuple(spark.sql(sql % """'{"a": '""").first()) == (None, None)
    assert tuple(spark.sql(sql % "CAST(NULL AS STRING)").first()) == (None, None)


def test_variance_explained(spark):
    def over(rows):
        values = ", ".join(rows)
        text = variance_explained("k", "m")
        return spark.sql(f"SELECT {text} FROM VALUES {values} AS t(k, m)").first()[0]

    assert over(["(1, 2D)", "(2, 4D)", "(3, 6D)"]) == pytest.approx(100)
    assert over(["(1, 2D)", "(2, 2D)"]) is None
    assert over(["(1, 2D)"]) is None
    assert over(["(1, 2D)", "(2, 4D)", "(9, NULL)"]) == pytest.approx(100)


def test_ks_p_value(spark):
    assert value(spark, ks_p_value("0D", "50L", "60L")) == 1
    assert value(spark, ks_p_value("1D", "500L", "600L")) == pytest.approx(0, abs=1e-12)
    en = math.sqrt(50 * 60 / 110)
    lam = (en + 0.12 + 0.11 / en) * 0.25
    series = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))
    assert value(spark, ks_p_value("0.25D", "50L", "60L")) == pytest.approx(series)
    assert value(spark, ks_p_value("CAST(NULL AS DOUBLE)", "5L", "6L")) is None


@pytest.mark.parametrize(
    "level, freedom, expected",
    [
        (0.95, 1, 12.706204736174698),
        (0.95, 2, 4.302652729749462),
        (0.95, 3, 3.182446305283708),
        (0.95, 4, 2.776445105197793),
        (0.95, 8, 2.306004135204166),
        (0.95, 9, 2.262157162798205),
        (0.95, 10, 2.228138851986274),
        (0.95, 30, 2.042272456301238),
        (0.95, 120, 1.979930405082441),
        (0.95, 1000, 1.9623390808264085),
        (0.99, 1, 63.656741162871526),
        (0.99, 5, 4.032142983555228),
        (0.5, 1, 1.0),
        (0.5, 2, 0.816496580927726),
        (0.95, 0, None),
        (0.95, -1, None),
        (0.95, "NULL", None),
    ],
)
def test_t_quantile_of_tables(spark, level, freedom, expected):
    found = value(spark, t_quantile(level, f"CAST({freedom} AS INT)"))
    assert found == (expected and pytest.approx(expected, rel=1e-12))


def test_t_quantile_meets_its_expansion(spark):
    """Both ways agree where they meet, and end at the normal quantile."""
    for level, normal in ((0.8, 1.2815515655446004), (0.95, 1.959963984540054), (0.9999, 3.890591886413094)):
        rows = spark.range(998, 1004).selectExpr(f"{t_quantile(level, 'id')} AS t").collect()
        steps = [a.t - b.t for a, b in zip(rows, rows[1:])]
        assert all(step > 0 for step in steps)
        assert steps[2] == pytest.approx(steps[1], rel=3e-3)  # from the solution to the expansion
        assert value(spark, t_quantile(level, "CAST(1e15 AS BIGINT)")) == pytest.approx(normal, rel=1e-14)


def test_t_quantile_of_far_levels(spark):
    """Two degrees of freedom have a closed form."""
    for level in (1e-6, 0.3, 0.999, 0.9999999):
        tail = 1 - level
        exact = level * math.sqrt(2 / (tail * (2 - tail)))
        assert value(spark, t_quantile(level, "2")) == pytest.approx(exact, rel=1e-9)


@pytest.mark.parametrize(
    "path, steps",
    [
        ("num_correct", ["num_correct"]),
        ("summary.num correct", ["summary", "num correct"]),
        ("items[0].x", ["items", 0, "x"]),
        ("items[10][2]", ["items", 10, 2]),
        ('"a.b".c', ["a.b", "c"]),
        ('a."b ""quoted"""', ["a", 'b "quoted"']),
        ("['a.b'][\"c]\"]", ["a.b", "c]"]),
        ("[3].x", [3, "x"]),
    ],
)
def test_json_steps(path, steps):
    assert json_steps(path) == steps


@pytest.mark.parametrize("path", ["", ".", "a.", "a..b", ".a", "a[", "a[x]", "a[-1]", 'a"b"', "a]b", 'a."b'])
def test_paths_that_are_none(path):
    with pytest.raises(ValueError):
        json_fields("m", [path])


def test_json_arrays_of_mixed_elements(spark):
    paths = ["items[0].x", "items[1]", "items[2][1]", '"a.b"."c d"', "it's[0]", "s"]
    parsed, read = json_fields("m", paths)
    assert list(parsed.values()) == ["try_parse_json(m)"]  # one parse for all paths
    blobs = [
        '{"items": [{"x": 1.50}, 7, [1, "z"]], "a.b": {"c d": true}, "it\'s": ["q"], "s": {"k": 1}}',
        '{"items": {"x": 1}, "a.b": 3, "s": null}', '{"Items": [{"x": 1}]}', "[1, 2]", "no json", None,
    ]
    df = spark.createDataFrame([(b,) for b in blobs], "m string")
    df = df.selectExpr(*(f"{text} AS {name}" for name, text in parsed.items()))
    rows = [tuple(r) for r in df.selectExpr(*(f"{read[p]} AS c{i}" for i, p in enumerate(paths))).collect()]
    assert rows[0] == ("1.5", "7", "z", "true", "q", '{"k":1}')
    assert set(rows[1:]) == {(None,) * 6}


def test_json_quoted_names_share_a_parse(spark):
    parsed, read = json_fields("m", ['"a.b".c', "a.b", "['a.b'].d"])
    assert len(parsed) == 1
    df = spark.sql("""SELECT '{"a.b": {"c": 1.50, "d": "x"}, "a": {"b": 2}}' AS m""")
    df = df.selectExpr(*(f"{text} AS {name}" for name, text in parsed.items()))
    assert tuple(df.selectExpr(*(f"{t} AS c{i}" for i, t in enumerate(read.values()))).first()) == ("1.5", "2", "x")
