from pyspark.sql import functions as F

from meshquery.functions import apps


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.r for r in df.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


def test_hosts_and_addresses(spark):
    assert column(spark, ["https://www.google-analytics.com/a.js", "https://shop.com/a.js"], apps.third_party) == [True, False]
    asked = [("https://en.wikipedia.org/wiki/Rust", "x/{title}", "x/Rust"), ("https://github.com/a/b/issues", "{owner}/{repo}", "a/b"), ("https://github.com/a", "{owner}/{repo}", None), ("https://pypi.org/project/numpy/", "{package}", "numpy"), ("https://crates.io/serde", "{crate_name}", "serde")]
    df = spark.createDataFrame(asked, "u string, t string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", apps.rest_address(F.col("u"), F.col("t"))).collect())


def test_canvas(spark):
    assert column(spark, ["<canvas id=x>", "<p>"], apps.canvas_app) == [True, False]
    assert column(spark, ['{"cells":{}}', '{"layers":[]}', '{"lat":1,"lng":2}', '{"board":1,"shapes":[]}', "{}"], apps.canvas_kind) == ["spreadsheet", "design", "map", "whiteboard", "unknown"]
    got = column(spark, ["A1", "AB12", "1A", "A"], apps.cell)
    assert [(c.row, c.col) if c else None for c in got] == [(0, 0), (11, 27), None, None]
    assert [(c.name, c.value) for c in column(spark, ['{"cells":{"A1":"x","B2":"3"}}'], apps.grid_cells)[0]] == [("A1", "x"), ("B2", "3")]


def test_tools_names_and_hashes(spark):
    tools = spark.createDataFrame([("addToCart", "", 2), ("x", "Search the site", 1), ("x", "y", 9)], "n string, d string, c int")
    assert [r.f for r in tools.select(apps.fits_category(F.col("n"), F.col("d"), F.col("c")).alias("f")).collect()] == [True, True, False]
    assert column(spark, ["qury", "zzzzzzzz"], lambda c: apps.nearest_name(c, ["map", "query", "pathfind"])) == ["query", None]
    assert column(spark, ["", "a", None], apps.fnv1a) == [0xCBF29CE484222325 - (1 << 64), 0xAF63DC4C8601EC8C - (1 << 64), None]


def test_sql_functions(spark):
    apps.register(spark)
    assert spark.sql("SELECT resolve_url('http://a/b/', 'c') AS u").first().u == "http://a/b/c"
    got = spark.sql("SELECT * FROM pii_matches('mail a@b.co or 123-45-6789')").collect()
    assert sorted((r.type, r.match) for r in got) == [("email", "a@b.co"), ("ssn", "123-45-6789")]
