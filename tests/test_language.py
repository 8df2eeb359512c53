import datetime as dt

import pytest

from meshquery.catalog import PAGE_TYPE, model_view, models_of
from meshquery.plans.syntax import WqlError, parse, temporal
from meshquery.plans.translate import Catalog, wql

NODES = "domain string, node_id int, url string, page_type int, confidence int, flags int, features array<float>"


def node(domain, i, page_type, **dims):
    features = [0.0] * 128
    for k, v in dims.items():
        features[int(k[1:])] = float(v)
    return (domain, i, f"https://{domain}/{page_type}/{i}", PAGE_TYPE[page_type], 200, 0, features)


@pytest.fixture(scope="module")
def shops(spark):
    rows = [node("shop.com", i, "product_detail", d48=50 + 20 * i, d52=3 + 0.2 * i, d53=i) for i in range(10)]
    rows += [node("amazon.com", i, "product_detail", d48=30 + 25 * i, d52=3 + 0.1 * i) for i in range(15)]
    rows += [node("bbc.com", i, "article", d17=3 + 0.2 * i, d29=0.5) for i in range(8)]
    history = [("shop.com", "https://shop.com/product_detail/1", "price", dt.datetime(2024, 1, d), 100.0 - 5 * d) for d in range(1, 11)]
    points = spark.createDataFrame(history, "domain string, url string, field string, ts timestamp, value double")
    return Catalog(models_of(spark.createDataFrame(rows, NODES)), points, dt.datetime(2024, 1, 10))


def prices(spark, catalog, text):
    return [r.price for r in wql(spark, text, catalog).collect()]


def test_shop_queries(spark, shops):
    ask = lambda t: prices(spark, shops, t)
    assert len(ask("SELECT * FROM Product ACROSS shop.com LIMIT 5")) == 5
    assert sorted(ask("SELECT price FROM Product WHERE price < 100 ACROSS shop.com")) == [50, 70, 90]
    assert ask("select price from Product across shop.com order by price desc limit 3") == [230, 210, 190]
    assert ask("SELECT price FROM Product WHERE price > 99999") == []
    assert ask("SELECT price FROM Product WHERE price = 50.0004 ACROSS shop.com") == [50]
    assert wql(spark, "SELECT url FROM Product ACROSS amazon.com, shop.com LIMIT 30", shops).select("domain").distinct().count() == 2
    assert {r.domain for r in wql(spark, "SELECT * FROM Article LIMIT 5", shops).collect()} == {"bbc.com"}


def test_alias_order_and_late_across(spark, shops):
    out = wql(spark, "SELECT price AS p, rating FROM Product WHERE price < 300 AND rating > 3.0 ORDER BY rating DESC, price LIMIT 4 ACROSS amazon.com", shops)
    assert out.columns == ["domain", "url", "node_id", "p", "rating"]
    assert [r.p for r in out.collect()] == [280, 255, 230, 205]


def test_and_binds_tighter_than_or(spark, shops):
    got = prices(spark, shops, "SELECT price FROM Product WHERE price = 50 OR price = 70 AND rating > 100 ACROSS shop.com")
    assert got == [50]


def test_zero_is_unknown_and_never_matches(spark, shops):
    counts = [r.review_count for r in wql(spark, "SELECT review_count FROM Product ACROSS shop.com ORDER BY review_count", shops).collect()]
    assert counts == [1, 2, 3, 4, 5, 6, 7, 8, 9, None]
    assert wql(spark, "SELECT url FROM Product WHERE review_count < 100 ACROSS shop.com", shops).count() == 9
    assert wql(spark, "SELECT url FROM Product WHERE NOT review_count < 100 ACROSS shop.com", shops).count() == 0


def test_temporal_columns(spark, shops):
    row = wql(spark, "SELECT price_3d_ago, price_trend, predicted_price_3d, best_historic_price, best_historic_price_domain FROM Product WHERE price = 70 ACROSS shop.com", shops).first()
    assert (row.price_3d_ago, row.price_trend, row.best_historic_price, row.best_historic_price_domain) == (65.0, "decreasing", 50.0, "shop.com")
    assert abs(row.predicted_price_3d - 35.0) < 1e-6
    assert wql(spark, "SELECT url FROM Product WHERE price_3d_ago < 70", shops).count() == 1


def test_join(spark, shops):
    catalog = Catalog({"A": shops.models["Product"], "B": shops.models["Product"]})
    assert wql(spark, "SELECT price, B.price AS other FROM A JOIN B ON url = B.url WHERE price < 100 ACROSS shop.com", catalog).count() == 3


def test_plan_prunes_columns_and_pushes_filters(spark, tmp_path, shops):
    path = str(tmp_path / "products")
    shops.models["Product"].write.partitionBy("domain").parquet(path)
    df = wql(spark, "SELECT price FROM Product WHERE price < 100 ACROSS shop.com", Catalog({"Product": spark.read.parquet(path)}))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "(domain#" in plan.split("PartitionFilters")[1][:60] and "LessThan(price,100.0)" in plan and "seller_reputation" not in plan


@pytest.mark.parametrize("text", ["", "SELECT", "SELECTT name FROM Product", "SELECT name", "SELECT FROM Product", "SELECT * FROM Product WHERE", "SELECT * FROM Product WHERE price ~ 3", "SELECT * FROM Product WHERE name = 'open", "SELECT * FROM Product LIMIT x", "SELECT * FROM Product LIMIT 3 4", "SELECT * FROM Product WHERE (price < 3"])
def test_malformed(text):
    with pytest.raises(WqlError) as e:
        parse(text)
    assert str(e.value)


def test_unknown_names(spark, shops):
    for text in ("SELECT * FROM Nothing", "SELECT nothing FROM Product", "SELECT * FROM Product WHERE nothing = 1"):
        with pytest.raises(WqlError):
            wql(spark, text, shops)
    with pytest.raises(ValueError):
        model_view(shops.models["Product"], "Nothing")


def test_names_with_hyphens_and_temporal_names():
    assert parse("SELECT * FROM Product ACROSS my-shop.co.uk, b.de").across == ["my-shop.co.uk", "b.de"]
    assert temporal("price_30d_ago") == ("ago", "price", 30) and temporal("price_trend") == ("trend", "price", None)
    assert temporal("predicted_price_7d") == ("predicted", "price", 7) and temporal("best_historic_price") == ("best", "price", None)
    assert temporal("best_historic_price_domain") == ("best_domain", "price", None) and temporal("price") is None
