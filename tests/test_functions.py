import pytest
from pyspark.sql import functions as F

from countygeo.functions import geo
from countygeo.functions import scalar as sc
from countygeo.functions import views as vw


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_parse_panoid(spark):
    ids = [("09006900001410191436379165M",), ("short-of-16-ch",), (None,)]
    got = [r[0] for r in spark.createDataFrame(ids, "p string").select(sc.parse_panoid("p")).collect()]
    assert tuple(got[0]) == ("090_0000_5M", "141019", "069")
    assert got[1] is None and got[2] is None


def test_city_codes_differ(spark):
    rows = spark.createDataFrame([(c,) for c in ("510104", "419001", "441900", "110101", "500103", "51")], "a string")
    got = {r.a: (r.label, r.show, r.prov) for r in rows.select(
        "a", sc.label_city("a").alias("label"), sc.display_city("a").alias("show"), sc.province_code("a").alias("prov")).collect()}
    assert got["510104"] == ("510100", "510100", "510000")
    assert got["419001"] == ("410000", "419001", "410000")
    assert got["441900"] == ("441900", "441900", "440000")
    assert got["110101"] == ("110100", "110000", "110000")
    assert got["500103"][1] == "500000"
    assert got["51"] == ("51", "51", "510000")
    assert one(spark, sc.province_code(F.lit("5"), "null"))[0] is None


def test_grid_truncates_toward_zero(spark):
    row = one(spark, geo.grid_x(F.lit(-0.001), F.lit(0.0), 300.0), geo.grid_y(F.lit(-0.004), 300.0))
    assert tuple(row) == (0, -1)


def test_haversine_known_distance(spark):
    d = one(spark, geo.haversine_km(F.lit(116.4074), F.lit(39.9042), F.lit(121.4737), F.lit(31.2304)),
            geo.haversine_m(F.lit(104.0), F.lit(30.5), F.lit(104.0), F.lit(30.5)))
    assert abs(d[0] - 1067) < 15 and abs(d[1]) < 1e-6


def test_group_key_falls_back_to_the_sample(spark):
    rows = spark.createDataFrame([("v", "d", "p"), (None, "d", "p"), ("v", "", "p")], "v string, d string, p string")
    assert [r[0] for r in rows.select(sc.group_key("v", "d", "p")).collect()] == ["v|d", "solo|p", "solo|p"]


def test_vehicle_and_year_labels(spark):
    rows = spark.createDataFrame([("a_b_in", "20190101"), ("a_b_5m", "190101"), (None, None)], "v string, d string")
    got = [tuple(r) for r in rows.select(sc.vehicle_label("v"), sc.year_label("d"), sc.report_year("d")).collect()]
    assert got == [("", "2019", "2019"), ("A_B_5M", "unknown", "1901"), ("", "unknown", "?")]


def test_view_config_is_checked():
    for bad in ({"min_views": 0}, {"n_max": 9}, {"min_views": 5, "n_max": 4}, {"single_view_prob": 1.5}):
        with pytest.raises(ValueError):
            vw.ViewConfig(**bad)


def test_panorama_evaluation_plan(spark):
    plan = vw.with_view_plan(spark.createDataFrame([("k",)], "key string"), vw.ViewConfig(n_max=4), "key",
                             training=False, eval_mode="panorama").first()
    assert plan.n_views == 4 and plan.headings == [0.0, 90.0, 180.0, 270.0] and plan.vmask == [True] * 4


def test_layers(spark):
    layers = F.from_json(F.lit('[{"ImgLevel":1,"BlockX":2,"BlockY":1},{"ImgLevel":3,"BlockX":8,"BlockY":4},'
                               '{"ImgLevel":1,"BlockX":9,"BlockY":9}]'), vw.LAYER_SCHEMA)
    row = one(spark, vw.pick_layer(layers, F.lit(1)).alias("a"), vw.pick_layer(layers, F.lit(2)).alias("b"),
              vw.pick_nearest_layer(layers, 4096).alias("c"), vw.fallback_levels(F.lit(4)).alias("f"))
    assert (row.a.bx, row.a.exact) == (9, True)
    assert (row.b.level, row.b.exact) == (3, False)
    assert row.c.bx == 8 and row.f == [3, 5]
