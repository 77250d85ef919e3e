from eralex.config import Settings


def test_order_of_settings(spark, monkeypatch):
    assert Settings.read().pool == 50
    monkeypatch.setenv("ERALEX_POOL", "7")
    assert Settings.read().pool == 7
    spark.conf.set("eralex.pool", "9")
    assert Settings.read(spark).pool == 9
    spark.conf.unset("eralex.pool")


def test_cut_and_drop(spark):
    from eralex.runtime import cut, drop_cuts

    drop_cuts(spark)
    df = cut(spark.range(5), "t")
    assert df.count() == 5 and drop_cuts(spark) == 1 and drop_cuts(spark) == 0
