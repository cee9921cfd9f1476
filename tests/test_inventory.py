
import __spark_entry__ as E
from barlens.plans import catalog

EXPECTED = ([f"q{i:02d}_" for i in range(1, 47)] + [f"v{i}_" for i in range(1, 7)]
            + [f"p{i}_" for i in range(1, 7)] + [f"e{i:02d}_" for i in range(1, 8)]
            + [f"d{i:02d}_" for i in range(1, 22)])
INTENDED = ["q08", "q09", "q15", "q22", "q26", "q30", "v1"]


# Variants of a key: bounded dates, slicers, planted faults.
VARIANTS = ["q06_null_profile_keys", "e03_rejects", "e03_conform_dirty", "v1_daily_performance_range",
            "v2_moving_averages_range", "d11_rolling_vol20_range", "d03_best_worst_sliced",
            "d13_risk_table_sliced", "d17_ranking_sliced", "e03_flatten", "s03_feed_range", "s03_feed_range_adjusted"]


def test_every_survey_item_has_a_key():
    keys = [k for k in catalog.queries() if not k.endswith("__wide") and k not in VARIANTS and k not in catalog.FORMS]
    for prefix in EXPECTED:
        base = [k for k in keys if k.startswith(prefix) and not k.endswith("_intended")]
        assert len(base) == 1, (prefix, base)
    for p in INTENDED:
        assert any(k.startswith(p) and k.endswith("_intended") for k in keys), p
    assert len(keys) == len(EXPECTED) + len(INTENDED)
    assert set(VARIANTS) <= set(E.queries())
    # Other plans of a key have its oracle.
    assert all(E.oracle_sql()[form] == E.oracle_sql()[key] for form, key in catalog.FORMS.items()) and len(catalog.FORMS) == 21


def test_a_missing_library_takes_only_the_text_queries(monkeypatch):
    import sys

    for gone in ("barlens.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, gone, None)
        assert "pipeline" not in E.queries()
        assert set(catalog.queries()) <= set(E.queries())
        if gone == "barlens.llm.queries":
            assert set(E.queries()) == set(catalog.queries())
            monkeypatch.undo()


def test_wide_twins_and_oracles():
    q, o = catalog.queries(), E.oracle_sql()
    assert set(q) <= set(o)
    wide = [k for k in q if k.endswith("__wide")]
    assert all(k[: -len("__wide")] in q for k in wide) and len(wide) == 75
