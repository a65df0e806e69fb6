"""A table loaded by its profile: names, types and roles are checked at once."""

import pytest

from indicata.profile import DEFAULT_PROFILE, OBSERVATIONS, ColumnProfile

_TEXT = [c for c in DEFAULT_PROFILE.columns if c not in ("country", "year", "value", "income_level")]
_FLAGS = ["high_income", "upper_middle_income", "lower_middle_income", "low_income"]
FULL = ", ".join(["country_or_area string", "year int", "value double", "extra long",
                  *[f"{c} string" for c in [*_TEXT, *_FLAGS]]])


def test_the_shipped_profile_is_the_default():
    shipped = ColumnProfile.from_yaml(OBSERVATIONS)
    assert shipped == ColumnProfile(data_path="observations.parquet")


def test_load_names_classifies_and_keeps_the_rest(spark, tmp_path):
    path = str(tmp_path / "obs")
    names = [p.split(" ")[0] for p in FULL.split(", ")]
    row = tuple({"country_or_area": "A", "year": 2000, "value": 1.0, "extra": 7, "low_income": "Low income"}.get(n)
                for n in names)
    spark.createDataFrame([row], FULL).write.parquet(path)
    out = ColumnProfile(data_path=path).load(spark)
    got = out.first()
    assert (got.country, got.income_level, got.extra) == ("A", "Low Income", 7)
    assert "country_or_area" not in out.columns and set(DEFAULT_PROFILE.columns) <= set(out.columns)


def test_everything_wrong_is_told_at_once(spark):
    bad = (FULL.replace("year int", "year string").replace("iso3 string, ", "").replace("source string", "Source string")
           .replace("country_or_area string", "nation string").replace("low_income string", "lowest string", 1))
    with pytest.raises(ValueError) as told:
        DEFAULT_PROFILE.apply(spark.createDataFrame([], bad))
    text = str(told.value)
    for part in ("'year' is string, not int", "no column 'iso3'", "no column 'source', but there is 'Source'",
                 "no column 'country' (stored as 'country_or_area')", "'income_level' needs the column"):
        assert part in text, part


def test_a_table_that_has_its_names_already(spark):
    done = FULL.replace("country_or_area", "country") + ", income_level string"
    assert DEFAULT_PROFILE.apply(spark.createDataFrame([], done)).columns == [p.split(" ")[0] for p in done.split(", ")]
    both = spark.createDataFrame([], FULL + ", country string")
    with pytest.raises(ValueError, match="both there"):
        DEFAULT_PROFILE.apply(both)


@pytest.mark.parametrize("text, told", [
    ("query:\n  source_metadata_columns: source\n", "list of names"),
    ("query:\n  sources: [source]\n", "unknown role 'sources'"),
    ("types: [year]\n", "map names")])
def test_a_profile_with_mistakes_is_rejected(tmp_path, text, told):
    path = tmp_path / "p.yaml"
    path.write_text(text)
    with pytest.raises(ValueError, match=told):
        ColumnProfile.from_yaml(str(path))


def test_a_profile_without_a_path(spark):
    with pytest.raises(ValueError, match="path"):
        DEFAULT_PROFILE.load(spark)


def test_an_empty_yaml_is_the_default(tmp_path):
    (tmp_path / "p.yaml").write_text("")
    assert ColumnProfile.from_yaml(str(tmp_path / "p.yaml")) == DEFAULT_PROFILE
