"""Column roles of the observation table (S3).

The roles are the fixed values of the table layout: which columns index
an observation, which classify a country, which describe the source and
which describe the indicator.  A profile may be read from YAML; ``load`` applies it
to a stored table and tells everything that does not fit in one error.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from indicata.functions.expressions import INCOME_RULES, income_level

#: The profile that ships with the library.
OBSERVATIONS = os.path.join(os.path.dirname(__file__), "profiles", "observations.yaml")
_ROLES = ("index_columns", "country_classification_columns", "source_metadata_columns", "indicator_metadata_columns")


@dataclass(frozen=True)
class ColumnProfile:
    # The column roles of the observation table.
    index_columns: tuple = ("iso3", "country", "year", "indicator_label", "value")
    country_classification_columns: tuple = (
        "region_name",
        "sub_region_name",
        "intermediate_region_name",
        "least_developed_countries_ldc",
        "land_locked_developing_countries_lldc",
        "small_island_developing_states_sids",
        "income_level",
        "oecd_member",
        "fragile_and_conflict_affected_situations",
    )
    source_metadata_columns: tuple = ("source", "database", "collection")
    indicator_metadata_columns: tuple = ("indicator_code", "value_meta")
    data_path: str | None = field(default=None)
    #: Stored name -> name used here.
    rename: tuple = (("country_or_area", "country"),)
    #: (column, Spark type) of the columns that are not text.
    types: tuple = (("year", "int"), ("value", "double"))

    @property
    def metadata_columns(self) -> tuple:
        return (self.source_metadata_columns + self.indicator_metadata_columns
                + self.country_classification_columns)

    @property
    def metadata_groups(self) -> tuple:
        """The metadata columns by what they depend on: the source, the indicator, the country."""
        return (self.source_metadata_columns, self.indicator_metadata_columns, self.country_classification_columns)

    def present(self, df: DataFrame, cols) -> list:
        """Columns of ``cols`` that the table has, in the given order."""
        have = set(df.columns)
        return [c for c in cols if c in have]

    @property
    def columns(self) -> tuple:
        """Every column that has a role, once."""
        return tuple(dict.fromkeys(self.index_columns + self.metadata_columns))

    def problems(self, schema: StructType) -> list[str]:
        """What a table with this (stored) schema lacks or has otherwise than the profile says."""
        stored = {f.name: f.dataType.simpleString() for f in schema.fields}
        old_name = {new: old for old, new in self.rename}
        types, found = dict(self.types), []
        for name in self.columns:
            here = old_name.get(name, name)
            if here in stored and name != here and name in stored:
                found.append(f"{here!r} and {name!r} are both there, and the first is renamed to the second")
            here = here if here in stored else name
            if here not in stored:
                if name == "income_level":
                    lacking = [flag for flag, _, _ in INCOME_RULES if flag not in stored]
                    found += [f"'income_level' needs the column {flag!r}" for flag in lacking]
                    continue
                near = [c for c in stored if c.lower().replace(" ", "_") == name.lower()]
                wanted = f"{name!r} (stored as {old_name[name]!r})" if name in old_name else repr(name)
                found.append(f"no column {wanted}" + (f", but there is {near[0]!r}" if near else ""))
            elif stored[here] != types.get(name, "string"):
                found.append(f"{here!r} is {stored[here]}, not {types.get(name, 'string')}")
        return found

    def load(self, spark: SparkSession, path: str | None = None) -> DataFrame:
        """The table at ``path`` (by default the profile's own), checked and named by the profile.

        Only the footer is looked at here.  Every missing, mistyped or wrongly
        named column is told in one error.  Columns are renamed as the
        profile says, ``income_level`` is derived where a role names it and the table
        lacks it, and columns without a role stay.
        """
        path = path or self.data_path
        if path is None:
            raise ValueError("the profile names no table; pass its path")
        return self.apply(spark.read.parquet(path), path)

    def apply(self, table: DataFrame, name: str = "the table") -> DataFrame:
        """``load`` for a stored table that is a frame already."""
        found = self.problems(table.schema)
        if found:
            raise ValueError(f"{name} does not fit the profile: " + "; ".join(found))
        out = table.withColumnsRenamed({old: new for old, new in self.rename if old in table.columns})
        if "income_level" in self.columns and "income_level" not in out.columns:
            out = out.withColumn("income_level", income_level())
        return out

    @classmethod
    def from_yaml(cls, path: str) -> "ColumnProfile":
        """The profile in a YAML file: ``query`` holds lists of columns by role, ``rename`` and
        ``types`` name -> name and column -> type, ``data`` the table's path (``*_path``).  What
        is left out has its default; an unknown role or a role that is no list of names is an error."""
        import yaml

        with open(path) as f:
            cfg = yaml.safe_load(f) or {}
        query = cfg.get("query") or {}
        wrong = [f"unknown role {k!r}" for k in query if k not in _ROLES]
        wrong += [f"{k!r} must be a list of names" for k in _ROLES if k in query and not (
            isinstance(query[k], list) and all(isinstance(c, str) for c in query[k]))]
        wrong += [f"{k!r} must map names to names" for k in ("rename", "types") if not isinstance(cfg.get(k) or {}, dict)]
        if wrong:
            raise ValueError(f"{path}: " + "; ".join(wrong))
        given: dict = {k: tuple(v) for k, v in query.items()}
        given |= {k: tuple(cfg[k].items()) for k in ("rename", "types") if cfg.get(k)}
        return cls(**given, data_path=next((v for k, v in (cfg.get("data") or {}).items()
                                            if str(k).endswith("_path")), None))


DEFAULT_PROFILE = ColumnProfile()
