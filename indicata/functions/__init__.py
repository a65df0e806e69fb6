from indicata.functions.expressions import (  # noqa: F401
    coverage_color,
    income_level,
    n_unique,
    quote,
)
