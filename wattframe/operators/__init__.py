"""DataFrame → DataFrame operators."""

from wattframe.operators import (evaluate, features, impute, joins, profile, report, resolve, reshape,
                                 sampling, sequences)

__all__ = ["evaluate", "features", "impute", "joins", "profile", "report", "resolve", "reshape",
           "sampling", "sequences"]
