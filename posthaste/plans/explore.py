"""Statistics of an annotated table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from posthaste.operators import encoding, stats

LABELS = ("text", "content_type", "rhetorical_target")


def explore(annotated: DataFrame, order: str = "ord", bins: int = 20) -> dict[str, DataFrame]:
    """Profile, pair counts, correlations, collinearity and a regression of the
    ragebait answer on all other columns. Token counts take part if present.

    Four scans: an overview of all columns and categories, the sums of products
    that correlations, collinearity and regression share, the residuals, and
    the pair counts, once they are asked for.
    """
    plain = annotated.drop("chunk_id", "started_at", "finished_at")
    numbers = [c for c in stats.numeric_columns(plain) if c != order]
    seen = stats.overview(plain, LABELS[1:])
    encoded = encoding.dummies(plain.drop("text"), LABELS[1:], seen.categories)
    predictors = [c for c in encoded.columns if c not in (order, "ragebait")]
    sums = stats.pair_sums(encoded, {"pairs": stats.Among(numbers, complete=False), "answers": stats.Among(numbers),
                                     "fit": stats.Among([*predictors, "ragebait"])}, seen.mean)
    coefficients, summary = stats.ols(encoded, "ragebait", predictors, order, sums=sums["fit"])
    return {"profile": stats.profile(plain, seen),
            "pairs": stats.pair_bins(plain, numbers, bins, seen),
            "correlation": stats.corr_matrix(plain, numbers, sums["pairs"]),
            "vif": stats.vif(plain, numbers, sums["answers"]),
            "coefficients": coefficients, "fit": summary}
