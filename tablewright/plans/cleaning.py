"""The five-step cleaning plan: missing values, duplicates, scaling, encoding, outliers.

Each step fits a few numbers with a small aggregation and applies them as a
narrow projection/filter.  The plan always starts from the table it is given,
so applying it twice to the same input gives the same result (runs do not stack).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import numeric_columns
from ..operators import clean as C
from ..operators.rank import written

# Cleaning log texts.
LOG_ROWS_REMOVED = "Removed {n} rows with missing values"
LOG_COLS_REMOVED = "Removed {k} columns with >{thr}% missing: {cols}"
LOG_IMPUTED = "Imputed {n} missing values (numeric: {method}, categorical: mode)"
LOG_DUPLICATES = "Removed {n} duplicate rows"
LOG_ZSCORE = "Applied Z-score standardization"
LOG_MINMAX = "Applied Min-Max scaling [0, 1]"
LOG_ROBUST = "Applied Robust scaling (median/IQR)"
LOG_LABEL = "Label-encoded: {cols}"
LOG_ONEHOT = "One-hot encoded: {cols}"
LOG_OUTLIERS = "{n} outliers {label} ({method} method)"
LOG_NOTHING = "No changes applied (all settings at default)."


@dataclass
class CleaningSpec:
    na_strategy: str = "none"          # none | remove_rows | remove_cols | impute
    na_col_threshold: float = 50.0     # percent, for remove_cols
    impute_method: str = "mean"        # mean | median | mode (text columns always use the mode)
    remove_dups: bool = False
    scale_method: str = "none"         # none | zscore | minmax | robust
    encode_method: str = "none"        # none | label | onehot
    encode_cols: list[str] = field(default_factory=list)
    outlier_method: str = "none"       # none | iqr | z
    outlier_action: str = "flag"       # flag | remove | cap
    reference_mode: bool = False       # True: outlier step also treats encoded columns
    max_levels: int = 200

    def apply(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        log: list[str] = []
        out = df
        if self.na_strategy == "remove_rows":
            n0 = out.count()
            out = C.drop_missing_rows(out)
            log.append(LOG_ROWS_REMOVED.format(n=n0 - out.count()))
        elif self.na_strategy == "remove_cols":
            out, dropped = C.drop_missing_columns(out, self.na_col_threshold)
            if dropped:
                thr = int(self.na_col_threshold) if float(self.na_col_threshold).is_integer() else self.na_col_threshold
                log.append(LOG_COLS_REMOVED.format(k=len(dropped), thr=thr, cols=", ".join(dropped)))
        elif self.na_strategy == "impute":
            out, n = C.impute(out, self.impute_method)
            if n > 0:
                log.append(LOG_IMPUTED.format(n=n, method=self.impute_method))

        if self.remove_dups:
            n0 = out.count()
            # the de-duplicated table feeds every later fit pass: it is written once to the shared folder
            out = written(C.dedup(out), "deduplicated")
            removed = n0 - out.count()
            if removed > 0:
                log.append(LOG_DUPLICATES.format(n=removed))

        if self.scale_method != "none":
            cols = numeric_columns(out)
            if cols:
                out = C.scale(out, self.scale_method, cols)
                log.append({"zscore": LOG_ZSCORE, "minmax": LOG_MINMAX, "robust": LOG_ROBUST}[self.scale_method])

        outlier_cols = numeric_columns(out)
        if self.encode_method != "none" and self.encode_cols:
            if self.encode_method == "label":
                out = C.encode_label(out, self.encode_cols)
                log.append(LOG_LABEL.format(cols=", ".join(self.encode_cols)))
            elif self.encode_method == "onehot":
                out = C.encode_onehot(out, self.encode_cols, max_levels=self.max_levels)
                log.append(LOG_ONEHOT.format(cols=", ".join(self.encode_cols)))
        if self.reference_mode:
            outlier_cols = numeric_columns(out)

        if self.outlier_method != "none":
            cols = [c for c in outlier_cols if c in out.columns]
            if self.outlier_action == "remove":
                out, n = C.remove_outliers_sequential(out, self.outlier_method, cols)
                label = "removed"
            elif self.outlier_action == "cap":
                out, n = C.cap_outliers(out, self.outlier_method, cols)
                label = "winsorized"
            else:
                n = sum(C.outlier_counts(out, self.outlier_method, cols).values())
                out = C.outlier_flags(out, self.outlier_method, cols)
                label = "flagged"
            if n > 0:
                log.append(LOG_OUTLIERS.format(n=n, label=label, method=self.outlier_method))

        if not log:
            log = [LOG_NOTHING]
        return out, log


def log_frame(spark: SparkSession, log: list[str]) -> DataFrame:
    """The cleaning log as ``(step, message)`` rows."""
    return spark.createDataFrame([(i + 1, m) for i, m in enumerate(log)], "step long, message string")
